"""Licence scan by ordered signature rules (native).

Counts of base phrases come from the words of a text. Beyond them, hand-written
signatures are matched: a text must hold one of the gate words at all, a rule
runs only where its keyword stands, and of overlapping detections one that lies
inside another of higher priority, or of equal priority and greater length, is
suppressed. All of it happens within the row, so nothing is shuffled and
repeated or null ids need no care.

Edge cases: a null text is an empty one; without a base phrase first_word and
last_word are null and n_base is 0; without any label both label strings are
empty and the score is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_rules import GATES, RULES, STRENGTH

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spaces(x: str) -> str:
    return f"(octet_length({x}) - octet_length(replace({x}, ' ', '')))"


def base_sql(padded: str) -> str:
    """SQL for an array of label, n, first and last of the base phrases that stand in `padded`: words parted and framed by single spaces."""
    table = "array({})".format(", ".join(f"named_struct('p', {_quoted(' ' + p + '(?= )')}, 'k', {p.count(' ') + 1}, 'label', {_quoted(label)})" for p, label in PHRASES))
    first = _spaces("element_at(g, 1)")
    last = f"{_spaces(padded)} - 1 - ({_spaces('element_at(g, -1)')} - 1) - p.k"
    found = let("g", f"split({padded}, p.p)", f"named_struct('label', p.label, 'n', cast(size(g) - 1 as bigint), 'first', cast({first} as bigint), 'last', cast({last} as bigint))")
    gate = f"{padded} like '% license %' or {padded} like '% cc by %'"
    return f"if({gate}, filter(transform({table}, p -> {found}), h -> h.n > 0), cast(array() as array<struct<label: string, n: bigint, first: bigint, last: bigint>>))"


_DETECTION = "array<struct<a: bigint, z: bigint, priority: int, rule: int, label: string, strength: double>>"


def rules_sql(flat: str) -> str:
    """SQL for the detections that remain in `flat`: lower-cased text with single spaces."""
    table = "array({})".format(", ".join(f"named_struct('label', {_quoted(label)}, 'priority', {p}, 'k', {_quoted(k)}, 're', {_quoted(re)}, 'rule', {i}, 'strength', {STRENGTH[p]}D)" for i, (label, p, k, re) in enumerate(RULES)))
    start = "aggregate(slice(g, 1, i + 1), 0L, (s, x) -> s + char_length(x)) + aggregate(slice(m, 1, i), 0L, (s, x) -> s + char_length(x))"
    spans = f"transform(m, (x, i) -> {let('a', start, "named_struct('a', a, 'z', a + char_length(x), 'priority', r.priority, 'rule', r.rule, 'label', r.label, 'strength', r.strength)")})"
    one = let("m", f"regexp_extract_all({flat}, r.re, 0)", f"if(size(m) = 0, cast(array() as {_DETECTION}), {let('g', f'split({flat}, r.re)', spans)})")
    found = f"flatten(transform(filter({table}, r -> contains({flat}, r.k)), r -> {one}))"
    inside = "e.a <= d.a and e.z >= d.z and (e.priority > d.priority or (e.priority = d.priority and (e.z - e.a > d.z - d.a or (e.z - e.a = d.z - d.a and e.rule < d.rule))))"
    gate = " or ".join(f"contains({flat}, {_quoted(g)})" for g in GATES)
    return f"if({gate}, {let('ds', found, f'filter(ds, d -> not exists(ds, e -> {inside}))')}, cast(array() as {_DETECTION}))"


def scanned(docs: DataFrame, text: str = "text", to: str = "__lic") -> DataFrame:
    """`docs` with a struct of n_words, base hits and remaining detections (with spans in lower-cased text with single spaces)."""
    lowered = f"lower(coalesce(`{text}`, ''))"
    padded = let("p", f"trim(regexp_replace({lowered}, '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', ' '))", "concat(' ', p, ' ')")
    base = let("b", padded, f"named_struct('n_words', cast(if(b = '  ', 0, {_spaces('b')} - 1) as bigint), 'hits', {base_sql('b')})")
    rules = let("f", f"regexp_replace({lowered}, '\\\\s+', ' ')", rules_sql("f"))
    return docs.withColumn(to, F.expr(f"named_struct('base', {base}, 'rules', {rules})"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    Full lower-casing stands in for that of A-Z: no letter beyond ASCII becomes
    a separator or a letter of a base phrase by it, so words and hits agree.
    """
    h = "__lic.base.hits"
    base = f"array_sort(array_distinct(transform({h}, x -> x.label)))"
    every = f"array_sort(array_distinct(concat(transform({h}, x -> x.label), transform(__lic.rules, x -> x.label))))"
    score = f"aggregate(__lic.rules, if(size({h}) > 0, 0.6D, 0.0D), (s, x) -> greatest(s, x.strength))"
    return scanned(docs.select("doc_id", "text")).selectExpr(
        "doc_id",
        "__lic.base.n_words as n_words",
        f"aggregate({h}, 0L, (s, x) -> s + x.n) as n_base",
        f"array_min(transform({h}, x -> x.first)) as first_word",
        f"array_max(transform({h}, x -> x.last)) as last_word",
        f"array_join({base}, ',') as base_labels",
        f"array_join({every}, ',') as labels",
        f"{score} as score",
    )
