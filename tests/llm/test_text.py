"""Decontamination, licences, HTML, language, toxicity, chats."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import pytest

from arrowmill.llm import chat, decontaminate, html_text, lang_id, licenses, toxicity
from arrowmill.llm.common import table
from arrowmill.llm.license_rules import GATES, RULES, STRENGTH


# -- decontamination


def leaks(docs, items):
    out = {}
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    for i, t in items:
        w = plain(t)
        k = min(5, len(w))
        if not w:
            continue
        own = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        for d, text in docs:
            x = plain(text)
            best = 0
            for s in range(len(x)):
                y = x[s : s + len(w)]
                c = Counter(tuple(y[j : j + k]) for j in range(len(y) - k + 1))
                if c & own:
                    best = max(best, sum((c & own).values()) / sum((c | own).values()))
            if best >= 0.8:
                out[d, i] = best
    return out


def leaks_of_sharers(docs, items):
    """`leaks` of the documents and items that share a shingle; the others have none."""
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    places, texts, out = {}, dict(items), {}
    for i, t in items:
        w = plain(t)
        for j in range(len(w) - 4):
            places.setdefault(tuple(w[j : j + 5]), set()).add(i)
    for d, t in docs:
        w = plain(t)
        for i in {i for j in range(len(w) - 4) for i in places.get(tuple(w[j : j + 5]), ())}:
            out |= leaks([(d, t)], [(i, texts[i])])
    return out


def test_leaks_equal_brute_force(spark, make):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.randrange(15, 50)))) for i in range(12)] + [(50, "two words"), (51, ""), (52, None), (53, "again and again and again and again and again")]
    docs = []
    for d in range(90):
        w = (items[d % 12][1]).split()
        for _ in range(d % 4):
            j = r.randrange(len(w))
            w[j : j + 1] = [word()] if d % 2 else [w[j], word()]
        lead = [word() for _ in range(r.randrange(0, 30))]
        docs.append((d, (" ", ", ", "...\n")[d % 3].join(lead + w[: len(w) - d % 3] + [word() for _ in range(5)]).upper()))
    docs += [(200, "here are two words now"), (201, None), (202, ""), (203, "and again and again and again and again and again and"), (204, "nothing of it")]
    rows = [(d, t, "en", "a") for d, t in docs]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.report(make(rows, clash=True), benchmark).collect()}
    want = leaks(docs, items)
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k]) for k in want)
    kept = decontaminate.keep(make(rows + [(None, docs[0][1], None, None), (None, "free text", None, None)], clash=True), benchmark)
    hit = {d for d, _ in want}
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [d for d, _ in docs if d not in hit]
    assert [x.text for x in kept.collect() if x.doc_id is None] == ["free text"]


def test_items_with_common_parts_lose_no_link(spark, make):
    """Items of several lengths with a common start or end, whose windows stand at the same places."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    head, tail = [word() for _ in range(20)], [word() for _ in range(18)]
    items = [(n, " ".join(head + [word() for _ in range(k)])) for n, k in enumerate((0, 6, 13))] + [(10 + n, " ".join([word() for _ in range(k)] + tail)) for n, k in enumerate((0, 3, 9))] + [(None, " ".join(word() for _ in range(12))), (None, items_text := " ".join(word() for _ in range(30)))]
    docs = [(d, " ".join([word() for _ in range(d)] + items[d % 8][1].split() + [word() for _ in range(3)] + items[(d + 3) % 8][1].split())) for d in range(16)] + [(99, items_text)]
    found = [(x.doc_id, x.item_id, round(x.similarity, 6)) for x in decontaminate.report(make([(d, t, "en", "a") for d, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = {}
    for n, (i, t) in enumerate(items):
        for (d, _), s in leaks(docs, [(n, t)]).items():
            want[d, i] = max(want.get((d, i), 0), round(s, 6))
    assert sorted(found, key=repr) == sorted(((d, i, s) for (d, i), s in want.items()), key=repr) and len(want) > 30


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_leaks_of_the_tables_equal_brute_force(spark, threshold):
    """Shuffled and broadcast joins alike; the brute force looks at documents that share a shingle with an item."""
    sf_dir = "/root/testdata/sf0.01"
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = {(x.doc_id, x.item_id): round(x.similarity, 6) for x in decontaminate.report(docs, items).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {k: round(v, 6) for k, v in leaks_of_sharers([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]).items()}
    assert found == want and len(want) > 20


def test_leak_edges(spark, make, edges):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.report(make(edges), none).count() == 0 and decontaminate.keep(make(edges), none).count() == len(edges)
    assert sorted(x.doc_id for x in decontaminate.report(make(edges, clash=True), some).collect()) == [1, 2]
    assert decontaminate.report(make([]), some).count() == 0


# -- licences


def scanned(text):
    low = (text or "").lower()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", low)
    found = [(m.start(), m.end(), p, n, label) for n, (label, p, k, rule) in enumerate(RULES) if k in flat for m in re.finditer(rule, flat, re.A)]
    inside = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[1] - e[0] == d[1] - d[0] and e[3] < d[3]))
    left = [d for d in found if not any(inside(d, e) for e in found)]
    score = max([0.6 if base else 0.0] + [STRENGTH[d[2]] for d in left])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in left})), score


TEXTS = [
    "Released under the MIT License. cc by cc by",
    "This work is licensed under the GNU General Public License, version 3. SPDX-License-Identifier: GPL-3.0-or-later",
    "mit   license, MIT\nlicense; Apache License, Version 2.0 and the apache license",
    "Licensed under CC BY-NC-SA 4.0 and http://creativecommons.org/licenses/by/4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that ... bsd 3-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. Copyright (c) 2020. All rights reserved.",
    "Mozilla Public License 2.0 or the Eclipse Public License - v 2.0, lgplv2.1+ agpl-3.0",
    "licensees and permitted uses of gnu and apache", "MITLicense mit-license mit_license mit.license 9mit license", "KK mit license İ é mit license", "",
]


def test_scan_equals_brute_force(make, edges):
    rows = [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)] + edges
    found = licenses.scan(make(rows, clash=True)).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.n_words): tuple(r)[1:] for r in found}
    for i, t, _, _ in rows:
        want = scanned(t)
        assert by[i, want[0]] == want, (i, t)
    assert licenses.scan(make([])).count() == 0


def test_rules_compile_and_hold_a_gate_word():
    assert len(RULES) >= 200
    for _, _, _, rule in RULES:
        re.compile(rule)


def forms(parsed):
    """Strings that a parsed regex matches: each way through its options and alternatives, with one character for each class of them."""
    found = [""]
    for op, x in parsed:
        match str(op):
            case "LITERAL":
                own = [chr(x)]
            case "AT" | "ASSERT" | "ASSERT_NOT":
                own = [""]
            case "ANY" | "NOT_LITERAL":
                own = ["~"]
            case "IN":
                own = [chr(v) if str(k) == "LITERAL" else "1" if str(v) == "CATEGORY_DIGIT" else "~" for k, v in x]
            case "MAX_REPEAT":
                own = ["".join(t) for n in {x[0], max(x[0], 1)} for t in itertools.product(forms(x[2]), repeat=n)]
            case "SUBPATTERN":
                own = forms(x[3])
            case "BRANCH":
                own = [s for b in x[1] for s in forms(b)]
            case _:
                raise ValueError(op)
        found = [a + b for a in found for b in own]
    return found


def test_every_match_of_a_rule_holds_its_keyword_and_a_gate_word():
    for _, _, keyword, rule in RULES:
        for s in forms(re._parser.parse(rule)):
            assert keyword in s and any(g in s for g in GATES), (rule, s)


def test_names_that_the_prefilters_missed(make):
    texts = ["MIT No Attribution", "BigScience Open RAIL", "CreativeML Open RAIL-M", "Beerware License", "You can redistribute it and/or modify it under the terms of the GNU General Public License"]
    got = {r.doc_id: r.labels for r in licenses.scan(make([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert got == {0: "mit-0", 1: "openrail", 2: "openrail", 3: "beerware", 4: "gpl"}
    assert [scanned(t)[5] for t in texts] == [got[i] for i in range(5)]


# -- HTML


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &lt;text&gt;\n here", "plain <text> here"),
        ("<body><nav><a>x</a></nav><article><h1>T</h1><p>One  two<br>three <b>four<p>five</article><footer>f</footer>", "T\n\nOne two three four\n\nfive"),
        ("<body><div id='m'><ul><li>a<li>b</ul><p>A longer paragraph of text, with a <a href=x>link</a> in it.</div><div class='sidebar'><p>Other things entirely</div>", "a\n\nb\n\nA longer paragraph of text, with a link in it."),
        ("<article><p>Body &amp; soul &#8212; &eacute;</p><form><p>Sign up</p></form><div class='comments'><p>Reader: nice</p></div><script>x<p>y</script><!-- c --></article>", "Body & soul — é"),
        ("<main><table><tr><td>1<td>2<tr><td>3</table><p>cut off he", "1\n\n2\n\n3\n\ncut off he"),
        ("<article><p>kept</p><p hidden>gone</p><p style='display: none'>gone</p><div role='complementary'>gone</div></article>", "kept"),
        ("<article><p>a < b and c > d</p><p>tail <b class='x", "a < b and c > d\n\ntail"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(source) == text


def test_density_finds_the_article_without_its_tag():
    page = "<body><div class=top><a>Home</a> <a>News</a> <a>Sport</a></div><div class=c><div>" + "".join(f"<p>Paragraph {i} says a good deal about its subject, at some length.</p>" for i in range(9)) + "</div></div><div class=links>" + "".join(f"<a>Link {i}</a>" for i in range(30)) + "</div></body>"
    got = html_text.main_text(page)
    assert got.count("\n\n") == 8 and "Link" not in got and "Home" not in got


def _paragraphs(*names):
    return "".join(f"<p>{(n + ' says a good deal about its subject. ') * 5}</p>" for n in names)


@pytest.mark.parametrize(
    "page, n",
    [
        ("<body><div>" + "".join(f"<div><div>{_paragraphs(*'abc'[:k])}</div></div>" for k in (3, 2, 3)) + "</div>", 8),
        ("<body><section>" + _paragraphs(*"ab") + "</section><section>" + _paragraphs(*"cde") + "</section>", 5),
        ("<body><article>" + _paragraphs(*"ab") + "</article><article>" + _paragraphs(*"cde") + "</article>", 5),
        ("<body><div><ul>" + "<li><a href=x>Menu</a>" * 9 + "</ul><div><div>" + _paragraphs(*"ab") + "</div></div><div><div>" + _paragraphs("c") + "</div></div></div>", 3),
        ("<body><h1>Title</h1><div>" + _paragraphs(*"ab") + "</div><div>Short line</div>", 4),
    ],
)
def test_sections_beside_the_densest_belong_to_the_text(page, n):
    got = html_text.main_text(page).split("\n\n")
    assert len(got) == n and "Menu" not in got


@pytest.mark.parametrize(
    "page, n",
    [
        *((f"<body><div class='{c}'><article>{_paragraphs(*'abc')}</article></div>", 3) for c in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "modal-page", "sidebar")),
        (f"<body><form><div>{_paragraphs(*'abc')}</div></form>", 3),
        (f"<body><form><main>{_paragraphs(*'abc')}<div class='share'>Share</div></main></form>", 3),
        (f"<body><article>{_paragraphs('a')}<section id='discussion'><h2>Discussion</h2>{_paragraphs('b')}</section><h2 id='related-work'>Work</h2><div id='search-methods'>{_paragraphs('c')}</div></article>", 5),
        (f"<body><div class='widget'>{_paragraphs('a')}</div><div class='widget'>{_paragraphs('b')}</div>", 2),
        (f"<body><article>{_paragraphs('a')}</article><div class='related-posts'><article>Teaser</article></div><div id='comments'><article>{_paragraphs(*'bcdefgh')}</article></div><div class='site-footer'>Footer</div>", 1),
        (f"<body><article>{_paragraphs('a')}<div class='ad-banner'>Buy</div><ul class='nav-menu'><li>Menu</ul><section class='discussion'><p>Reader: nice</section></article>", 1),
    ],
)
def test_names_and_forms_drop_no_article(page, n):
    assert len(html_text.main_text(page).split("\n\n")) == n


@pytest.mark.parametrize("name", ["legal", "share", "tags", "discussion", "related", "trending"])
def test_running_text_by_the_name_of_a_subject_stays(name):
    page = f"<body><div>{_paragraphs(*'ab')}<div class='{name}'>{_paragraphs('c')}</div></div><div class='{name}'><a>One</a> <a>Two</a></div>"
    got = html_text.main_text(page)
    assert len(got.split("\n\n")) == 3 and "One" not in got


def test_misleading_elements_dont_bind_the_text():
    # A teaser's article element and an empty main say nothing; density does.
    page = f"<body><main></main><div>{_paragraphs(*'abc')}</div><aside><article>Teaser</article></aside><div class='x'><article><a>More</a> <a>News</a></article></div>"
    assert len(html_text.main_text(page).split("\n\n")) == 3


@pytest.mark.parametrize("part", ["<div>", "</section>", "<b>", "<div></div>", "<li></li>", '<a "', "<i><div>", "</i>", "<td>", "<p>", "<![CDATA[", "<p style='", "<", "<tr>", "x=", "&#"])
def test_a_large_page_of_stray_tags_is_read_in_linear_time(part):
    took = []
    for lead in ("<div>", "<b>", "<i><div><b>"):
        source = lead * 3_000 + part * (100_000 // len(part))
        began = time.process_time()
        html_text.main_text(source)
        took.append(time.process_time() - began)
    assert max(took) < 10  # a few tenths of a second where nothing else runs; a quadratic walk takes minutes


def naive(node):
    """Characters, tags, characters in links and links under a node, by walking all of it."""
    chars = tags = link_chars = links = 0
    for c in node.children:
        if isinstance(c, str):
            chars += len(re.sub(r"\s+", " ", c).strip())
        elif not c.drop:
            n, t, k, a = naive(c)
            chars, tags, link_chars, links = chars + n, tags + t + 1, link_chars + k, links + a + (c.tag == "a")
    return chars, tags, chars if node.tag == "a" else link_chars, links


def test_density_sums_equal_a_naive_walk(small):
    import math

    import pyarrow.parquet as pq

    for page in pq.read_table(f"{small}/../sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        root = html_text.parse(page)
        html_text._settled(root)
        order = html_text._measured(root)
        body = next((x for x in order if x.tag == "body"), root)
        all_chars, _, all_links, _ = naive(body)

        def density(x):
            c, t, lc, lt = naive(x)
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * max(lc, 1) * (lc > 0) + (all_links / all_chars if all_chars else 0) * c + math.e)
            t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
            return c / t * math.log(max(c * t / (lc * lt), 1.0)) / math.log(base) if base > 1 else c / t

        for x in order:
            want = sum(density(c) for c in x.children if not isinstance(c, str) and not c.drop)
            own = sum(len(re.sub(r"\s+", " ", c).strip()) for c in x.children if isinstance(c, str))
            assert x.sum == pytest.approx(want + (own if x.tag not in html_text.INLINE else 0))


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (None, None, None, 6), (1, "u", "<p>a</p>", 7)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, html_text.extract(pages).collect()), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


# -- language


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 100


def test_language_equals_a_plain_form(make):
    """Letter by letter: rotated random vectors multiplied, added up, and the largest cosine."""
    import numpy as np

    docs = [(1, "the cat and the hat", "en"), (2, "der hund und der baum", "de"), (3, "Le chat, et le chien!", "fr"), (6, "cat 12 hat", None), (7, "über baum", "de"), (8, "ab", "en"), (9, "a", "fr"), (10, "the dog", "en"), (11, "x" * 50, None)]
    size = 256
    letter = lang_id.Bundler(size)._letter

    def bundle(text):
        plain, v = re.sub(r"[\W\d_]+", " ", f" {text.lower()} "), np.zeros(size)
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            if b != " ":
                v += np.roll(letter(0 if a == " " else ord(a)).astype(float), 2) * np.roll(letter(ord(b)).astype(float), 1) * letter(0 if c == " " else ord(c))
        return v

    free = [d for d in docs if d[2] and zlib.crc32(str(d[0]).encode()) % 5]
    unit = lambda v: v / np.linalg.norm(v)
    sums = {g: unit(sum(np.rint(unit(bundle(t)) * lang_id.UNIT) for _, t, x in free if x == g)) for g in {x for _, _, x in free}}
    for r in lang_id.identify(make([(i, t, g, "a") for i, t, g in docs]), dimensions=size).collect():
        text = next(t for i, t, _ in docs if i == r.doc_id)
        cosines = {g: float(unit(bundle(text)) @ v) for g, v in sums.items()}
        want = max(sorted(cosines), key=cosines.get)
        assert r.score == pytest.approx(max(0.0, cosines[want]), abs=1e-5)
        assert r.lang_pred == want or cosines[want] - cosines[r.lang_pred] < 1e-5


def test_language_edges(make, edges):
    found = lang_id.identify(make(edges + [(50, "1234 ... ٠", "en", "a")], clash=True)).collect()
    assert len(found) == len(edges) + 1 and all(0 <= r.score <= 1 for r in found)
    for r in found:
        if r.doc_id in (3, 4, 5, 50):
            assert r.lang_pred == "und" and r.score == 0
    assert {r.lang_pred for r in lang_id.identify(make([(1, "abc", None, None)])).collect()} == {"und"}
    assert lang_id.identify(make([])).count() == 0


# -- toxicity


def test_grammar_scores_clauses():
    lexicon = toxicity.Lexicon({"moron": 5.0, "verlor": 2.0})
    score = lambda t: dict(zip(toxicity.KINDS, toxicity.features(t, lexicon)))
    assert score("You are a moron.")["targeted"] > 0 and score("A moron, you see")["plain"] > 0
    assert score("he is not a moron")["negated"] > 0 and score("not this one, moron")["plain"] > 0
    assert score("She said moron")["reported"] > 0 and score("i will kill you")["threat"] > 0
    assert score("i will kill time")["threat"] == 0 and score("Verlorener Kram")["plain"] > 0
    assert score(None) == score("") == dict.fromkeys(toxicity.KINDS, 0.0)
    w = toxicity.PRIOR
    assert w[2] > w[1] > w[3]


@pytest.mark.parametrize("frame", ["_{}_", "2{}", "{}3", "__{}", "{}_", "x_{}_y", "²{}", "x{}", "{}x", "é{}"])
def test_gate_accepts_the_words_of_the_tokenizer(frame):
    lexicon = toxicity.Lexicon({"moron": 5.0, "idiot$": 2.0})
    for word in ("moron", "idiot", "kill"):
        text = "you " + frame.format(word)
        told = any(lexicon.classed(w)[0] in ("insult", "threat") for w in toxicity._WORD.findall(text))
        assert bool(lexicon.gate.search(text)) == told == any(toxicity.features(text, lexicon)), text


def kinds_by_definition(classes):
    """What the grammar must say of each word of a clause, from the whole clause."""
    out, target = [], "target" in classes
    for i, c in enumerate(classes):
        negated, told = "negation" in classes[max(0, i - toxicity.REACH) : i], "report" in classes[:i]
        if c == "insult":
            out.append("negated" if negated else "reported" if told else "targeted" if target else "plain")
        else:
            out.append("threat" if c == "threat" and target and not negated and not told else "")
    return out


def test_composed_transducers_equal_their_definition_on_all_short_clauses():
    for n in range(5):
        for classes in itertools.product(toxicity.CLASSES, repeat=n):
            (path,) = toxicity.GRAMMAR.paths(classes)
            assert [kind for kind, _ in path] == kinds_by_definition(classes) and all(w == 1.0 for _, w in path), classes


def test_composition_multiplies_weights_along_all_paths():
    a = toxicity.Transducer([0], [1], {(0, "x"): [("y", 0.5, 1), ("z", 2.0, 1)], (1, "x"): [("y", 3.0, 1)]})
    b = toxicity.Transducer(["s"], ["s"], {("s", "y"): [("Y", 10.0, "s")], ("s", "z"): [("Z", 7.0, "t")]})
    assert a.then(b).paths("xx") == [[("Y", 5.0), ("Y", 30.0)]] and a.then(b).paths("") == []
    assert sorted(a.paths("x")) == [[("y", 0.5)], [("z", 2.0)]]


def marked_texts(n, seed=4, framed=()):
    """Texts of made-up words, every eighth toxic by stems of several words each; `framed` words stand before a stem in clean ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfghjklm") + r.choice("aeiou") for _ in range(3))
    insult = lambda: r.choice(["zwackel", "quorfen"]) + r.choice(["", "en", "st", "ung", "ix"])
    rows, marks = [], []
    for i in range(n):
        w = [word() for _ in range(40)]
        if i % 8 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), insult())
        elif framed and i % 8 == 4:
            for f in framed:
                w += [".", f, insult(), "."]
        rows.append((i, " ".join(w) + ".", "en", "a"))
        marks.append((i, 1, int(i % 8 == 0)))
    return rows, marks


def test_toxicity_learns_and_generalises(make, labels):
    rows, marks = marked_texts(1500)
    lexicon, _ = toxicity.train(make(rows), labels(marks))
    assert set(lexicon.stems) == {"zwackel", "quorfen"}
    found = toxicity.score(make(rows, clash=True), labels(marks)).collect()
    assert all(r.predicted == marks[r.doc_id][2] for r in found) and any(r.held_out for r in found)


def test_negations_are_learned_from_their_context(make, labels):
    rows, marks = marked_texts(1500, framed=["niemand", "keinesfalls"])
    lexicon, weights = toxicity.train(make(rows), labels(marks))
    assert lexicon.negations >= {"niemand", "keinesfalls"}
    kinds = lambda t: {k for k, v in zip(toxicity.KINDS, toxicity.features(t, lexicon)) if v}
    assert kinds("niemand zwackelix hier") == {"negated"} and kinds("zwackelix hier") == {"plain"}
    found = toxicity.score(make(rows), labels(marks)).collect()
    assert all(r.predicted == marks[r.doc_id][2] for r in found if r.held_out)


def test_toxicity_of_held_out_documents(spark, small):
    sf_dir = f"{small}/../sf0.01"
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon, _ = toxicity.train(docs, marks)
    words = Counter(s for t in docs.toPandas().text for w in set(toxicity._WORD.findall((t or "").lower())) for s in {w + "$"} | {w[:k] for k in range(toxicity.SHORTEST, toxicity.LONGEST + 1)})
    # A stem is a whole word or the start of several.
    assert lexicon.stems and all(words[s] >= 3 for s in lexicon.stems)
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    found = [(r.predicted, truth[r.doc_id]) for r in toxicity.score(docs, marks).collect() if r.held_out and truth.get(r.doc_id) is not None]
    hits, toxic = sum(p for p, t in found if t), sum(t for _, t in found)
    assert hits >= 0.9 * toxic > 0 and sum(p for p, t in found if not t) <= 0.01 * len(found)


def test_toxicity_edges(make, labels, edges):
    found = toxicity.score(make(edges, clash=True), labels([(1, 1, 0), (1, 1, 1), (None, 1, 1), (6, None, None)])).collect()
    assert len(found) == len(edges) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in found)
    assert toxicity.score(make([]), labels([])).count() == 0


# -- chats


def test_chat_held_out(spark):
    rows = table(spark, "/root/testdata/sf0.01", "conversations")
    found = chat.format_chats(rows).join(rows.selectExpr("conv_id", "turn", "role as wanted", "text as original"), ["conv_id", "turn"])
    assert found.where("held_out").where("role = wanted").count() >= 0.95 * found.where("held_out").count() > 0
    r = found.first()
    assert r.rendered == f"<|{r.role}|>\n{r.text.strip()}\n<|end|>" and found.count() == rows.count()


def test_markers_without_training(spark):
    rows = spark.createDataFrame([(1, 0, "System: be brief\nUser: hi\nhow are you?\nAssistant: fine\nthanks"), (2, 0, "Q: what?\nA: that."), (2, 1, "[INST] more [/INST]")], "conv_id long, turn long, text string")
    got = sorted((r.conv_id, r.turn, r.part, r.role, r.text) for r in chat.parse(rows, chat.made({}, {})).collect())
    assert got[:5] == [(1, 0, 0, "system", "be brief"), (1, 0, 1, "user", "hi\nhow are you?"), (1, 0, 2, "assistant", "fine\nthanks"), (2, 0, 0, "user", "what?"), (2, 0, 1, "assistant", "that.")]


def test_chunks_decode_as_a_whole(spark, monkeypatch):
    r = random.Random(6)
    data = [(c, t, r.choice(["User: ", "", "Bot: ", ""]) + "word " * r.randrange(0, 60)) for c in range(3) for t in range(150)]
    rows = spark.createDataFrame(data, "conv_id long, turn long, text string")
    model = chat.made({("user", 1, 5): 40, ("assistant", 1, 8): 40, ("system", 1, 3): 5}, {("", "system"): 3, ("user", "assistant"): 30, ("assistant", "user"): 30})
    whole = {}
    for c in range(3):
        lines = [line for x, _, t in data if x == c for line in chat.observed(t)]
        whole[c] = [model.roles[s] for s in chat.viterbi(model, lines)]
    for size in (7, 64):
        monkeypatch.setattr(chat, "CHUNK", size)
        got = {}
        for x in sorted(chat.parse(rows, model).collect(), key=lambda x: (x.conv_id, x.turn, x.part)):
            got.setdefault(x.conv_id, []).append(x.role)
        assert got == whole


def best_path(model, lines):
    """The likeliest states, by trying all of them."""
    best = None
    for states in itertools.product(range(len(model.roles)), repeat=len(lines)):
        score, before = 0.0, model.start
        for step, state in zip(model.steps(lines), states):
            score, before = score + step[before, state], state
        if best is None or score > best[0] + 1e-9:
            best = score, list(states)
    return best


def test_viterbi_equals_all_paths_of_short_transcripts(spark):
    rows = table(spark, "/root/testdata/sf0.01", "conversations")
    model = chat.learn(rows)
    r = random.Random(8)
    real = [x.text or "" for x in rows.limit(60).collect()]
    texts = ["User: hi?", "no marker here\nBot: fine\nand more", "Q: what", "", "plain\n\nlines", "System: be brief"]
    for n in range(40):
        lines = [line for _ in range(r.randrange(1, 4)) for line in chat.observed(r.choice(texts if n % 2 else real))][:8]
        score, states = best_path(model, lines)
        got = chat.viterbi(model, lines)
        total, before = 0.0, model.start
        for step, state in zip(model.steps(lines), got):
            total, before = total + step[before, state], state
        assert total == pytest.approx(score)


def test_changes_are_counted_across_chunks(spark, monkeypatch):
    data = [(c, t, "user" if t % 2 else "assistant", f"text {t}") for c in range(10) for t in range(5, 25)]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    whole = chat.learn(rows)
    monkeypatch.setattr(chat, "CHUNK", 3)
    parts = chat.learn(rows)
    assert (whole.change == parts.change).all()


def test_chat_keys_of_other_types_and_rows_without_one(spark):
    data = [("a", 0, "User: hi"), ("a", 1, "Bot: yes"), (None, 0, "User: alone"), (None, 0, "Bot: too\nUser: end"), (None, None, None)]
    got = chat.parse(spark.createDataFrame(data, "conv_id string, turn int, text string"), chat.made({}, {})).collect()
    assert sorted((x.role, x.text) for x in got if x.text) == [("assistant", "too"), ("assistant", "yes"), ("user", "alone"), ("user", "end"), ("user", "hi")]
    assert {x.conv_id for x in got} == {"a", None} and len(got) == 6


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", ""), (None, None, None, "x"), (1, None, "odd", "y"), (1, 0, "user", "")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(rows).count() == 5 and chat.format_chats(rows.limit(0)).count() == 0
