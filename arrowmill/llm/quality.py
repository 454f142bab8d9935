"""Quality rules with risk-controlled cutoffs (native).

Every document gets four counts. Base limits reject documents that are too
short or mostly repetition. Beyond them three rules ("too many symbols", "too
many repeated lines", "too many repeated word windows") have cutoffs from lax to
strict, which one fixed walk tightens in turn: step 3 * j + r brings rule r to
its cutoff number j. Labelled clean documents decide how far the walk goes in a
stratum (a language): a step is admitted only if the exact binomial tail shows,
at the corrected level, that all cutoffs so far together reject at most `alpha`
of the clean documents. The walk stops at the first step that fails, so its
steps need no correction (fixed-sequence testing) and strata share `delta`
(Bonferroni): with a chance of 1 - delta no stratum loses more than alpha of its
clean documents.

Edge cases: a null or empty text has no words and fails the base limits; a null
language is a stratum of its own; a stratum with too few labels admits no
cutoff, so only base limits apply there; repeated rows are judged one by one,
but a labelled document is one trial whatever its rows, that of the row which
is rejected first; labels that disagree about a document count as not clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WS, among, let, words_sql, written

RULES = ("symbols", "lines", "windows")
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
STEPS = len(RULES) * len(CUTOFFS)
WINDOW = 5
ALPHA, DELTA = 0.02, 0.05
NO_LANGUAGE = ""


def _covered(h: str) -> str:
    """SQL: how many words lie in windows whose hash occurs twice or more in `h`."""
    same = "(i > 0 and s[i - 1].x = e.x) or (i + 1 < size(s) and s[i + 1].x = e.x)"
    starts = f"sort_array(transform(filter(s, (e, i) -> {same}), e -> e.p))"
    step = f"(a, p) -> named_struct('c', a.c + least({WINDOW}L, p - a.q), 'q', p)"
    count = f"aggregate({starts}, named_struct('c', 0L, 'q', cast(-{WINDOW} as bigint)), {step}, a -> a.c)"
    return let("s", f"sort_array(transform({h}, (x, i) -> named_struct('x', x, 'p', cast(i as bigint))))", count)


def features_sql(text: str) -> str:
    """SQL for a struct of the counts of one text; all of it runs in the row, without a shuffle."""
    window = ", ".join(f"v[i + {k}]" if k else "v[i]" for k in range(WINDOW))
    hashes = f"if(size(v) >= {WINDOW}, transform(sequence(0, size(v) - {WINDOW}), i -> xxhash64({window})), cast(array() as array<bigint>))"
    repeats = let("v", "transform(w, x -> xxhash64(x))", let("h", hashes, f"if(size(array_distinct(h)) = size(h), 0L, {_covered('h')})"))
    of_words = f"named_struct('n_words', cast(size(w) as bigint), 'word_chars', cast(char_length(array_join(w, '')) as bigint), 'n_repeat_words', {repeats})"
    lines = f"filter(split(coalesce({text}, ''), '\\n'), x -> trim(BOTH {WS} FROM x) <> '')"
    of_lines = "named_struct('n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint))"
    symbols = f"cast(char_length(regexp_replace(coalesce({text}, ''), '[^#*$%&|<>]+', '')) as bigint)"
    return f"named_struct('w', {let('w', words_sql(text), of_words)}, 'l', {let('l', lines, of_lines)}, 'n_symbols', {symbols})"


def with_features(docs: DataFrame, text: str = "text", to: str = "__q") -> DataFrame:
    """`docs` with one more column, a flat struct of counts, shares of the rules and base_failed."""
    raw = f"{to}0"
    f = f"`{raw}`"
    base = f"({f}.w.n_words < 10 or 100 * {f}.w.n_repeat_words > 20 * {f}.w.n_words)"
    share = lambda a, b: f"cast({f}.{a} as double) / cast(greatest({f}.{b}, 1L) as double)"
    flat = (
        f"named_struct('n_words', {f}.w.n_words, 'word_chars', {f}.w.word_chars, 'n_symbols', {f}.n_symbols, 'n_dup_lines', {f}.l.n_dup_lines,"
        f" 'n_repeat_words', {f}.w.n_repeat_words, 'base_failed', {base}, 'symbols', {share('n_symbols', 'w.word_chars')},"
        f" 'lines', {share('l.n_dup_lines', 'l.n_lines')}, 'windows', {share('w.n_repeat_words', 'w.n_words')})"
    )
    return docs.withColumn(raw, F.expr(features_sql(f"`{text}`"))).withColumn(to, F.expr(flat)).drop(raw)


def _ln_factorial(x: str) -> str:
    """SQL for ln(x!) by Stirling's series, shifted so that the series is exact to about 1e-13."""
    z = f"(cast({x} as double) + 11.0D)"
    low = " * ".join(f"(cast({x} as double) + {k}.0D)" for k in range(1, 11))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1.0D / (12.0D * {z}) - 1.0D / (360.0D * {z} * {z} * {z}) - ln({low}))"


def binomial_tail_sql(n: str, k: str, p: float) -> str:
    """SQL for P(X <= k), X ~ Binomial(n, p); 1 where k is at or above the mean.

    Below the mean the terms shrink downwards from k, so a sum over some
    deviations is exact to rounding; no array grows with n but by its root.
    """
    q = 1 - p
    top = f"exp({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')} + {k} * ln({p}D) + ({n} - {k}) * ln({q}D))"
    last = f"cast(greatest(0.0D, {k} - 60.0D - 9.0D * sqrt({n} * {p}D)) as bigint)"
    step = f"(a, i) -> named_struct('t', a.t * i * {q}D / (({n} - i + 1) * {p}D), 's', a.s + a.t * i * {q}D / (({n} - i + 1) * {p}D))"
    below = f"if({k} > {last}, sequence({k}, {last} + 1, -1L), cast(array() as array<bigint>))"
    return f"if({k} >= {n} * {p}D, 1.0D, {top} * aggregate({below}, named_struct('t', 1.0D, 's', 1.0D), {step}, a -> a.s))"


def clean(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that labels agree to be of good quality."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("ok")).where("ok = 1").select("doc_id")


def first_step(q: str = "__q") -> str:
    """SQL for the number of the first step that rejects a document with features `q`; from STEPS on: none does."""
    cuts = f"array({', '.join(f'{c}D' for c in CUTOFFS)})"
    return "least({})".format(", ".join(f"{len(RULES)} * size(filter({cuts}, c -> c >= `{q}`.{r})) + {i}" for i, r in enumerate(RULES)))


def calibrate(featured: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, q: str = "__q") -> DataFrame:
    """One row per stratum with the last step admitted (-1: none) and the cutoff that it gives each rule (null: none).

    Only counts leave the executors' partitions: per stratum and step.
    """
    narrow = featured.select("doc_id", F.coalesce(F.col(stratum), F.lit(NO_LANGUAGE)).alias("stratum"), F.expr(first_step(q)).alias("first"))
    # One trial a document, whatever its rows: the one that is rejected first.
    trials = narrow.join(clean(labels), "doc_id").groupBy("doc_id").agg(F.min(F.struct("first", "stratum")).alias("t"))
    counts = trials.groupBy("t.stratum", "t.first").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy("stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("first", "n")).alias("at"))  # at most STEPS + 3 entries
    tests = grid.select("stratum", "n", "at", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step")).select("stratum", "n", "step", F.expr("aggregate(filter(at, e -> e.first <= step), 0L, (a, e) -> a + e.n)").alias("k"))
    # One row; its broadcast has a proven bound.
    strata = counts.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    passed = tests.join(F.broadcast(strata)).withColumn("ok", F.expr(binomial_tail_sql("n", "k", alpha)) <= F.lit(delta) / F.col("strata"))
    run = passed.withColumn("ok", F.min("ok").over(Window.partitionBy("stratum").orderBy("step")))
    last = run.groupBy("stratum").agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("step"))), F.lit(-1)).alias("last"))
    cut = lambda i: F.expr(f"get(array({', '.join(f'{c}D' for c in CUTOFFS)}), cast(floor((last - {i}) / {len(RULES)}) as int))")
    return last.select("stratum", "last", *[F.when(F.col("last") >= i, cut(i)).alias(f"cut_{r}") for i, r in enumerate(RULES)])


def judge(featured: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang", q: str = "__q", to: str = "__kept") -> DataFrame:
    """`featured` with a boolean: true if neither base limits nor a step admitted for its stratum reject the document."""
    cuts = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("last").alias("__last"))
    joined = featured.join(cuts, F.coalesce(F.col(stratum), F.lit(NO_LANGUAGE)) == F.col("__stratum"), "left")
    # One condition over both sides: a part that reads the features alone would be pushed below the join and compute them a second time.
    return joined.withColumn(to, F.expr(f"if(`{q}`.base_failed, false, not coalesce({first_step(q)} <= __last, false))")).drop("__stratum", "__last")


def assess(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; one scan of the texts."""
    narrow = written(with_features(docs.select("doc_id", "text", "lang")).select("doc_id", "lang", "__q"), "quality")
    judged = judge(narrow, written(calibrate(narrow, labels, **how), "cutoffs"))
    q = [F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return judged.select("doc_id", *q, F.col("__kept").alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows that pass, with the columns of `docs`, repeated ones each.

    Cutoffs come from the labelled documents, found by a map of fixed size, so
    that the texts of all others are read once.
    """
    cuts = written(calibrate(with_features(among(docs, ["doc_id"], clean(labels))), labels, **how), "cutoffs")
    return judge(with_features(docs), cuts).where("__kept").select(*docs.columns)


_WORD = r"[^\x20\x09-\x0D]+"

FEATURES_SQL = rf"""
    SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           n_symbols::DOUBLE / greatest(word_chars, 1) AS symbols,
           n_dup_lines::DOUBLE / greatest(n_lines, 1) AS lines,
           n_repeat_words::DOUBLE / greatest(n_words, 1) AS windows
    FROM (
      SELECT *, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce((SELECT count(DISTINCT p + o) FROM (
                 SELECT unnest(ps) AS p FROM (SELECT list(i) AS ps FROM (SELECT i, list_slice(ws, i, i + 4) AS win FROM range(1, len(ws) - 3) r(i)) GROUP BY win HAVING count(*) > 1)
               ), range(0, 5) f(o)), 0)::BIGINT AS n_repeat_words
      FROM (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM {{docs}})
    )"""

CUTS_SQL = f"""
    cuts(cut) AS (VALUES {", ".join(f"({c}::DOUBLE)" for c in CUTOFFS)}),
    steps AS (SELECT *, least(3 * (SELECT count(*) FROM cuts WHERE cut >= symbols), 3 * (SELECT count(*) FROM cuts WHERE cut >= lines) + 1, 3 * (SELECT count(*) FROM cuts WHERE cut >= windows) + 2) AS first FROM feats),
    clean AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    trials AS (SELECT coalesce(lang, '') AS stratum, first FROM steps JOIN clean USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first, coalesce(lang, '')) = 1),
    tests AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (first <= step) AS k FROM trials, range(0, {STEPS}) r(step) GROUP BY ALL),
    tails AS (SELECT *, CASE WHEN k >= n * {ALPHA!r} THEN 1.0 ELSE (
        SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA!r}) + (n - i) * ln({1 - ALPHA!r}))) FROM range(0, k + 1) r(i)) END AS p FROM tests),
    runs AS (SELECT *, bool_and(p <= {DELTA!r} / (SELECT count(DISTINCT stratum) FROM trials)) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM tails),
    picked AS (SELECT stratum, max(step) AS last FROM runs WHERE ok GROUP BY ALL)"""

KEPT_SQL = """NOT f.base_failed AND NOT EXISTS (SELECT 1 FROM picked p WHERE p.stratum = coalesce(f.lang, '') AND f.first <= p.last)"""

SQL = f"""WITH feats AS ({FEATURES_SQL.format(docs="documents")}), {CUTS_SQL}
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, {KEPT_SQL} AS kept FROM steps f"""
