import math

import duckdb
import pytest

from arrowmill.llm import quality


def test_equals_the_sql(spark, small):
    from arrowmill.llm.common import table

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    ours = sorted(map(tuple, quality.assess(table(spark, small, "documents"), table(spark, small, "labels")).select(*names).collect()))
    assert ours == sorted(c.execute(f"SELECT {', '.join(names)} FROM ({quality.SQL})").fetchall())


def repeats(words):
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(5)}
    return len(covered)


def test_counts(make, labels, edges):
    rows = edges + [(20, "a b c d e f a b c d e g a b c d e", "en", "a"), (21, "x\nx\n \n\ny\nx |<#", "en", "a"), (22, "w " * 5000, "en", "a")]
    found = {(r.doc_id, r.n_words): r for r in quality.assess(make(rows, clash=True), labels([])).collect()}
    for i, text, _, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        r = found[i, len(words)]
        assert r.word_chars == sum(map(len, words)) and r.n_repeat_words == repeats(words)
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words)) and (not r.base_failed) == r.kept
    assert quality.assess(make([]), labels([])).count() == 0


@pytest.mark.parametrize("n, k", [(1, 0), (350, 0), (350, 3), (5000, 60), (200_000, 3200), (10, 9)])
def test_binomial_tail_is_exact(spark, n, k):
    p = quality.ALPHA
    got = spark.range(1).selectExpr(f"{quality.binomial_tail_sql(f'cast({n} as bigint)', f'cast({k} as bigint)', p)} as p").first().p
    if k >= n * p:
        assert got == 1.0
    else:
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
        assert got == pytest.approx(sum(math.exp(log(i)) for i in range(k + 1)), rel=1e-6)


def test_cutoffs_limit_false_rejections(make, labels):
    """A stratum with many clean labels gets cutoffs, one with few gets none; symbols that clean documents hold are spared."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu {}"
    rows = [(i, base.format(i), "en", "a") for i in range(3000)] + [(9000 + i, base.format(i) + " ### $$$ %%% ***", "en", "a") for i in range(50)] + [(8000 + i, base.format(i) + " ### $$$ %%% ***", "fr", "a") for i in range(50)]
    marks = [(i, 1, 0) for i in range(3000)] + [(8000 + i, 1, 0) for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality.assess(make(rows), labels(marks)).collect()}
    assert all(kept[i] for i in range(3000)) and not any(kept[9000 + i] for i in range(50)) and all(kept[8000 + i] for i in range(50))
    docs = make(rows, clash=True)
    out = quality.keep(docs, labels(marks))
    assert out.columns == docs.columns and out.count() == 3050


def test_cutoffs_in_several_strata_equal_the_sql(spark, make, labels):
    """Labels enough for cutoffs of several strengths: a clean stratum, one with some symbols and lines, one with too few labels, one without a language."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))

    def text(symbols, lines):
        w = [word() for _ in range(40)]
        return " ".join(w) + "#$" * symbols + "\nsame line" * lines

    rows, marks = [], []
    for lang, n, dirty in (("aa", 400, 0.0), ("bb", 700, 0.08), ("cc", 60, 0.0), (None, 300, 0.01)):
        for i in range(n):
            d = len(rows)
            bad = r.random() < dirty
            rows.append((d, text(r.randrange(4, 60) if bad else r.randrange(0, 2), r.randrange(2, 6) if bad else 0), lang, "a"))
            marks.append((d, 1, 0))
        for _ in range(60):  # unlabelled, and labelled as bad
            d = len(rows)
            rows.append((d, text(r.randrange(0, 120), r.randrange(0, 9)), lang, "a"))
            if d % 2:
                marks.append((d, 0, 0))
    rows += [(0, text(100, 9), "aa", "a"), rows[0], (None, text(50, 0), "aa", "a")]  # one labelled document, several rows
    docs, known = make(rows), labels(marks + [(0, 1, 0), (None, 1, 0)])
    cuts = {x.stratum: x for x in quality.calibrate(quality.with_features(docs), known).collect()}
    assert cuts["aa"].last > cuts["bb"].last >= 0 and cuts[""].last >= 0 and cuts["cc"].last == -1 and cuts["cc"].cut_symbols is None
    assert cuts["aa"].cut_symbols <= cuts["bb"].cut_symbols
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("labels", known.toPandas().astype("Int64"))
    ours = sorted(((x.doc_id, x.n_words, x.base_failed, x.kept) for x in quality.assess(docs, known).collect()), key=repr)
    theirs = sorted(c.execute(f"SELECT CAST(doc_id AS BIGINT), n_words, base_failed, kept FROM ({quality.SQL})").fetchall(), key=repr)
    assert ours == theirs and len({x[3] for x in ours}) == 2
    by_method = lambda lang: sum(not x[3] and not x[2] for x in ours if x[0] is not None and rows[x[0]][2] == lang)
    assert by_method("aa") > by_method("bb") > 0 and by_method(None) > 0 and by_method("cc") == 0
    # The pipeline's form, which computes features of labelled documents first, keeps the same rows.
    judged = quality.judge(quality.with_features(docs), quality.calibrate(quality.with_features(docs), known))
    assert sorted((repr(x.doc_id), x.text) for x in quality.keep(docs, known).collect()) == sorted((repr(x.doc_id), x.text) for x in judged.where("__kept").collect())
