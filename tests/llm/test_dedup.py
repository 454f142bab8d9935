import random

import numpy as np
import pytest

from arrowmill.llm import dedup
from arrowmill.llm.shingles import Hasher


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, threshold):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed=3):
    """Groups of edited copies, chains of edits, exact copies in other letter case and white space, and strangers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(r.randrange(40, 160))]
        for _ in range(r.randrange(1, 12)):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t))
        chain = list(base)
        for _ in range(8):
            chain[r.randrange(len(chain))] = word()
            rows.append("\n".join(chain).upper())
    rows += ["", "  ", "hello", "Hello", "hello world", "HELLO\tworld ", "a b c", "a b c a b c"]
    r.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("width, threshold, bands, rows_", [(3, 85, 25, 5), (5, 80, 32, 4)])
def test_equals_brute_force(spark, width, threshold, bands, rows_):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.classes(docs, width=width, threshold=threshold, bands=bands, rows=rows_).collect()}
    assert found == brute(rows, width, threshold)


def test_small_pieces_give_the_same(spark, monkeypatch):
    """Texts that share a boilerplate, and so buckets, but aren't linked, beside groups that are; buckets are cut into many pieces."""
    monkeypatch.setattr(dedup, "PIECE_ROWS", 4)
    monkeypatch.setattr(dedup, "PIECE_SHINGLES", 600)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared, rows = [word() for _ in range(90)], copies(5)
    for _ in range(80):
        rows.append((len(rows) + 1000, " ".join(shared + [word() for _ in range(r.randrange(20, 60))])))
    for i in range(12):
        t = rows[-1 - i][1].split()
        t[-1] = word()
        rows.append((len(rows) + 2000, " ".join(t)))
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows, 3, 85)


def test_a_bucket_of_strangers_gives_bounded_rows():
    """However many likely pairs a bucket holds, each row is named once at most; none is where signatures differ or components agree."""
    import pyarrow as pa

    n, coordinates, bands = 3000, 20, 4
    r = np.random.default_rng(1)

    def rows(sig, c):
        band = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(np.tile([77, 1, 2, 3], n)))
        same = lambda v: pa.array(np.full(n, v))
        whole = pa.record_batch([same(77), same(5), same(5), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)), pa.array(c), same(100), same(-1), pa.array([x.tobytes() for x in sig], pa.binary()), band], names=["key", "u1", "u2", "side", "node", "c", "n", "tried", "sig", "bands"])
        parts = [whole.slice(i, 700) for i in range(0, n, 700)]
        return [x for b in dedup._likely(85, coordinates, bands)(parts) for x in b.column(4).to_pylist()]

    alike = np.zeros((n, coordinates), np.uint8)
    assert sorted(rows(alike, np.arange(n))) == list(range(n))
    assert rows(alike, np.zeros(n, np.int64)) == []
    assert rows(r.integers(0, 256, (n, coordinates)).astype(np.uint8), np.arange(n)) == []


def test_signatures_miss_no_more_than_stated():
    from math import comb

    for threshold, n in ((85, 125), (80, 128)):
        k = dedup.least_agreement(threshold, n)
        below = lambda k: sum(comb(n, i) * (threshold / 100) ** i * (1 - threshold / 100) ** (n - i) for i in range(k))
        assert below(k) <= dedup.MISS < below(k + 1)


def test_tables_equal_brute_force(spark, small):
    """All links of the 0.01 tables, found by counting common shingles."""
    from collections import Counter

    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    sets = {i: shingles(t, 3) for i, t in rows}
    places = {}
    for i, s in sets.items():
        for x in s:
            places.setdefault(x, []).append(i)
    common = Counter((a, b) for own in places.values() for n, a in enumerate(own) for b in own[n + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for (a, b), both in common.items():
        if 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)], links = min(x, y), links + 1
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in dedup.classes(docs).collect()}
    assert found == {i: (len(s), find(i)) for i, s in sets.items()} and links > 50


def test_keep_is_repeatable_and_tells_texts_of_one_id_apart(spark):
    one, other = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [("b", one, 1), ("b", other, 2), ("a", one, 3), ("c", other, 4), ("c", other, 5), ("d", None, 6), ("e", "", 7), ("e", "", 8), (None, one, 9), (None, one, 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, th int")
    first = sorted(map(tuple, dedup.keep(docs).collect()), key=repr)
    assert first == sorted(map(tuple, dedup.keep(docs.repartition(5)).collect()), key=repr)
    # Of `one` the row of a stays, of `other` that of b; of equal rows one; rows without an id all.
    assert sorted(((i, t) for i, t, _ in first if t in (one, other)), key=repr) == sorted([("a", one), ("b", other), (None, one), (None, one)], key=repr)
    assert sum(i == "e" for i, _, _ in first) == 1 and sum(i == "d" for i, _, _ in first) == 1
    assert dedup.classes(docs).count() == len(rows)


def test_edges(make, edges):
    found = dedup.classes(make(edges, clash=True)).collect()
    assert len(found) == len(edges)
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[2].component_id == by[1].component_id == 1 and not by[2].kept and by[1].kept
    for i in (3, 4, 5):
        assert by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept
    assert by[6].n_shingles == 59_998 and by[8].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert dedup.classes(make([])).count() == 0
    docs = make(edges, clash=True)
    kept = dedup.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8]


def test_components_settle_on_chains_and_stars(spark):
    pairs = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(2001, 2000), (2002, 2001), (2000, 2002)]
    found = {r.node: r.component for r in dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000, 2002: 2000}


def test_shingle_hashes_agree_with_sets():
    import pyarrow as pa

    texts = ["A b  c d", "a B c D", None, "", "x", "x y", "a b c d e", "a b c d a b c d"]
    got = []
    for a, b, hashes, places in Hasher(3).batches(pa.array(texts)):
        got += [frozenset(hashes[places[i] : places[i + 1]].tolist()) for i in range(b - a)]
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert len(got[i] & got[j]) == len(shingles(s, 3) & shingles(t, 3)), (s, t)


def test_signature_estimates_similarity():
    r = np.random.default_rng(5)
    x, y = r.integers(0, 1 << 63, 400).astype(np.uint64), r.integers(0, 1 << 63, 100).astype(np.uint64)
    a, b = np.sort(x), np.sort(np.concatenate((x[:300], y)))
    sig = dedup.signatures(np.concatenate((a, b)), np.array([0, 400, 800]), 200, 5)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.06
