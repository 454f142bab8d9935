import zlib

import duckdb
import pytest

from arrowmill.llm import mixing, sharding
from arrowmill.llm.common import table


def test_mix_equals_the_sql(spark, small):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    ours = sorted(map(tuple, mixing.mix(table(spark, small, "documents")).select(*names).collect()))
    assert ours == sorted(c.execute(f"SELECT {', '.join(names)} FROM ({mixing.SQL})").fetchall())


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("counts", [{"a": 5, "b": 300, "c": 400, "d": 7}, {"a": 1, "b": 1, None: 900}, {"z": 50}, {"a": 100, "b": 100, "c": 100, None: 100}])
def test_targets_and_takes(make, counts):
    rows, n = [], 0
    for s, k in counts.items():
        for i in range(k):
            rows.append((n, " ".join(["w"] * (1 + (n * 7) % 13)), "en", s))
            n += 1
    found = mixing.mix(make(rows, clash=True)).collect()
    again = mixing.mix(make(rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)
    source = {i: s for i, _, _, s in rows}
    sizes = {s: sum(r.size for r in found if source[r.doc_id] == s) for s in counts}
    goals = filled(sizes)
    for s in counts:
        own = [r for r in found if source[r.doc_id] == s]
        assert own[0].target == pytest.approx(goals[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - goals[s]) <= max(r.size for r in own)
        times = {r.taken // r.size for r in own}
        assert max(times) <= 3 and max(times) - min(times) <= 1 and all(r.taken % r.size == 0 for r in own)
    drawn = mixing.draw(make(rows, clash=True))
    assert drawn.columns == make([], clash=True).columns and drawn.count() == sum(r.taken // r.size for r in found)


def test_mix_edges(make, edges):
    found = mixing.mix(make(edges, clash=True)).collect()
    assert len(found) == len(edges) and all(r.taken <= 3 * r.size for r in found)
    assert mixing.mix(make([])).count() == 0 and mixing.draw(make([])).count() == 0


def test_many_buckets_give_the_same(make, monkeypatch):
    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 2]) for i in range(600)]
    one = sorted((r.doc_id, r.taken) for r in mixing.mix(make(rows)).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 17)
    assert one == sorted((r.doc_id, r.taken) for r in mixing.mix(make(rows)).collect())


def checked(rows, found, shards):
    assert len(found) == len(rows)
    for s in range(shards):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    for r in found:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None


def test_shards_are_even_and_keep_copies_together(make):
    rows = [(i, f"text {i} " * (1 + (i * i) % 40), "en", "a") for i in range(3000)] + [(5000 + i, "the same text again", "en", "b") for i in range(250)]
    found = sharding.shard(make(rows, clash=True)).collect()
    checked(rows, found, 40)
    loads = [sum(r.size for r in found if r.shard == s) for s in range(40)]
    assert max(loads) < 1.05 * min(loads)
    texts = {i: t for i, t, _, _ in rows}
    for r in found:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert len({r.shard for r in found if r.doc_id >= 5000}) == 1


def test_copies_beyond_a_shard_are_spread(make):
    rows = [(i, "hot copy " * 5, "en", "a") for i in range(1200)] + [(5000 + i, f"other {i} " * 5, "en", "b") for i in range(1200)]
    found = sharding.shard(make(rows)).collect()
    loads = [sum(r.size for r in found if r.shard == s) for s in range(40)]
    assert max(loads) < 1.1 * (sum(loads) / 40)
    # Equal rows of one document and text, too.
    again = sharding.shard(make([(1, "hot copy " * 5, "en", "a")] * 1200 + rows[1200:])).collect()
    loads = [sum(r.size for r in again if r.shard == s) for s in range(40)]
    assert len(again) == 2400 and max(loads) < 1.1 * (sum(loads) / 40)


def kd_boxes(points, shards):
    """Shards of (bytes, coordinates, group) by a k-d tree over sorted lists, for points without ties beyond a group."""
    spread = [max(1, max(x[d] >> 32 for _, x in points) - min(x[d] >> 32 for _, x in points)) for d in range(3)]
    out = {}

    def split(own, first, k):
        if k == 1 or len({x for _, x in own}) == 1:
            out.update((x, (first, k)) for _, x in own)
            return
        wide = [(max(x[d] >> 32 for _, x in own) - min(x[d] >> 32 for _, x in own)) / spread[d] for d in range(3)]
        d = wide.index(max(wide))
        whole = sum(s for s, _ in own)
        sums = {}
        for s, x in own:
            sums[x[d]] = sums.get(x[d], 0) + s
        best, below = None, 0
        for v, after in zip(sorted(sums), sorted(sums)[1:]):
            below += sums[v]
            best = min(best or (float("inf"),), (abs(below - whole * (k // 2) / k), after, below))
        k1 = min(k - 1, max(1, round(k * best[2] / whole)))
        split([p for p in own if p[1][d] < best[1]], first, k1)
        split([p for p in own if p[1][d] >= best[1]], first + k1, k - k1)

    split(points, 0, shards)
    return out


def test_shards_equal_a_brute_force_tree(spark, make, small, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", 0.0)
    docs = table(spark, small, "documents")
    narrow = sharding.points(docs)
    rows = sharding.placed_at(narrow, sharding.unlike(narrow), "doc_id").collect()
    want = kd_boxes([(r["size"], tuple(r["x"][:3])) for r in rows], 40)
    at = {(r.doc_id, r.text_crc32): want[tuple(r["x"][:3])] for r in rows}
    for r in sharding.shard(docs).collect():
        first, k = at[r.doc_id, r.text_crc32]
        assert first <= r.shard < first + k


def test_shard_edges(make, edges, monkeypatch):
    checked(edges, sharding.shard(make(edges, clash=True)).collect(), 40)
    assert sharding.shard(make([])).count() == 0
    docs = make(edges, clash=True)
    out = sharding.placed(docs)
    # Columns of our names keep their values; ours are renamed.
    assert out.columns == [*docs.columns, "_size", "_shard", "_slot"]
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sharding.placed(make([])).columns == [*make([]).columns, "size", "shard", "slot"]
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    rows = [(i, f"t {i}", "en", "a") for i in range(900)]
    checked(rows, sharding.shard(make(rows)).collect(), 40)
