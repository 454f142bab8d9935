"""The pipeline against a plain version of its stages, and its edge cases."""

import os
import sys
from collections import Counter

import duckdb

import corpus_pipeline
from arrowmill.llm import mixing, quality, sharding
from arrowmill.llm.common import table, written

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_dedup import brute
from test_mixing_sharding import kd_boxes
from test_text import leaks_of_sharers


def test_equals_a_plain_version(spark, small, monkeypatch):
    monkeypatch.setattr(sharding, "EXACT", 0.0)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark leaks", "source mix", "shards"]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW labels AS SELECT * FROM '{small}/labels.parquet'")
    documents = table(spark, small, "documents")
    rows = {r.doc_id: r for r in documents.collect()}
    frame = documents.toPandas()
    c.register("documents", frame)
    kept = {i for (i,) in c.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    classes = brute([(i, rows[i].text) for i in sorted(kept)], 5, 80)
    single = {i for i, (_, least) in classes.items() if i == least}
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    leaked = {d for d, _ in leaks_of_sharers([(i, rows[i].text) for i in sorted(single)], items)}
    clean = single - leaked
    assert rows.keys() > kept > single > clean
    c.unregister("documents")
    c.register("documents", frame[frame.doc_id.isin(clean)])
    times = {i: taken // size for i, size, taken in c.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall() if taken}
    found = corpus_pipeline.run(spark, small).collect()
    assert Counter(r.doc_id for r in found) == Counter(times)
    assert all(tuple(r)[: len(documents.columns)] == tuple(rows[r.doc_id]) for r in found)
    narrow = sharding.points(documents.where(documents.doc_id.isin(list(times))))
    placed = {r.doc_id: tuple(r["x"][:3]) for r in sharding.placed_at(narrow, sharding.unlike(narrow), "doc_id").collect()}
    want = kd_boxes([(len(rows[i].text.encode()) + 16, placed[i]) for i in times for _ in range(times[i])], 40)
    for r in found:
        first, k = want[placed[r.doc_id]]
        assert first <= r.shard < first + k
    for s in {r.shard for r in found}:
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))


def test_stages_with_nulls_repeated_rows_and_clashing_columns(spark, small, make, edges):
    good = [(100 + i, " ".join(f"word{(i * 37 + j * j) % 997}" for j in range(30)), "en", "ab"[i % 2]) for i in range(40)]
    docs = make(edges + good + good[:3], clash=True)
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, small), f"stage{i}")
        assert docs.columns[: len(columns)] == columns and (i == 4) == (len(docs.columns) > len(columns))
        assert all(r["size"] == "mine" and r["shard"] == "mine" for r in docs.select("size", "shard").distinct().collect())
    ids = {r.doc_id for r in docs.collect()}
    assert len(ids & {100 + i for i in range(40)}) > 20
    assert docs.columns[-3:] == ["_size", "_shard", "_slot"]


def test_stages_of_an_empty_table(spark, small, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
