"""The shared folder, tables that are deleted once read, and the map of fixed size."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from arrowmill.llm import common


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_the_named_folder_is_used(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_settled_leaves_the_result_alone(spark):
    at = f"{common.shared_dir(spark)}/tables"
    common.release(spark)
    kept = common.written(spark.range(3), "kept")
    out = common.settled(lambda: common.settled(lambda: common.written(spark.range(9), "a").where("id > 2"), "b").where("id > 4"), "c")
    assert sorted(r.id for r in out.collect()) == [5, 6, 7, 8] and kept.count() == 3
    assert sorted(x.split("-")[0] for x in os.listdir(at)) == ["c", "kept"]
    common.release(spark)
    assert os.listdir(at) == []


def test_among_clears_no_key_and_moves_nothing(spark):
    rows = spark.range(20_000).withColumn("t", F.concat(F.lit("x"), F.col("id"))).union(spark.sql("select cast(null as bigint), cast(null as string)"))
    keys = rows.where("id % 97 = 0").select(F.col("id").alias("a"), F.col("t").alias("b"))
    inside, outside = common.among(rows, ["id", "t"], keys), common.among(rows, ["id", "t"], keys, wanted=False)
    found = {r.id for r in inside.collect()}
    assert found >= {i for i in range(0, 20_000, 97)} and len(found) < 250
    assert inside.count() + outside.count() == 20_001 and inside.columns == rows.columns
    assert common.among(rows, ["id", "t"], keys.limit(0)).count() == 0 and common.among(rows, ["id", "t"], keys.limit(0), wanted=False).count() == 20_001
    # Rows stay where they are: what is shuffled are the keys' bits alone.
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
