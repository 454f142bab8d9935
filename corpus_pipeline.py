"""From raw documents to shards: quality rules, near-duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arrowmill.llm import decontaminate, dedup, mixing, quality, sharding
from arrowmill.llm.common import settled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that neither base limits nor admitted cutoffs reject; null and empty texts are too short."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates (five-word shingles, 0.8); rows without words or doc_id stay."""
    return dedup.keep(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item; each is judged by its own text, and null texts hold none."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them, up to three times; rows without words are not taken."""
    return mixing.draw(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, shard and slot; where a column has such a name already, ours gets an underscore before it."""
    return sharding.placed(docs)


STAGES = [("quality rules", quality_stage), ("near-duplicates", dedup_stage), ("benchmark leaks", leak_stage), ("source mix", mixing_stage), ("shards", sharding_stage)]

#: Sharding grows a tree, and near-duplicates form components; SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` through all stages. A stage's result is written once to the shared folder and read by the next; it and all that stages write on the way are deleted once the next result stands."""

    def after(make: Callable[[], DataFrame], name: str, stage: Callable) -> Callable[[], DataFrame]:
        return lambda: settled(lambda: stage(spark, make(), sf_dir), name.replace(" ", "-"))

    make = lambda: table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        make = after(make, name, stage)
    return make()
