import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators themselves use.
CLASHING = ("n_words", "size", "shard", "slot", "key", "x", "score", "kept", "labels", "component_id", "similarity", "h", "target", "taken")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source); with `clash`, extra columns of the operators' names."""

    def docs(rows, clash=False):
        df = spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows], DOCS)
        for c in CLASHING if clash else ():
            df = df.selectExpr("*", f"'mine' as {c}")
        return df

    return docs


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def edges():
    """Nulls everywhere, empty, blank, very long and equal texts, repeated rows."""
    long = " ".join(f"word{i}" for i in range(60_000))
    return [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (2, "one two three four five six seven eight nine ten eleven", None, None),
        (3, None, "en", "a"),
        (4, "", "de", None),
        (5, " \t\n\x0b\x0c\r ", None, "b"),
        (None, "a null id with a text of its own that is long enough to be kept here", "en", "b"),
        (None, None, None, None),
        (6, long, "en", "b"),
        (7, "ünïcode   ß \U0001f600   text", "de", "c"),
        (8, "x" * 200_000, "en", "c"),
    ]
