"""Helpers that the operators of this package share.

`let` binds a value inside a SQL expression so that it is evaluated once:
Catalyst may otherwise inline a column into a lambda and evaluate it for every
element. `written` cuts lineage with a table in the folder all executors share.
`among` finds the rows that a join may need by a map of fixed size.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a SQL literal's content.
WS = "' \\t\\n\\u000B\\u000C\\r'"
#: Words as the contracts define them: runs of anything but ASCII white space.
WORD_GAP = r"'[\\x20\\x09-\\x0D]+'"


def let(name: str, value: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_sql(text: str) -> str:
    """SQL for the array of words of `text` (null: no words)."""
    return let("_t", f"trim(BOTH {WS} FROM coalesce({text}, ''))", f"if(_t = '', cast(array() as array<string>), split(_t, {WORD_GAP}))")


def n_words_sql(text: str) -> str:
    """SQL for the number of words of `text` as a bigint, without a lambda."""
    trimmed = f"trim(BOTH {WS} FROM coalesce({text}, ''))"
    return f"cast(if({trimmed} = '', 0, size(split({trimmed}, {WORD_GAP}))) as bigint)"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local master, whose executors are this very process, may do without
    one and gets a folder of its own; a cluster without one is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="llm-shared-")
        atexit.register(shutil.rmtree, shared_dir.own, True)
    return shared_dir.own


#: Tables that this process has written.
_TABLES: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there and its size is known.

    Executors may be lost at any time afterwards; nothing of it lives on them.
    The table stays until `settled` around it has its result, `release`, or the
    end of the process, as results that nobody has read yet may need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What `make` gives, written; the tables that were written on the way are deleted."""
    before = len(_TABLES)
    out = written(make(), what)
    last = _TABLES.pop()
    release(out.sparkSession, before)
    _TABLES.append(last)
    return out


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written so far (from number `since` on); results made of them must have been read."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    while len(_TABLES) > since:
        path = path_of(_TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            release(spark)
    except Exception:  # the JVM may be gone already; the cluster's own cleaning of the folder then has to do
        pass


#: Bits of the map that tells which rows a join may need: 8 MB broadcast, whatever the number of keys.
MAP_BITS = 1 << 25
_PART = 32768


def _place(columns: list) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(MAP_BITS))


def among(rows: DataFrame, columns: list[str], keys: DataFrame, *, wanted: bool = True) -> DataFrame:
    """The rows whose `columns` may equal a row of `keys` (not `wanted`: surely don't), found without moving a row.

    The keys, which are as many columns of any names, set bits of a map of fixed
    size that is broadcast; a key whose bit is set by another passes too. The
    joins that follow are exact.
    """
    at = _place([F.col(c) for c in keys.columns])
    bits = keys.select(at.alias("__p")).groupBy(F.expr(f"__p div {_PART}").alias("__part")).agg(F.bitmap_construct_agg(F.col("__p") % _PART).alias("__map"))
    # As words of 32 bits, so that a test is a look into an array.
    words = bits.select("__part", F.expr(f"transform(sequence(0, {_PART // 32 - 1}), i -> cast(conv(hex(substring(__map, 4 * i + 1, 4)), 16, 10) as bigint))").alias("__map"))
    found = rows.withColumn("__p", _place([F.col(c) for c in columns])).join(F.broadcast(words), F.expr(f"__p div {_PART}") == F.col("__part"), "inner" if wanted else "left")
    bit = f"coalesce(shiftright(__map[cast(__p % {_PART} div 32 as int)], cast(24 - (__p % 32 div 8) * 8 + __p % 8 as int)) & 1L, 0L)"
    return found.where(f"{bit} = {int(wanted)}").select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ships(module: str) -> None:
    """Send the functions of `module` to executors by value, so that they needn't have this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])
