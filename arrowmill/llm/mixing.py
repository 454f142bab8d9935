"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native).

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share all words; a target stops at three times its source and the excess is
shared again by weight. That is water filling: sources are capped in the order
of 3 * size / weight, so one ordered pass over the sources settles it.

Selection: an epoch takes a whole source; a source takes as many complete
epochs as its target holds, then part of one more. For that part each document
draws the key -ln(u) / w, with u a hash of the row and w its quality weight;
keys ascending are a weighted sample without replacement. The words are
prefix-summed in key order up to the budget left. The prefix sum needs no
sorted source: rows are counted into buckets of the key, bucket sums give the
bucket in which the budget ends, and only the rows of that one bucket are
ordered. What remains is one cutoff key per source, so the final pass is a map
over the documents joined with a table of one row per source.

Edge cases: a null text has size 0 and takes 0; a null source is a source; an
empty table gives no rows; rows that are equal in every input column share a
key, so they are taken or left together; the last document goes in if the sum
comes nearer to the budget with it. A source whose words are all 0 has target
0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import n_words_sql, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Rows of a source that one bucket of keys should hold.
BUCKET_ROWS = 50_000


def quality_weight(text: Column) -> Column:
    """1 for plain prose, falling to 0.1 as symbols rise to a sixth of the characters."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(6.0) * symbols.cast("double") / F.greatest(F.char_length(t), F.lit(1)).cast("double"))


def drawn(doc_id: Column, source: Column, text: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1) from 52 bits of a hash of the row and the seed."""
    none = F.lit("\x01")
    row = F.concat_ws("\x00", F.lit(seed), F.coalesce(doc_id.cast("string"), none), F.coalesce(source, none), F.coalesce(text, none))
    return (F.conv(F.substring(F.md5(row), 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key: all that later passes need of a document."""
    key = -F.log(drawn(F.col("doc_id"), F.col("source"), F.col("text"), seed)) / quality_weight(F.col("text"))
    return docs.select("doc_id", "source", F.expr(n_words_sql("text")).alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, target. `sizes` has one row per source; it is ordered in one task, texts never are."""
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1))
    room = (F.lit(most) * F.col("source_size")).cast("bigint")
    order = Window.orderBy(room / F.col("w"), F.col("source").asc_nulls_last())
    rest = ranked.withColumn("room", room).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    # Before this source: the words that capped sources take, and the weight that this and later ones have.
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = rest.withColumn("left", F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("onward", F.sum("w").over(onward))
    capped = level.withColumn("capped", F.col("room") * F.col("onward") <= F.col("left") * F.col("w"))
    # The first source that isn't capped sets the level for all after it.
    free = F.min(F.when(~F.col("capped"), F.struct(room / F.col("w"), "source", "left", "onward"))).over(Window.partitionBy())
    share = (F.col("free.left") * F.col("w")).cast("double") / F.col("free.onward").cast("double")
    target = F.when(F.col("capped") | F.col("free").isNull(), F.col("room").cast("double")).otherwise(F.least(F.col("room").cast("double"), share))
    return capped.withColumn("free", free).select("source", "source_size", "n", target.alias("target"))


def plan(narrow: DataFrame, **how) -> DataFrame:
    """One row per source: source, source_size, target, epochs and the last key taken in the part after them (null: none)."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = written(
        targets(sizes, **how)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS)),
        "targets",
    )
    # Weights lie in [0.1, 1], so 1 - exp(-key) spreads keys over (0, 1), in their order.
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("buckets"))
    rows = narrow.where("size > 0").join(goal.where("budget > 0").select(F.col("source").alias("__s"), "buckets", "budget"), F.col("source").eqNullSafe(F.col("__s"))).select("source", "size", "key", "budget", bucket.alias("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ends = sums.withColumn("upto", upto).where("upto >= budget").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("at"))
    ends = ends.select(F.col("source").alias("__s"), F.col("at.bucket").alias("__b"), F.col("at.before").alias("before"))
    last = rows.join(ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    keys = last.groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("budget").alias("budget"))
    run = keys.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("key")))
    # Take the key that crosses the budget if that comes nearer than stopping before it.
    fits = run.where(F.col("upto") - F.col("budget") <= F.col("budget") - (F.col("upto") - F.col("words")))
    within = fits.groupBy("source").agg(F.max("key").alias("cut")).select(F.col("source").alias("__c"), "cut")
    start = sums.join(ends, F.col("source").eqNullSafe(F.col("__s"))).where("bucket < __b").groupBy("source").agg(F.max("bucket").alias("full")).select(F.col("source").alias("__f"), "full")
    done = goal.select("source", "source_size", "target", "epochs", "buckets").join(within, F.col("source").eqNullSafe(F.col("__c")), "left").join(start, F.col("source").eqNullSafe(F.col("__f")), "left").drop("__c", "__f")
    return written(done, "mix")


def _times(docs: DataFrame, made: DataFrame) -> DataFrame:
    """How often each document is taken, as __times; docs needs size and key."""
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("buckets"))
    extra = F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)) | F.coalesce(bucket <= F.col("full"), F.lit(False))
    return docs.join(made.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("__times", F.col("epochs") + F.when(extra & (F.col("size") > 0), 1).otherwise(0))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    narrow = written(keyed(docs, seed), "sizes")
    return _times(narrow, plan(narrow, **how)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__times")).alias("taken"))


def draw(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mixed documents: the rows of `docs`, each as often as it is taken, with the columns of `docs`."""
    made = plan(written(keyed(docs, seed), "sizes"), **how).select("source", "epochs", "buckets", "cut", "full")
    key = -F.log(drawn(F.col("doc_id"), F.col("source"), F.col("text"), seed)) / quality_weight(F.col("text"))
    facts = F.struct(F.expr(n_words_sql("text")).alias("size"), key.alias("key")).alias("__f")
    extra = F.coalesce(F.col("__f.key") <= F.col("__m.cut"), F.lit(False)) | F.coalesce(F.floor((F.lit(1.0) - F.exp(-F.col("__f.key"))) * F.col("__m.buckets")) <= F.col("__m.full"), F.lit(False))
    rows = docs.withColumn("__f", facts).join(made.select(F.col("source").alias("__s"), F.struct("epochs", "buckets", "cut", "full").alias("__m")), F.col("source").eqNullSafe(F.col("__s")), "left")
    times = F.col("__m.epochs") + F.when(extra & (F.col("__f.size") > 0), 1).otherwise(0)
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


SQL = rf"""WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(concat_ws(chr(0), '{SEED}', coalesce(doc_id::VARCHAR, chr(1)), coalesce(source, chr(1)), coalesce(text, chr(1)))), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u,
    greatest(0.1::DOUBLE, 1.0::DOUBLE - 6.0::DOUBLE * length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS w
  FROM documents),
keyed AS (SELECT doc_id, coalesce(source, chr(1114111)) AS s, size, -ln(u) / w AS key FROM d),
src AS (SELECT s, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS w FROM keyed GROUP BY s),
ranked AS (SELECT *, 3 * source_size AS room, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER (ORDER BY 3 * source_size / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM src),
free AS (SELECT lft, onward FROM ranked WHERE room * onward > lft * w ORDER BY room / w, s LIMIT 1),
goal AS (SELECT s, source_size, CASE WHEN (SELECT count(*) FROM free) = 0 OR room * onward <= lft * w THEN room::DOUBLE
  ELSE least(room::DOUBLE, ((SELECT lft FROM free) * w)::DOUBLE / (SELECT onward FROM free)::DOUBLE) END AS target FROM ranked),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goal),
runs AS (SELECT k.doc_id, k.s, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
  sum(k.size) OVER (PARTITION BY k.s ORDER BY k.key) AS upto, sum(k.size) OVER (PARTITION BY k.s, k.key) AS tied FROM keyed k JOIN parts p USING (s))
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN budget > 0 AND size > 0 AND upto - budget <= budget - (upto - tied) THEN 1 ELSE 0 END))::BIGINT AS taken FROM runs"""
