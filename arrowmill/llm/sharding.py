"""Sharding by k-d tree partitioning (native).

A document is a point of three metadata dimensions: its source, its language
and the logarithm of its bytes. The tree starts with all documents and 40
shards' worth of bytes; a box of k shards is split along the dimension in which
its points spread widest, at the weighted median (weight: bytes; for odd k at
the quantile that leaves whole shards on both sides), until a box holds one
shard's bytes. So every shard is one box, or one box is one text (see below).
Points of equal metadata differ in a hash of the text, which stands behind each
coordinate and parts only ties.

A median is found by histograms of `BINS` bins: the bin in which it lies is cut
again until it holds one point or less than `EXACT` of a shard. Only these sums
reach the driver: at most `BINS` a box, and there are no more boxes than
shards, whatever the number of documents. The tree goes back into the plan as
literal arrays that a row walks from the root, so no rows are joined or moved.

Equal texts are one point, as rows of one text that differ in source or
language all count with the least of these, and stay in one shard. A text whose
copies alone weigh more than a shard is split on along a hash of doc_id, by
medians like any box, as no law of equal sizes could hold otherwise.

Edge cases: a null text weighs 16 bytes and has the CRC-32 of an empty one; null
and missing sources and languages are values like any other; repeated rows are
copies; an empty table has no rows; with fewer texts than shards some shards
stay empty. doc_id may be of any type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import settled, written

SHARDS = 40
BINS = 256
#: A median's last bin may hold this share of a shard.
EXACT = 0.001
DIMS = ("source", "lang", "size")
#: Rows that are numbered in one task.
SLOT_ROWS = 50_000
_VALUE = 31


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def points(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, th (a hash of the text), a code for source and lang, in 31 bits each, and `more`."""
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\x01"))), F.lit(1 << _VALUE)) if c in docs.columns else F.lit(0).cast("bigint")
    return docs.select("doc_id", (F.octet_length(_text()) + 16).cast("bigint").alias("size"), F.crc32(F.encode(_text(), "UTF-8")).alias("text_crc32"), F.xxhash64(_text()).alias("th"), code("source").alias("source"), code("lang").alias("lang"), *more)


def unlike(narrow: DataFrame) -> DataFrame:
    """th and the least source and lang of the texts that occur with several."""
    seen = narrow.groupBy("th").agg(*[f(c).alias(f"{k}_{c}") for c in ("source", "lang") for k, f in (("lo", F.min), ("hi", F.max))])
    return seen.where("lo_source <> hi_source or lo_lang <> hi_lang").select(F.col("th").alias("__th"), "lo_source", "lo_lang")


def placed_at(rows: DataFrame, several: DataFrame, *apart: str) -> DataFrame:
    """`rows` (th, source, lang, size, ...) with the coordinates x: in each the value in the upper and the hash in the lower bits; behind them a hash of the columns `apart`, which parts the rows of one text."""
    size = F.least(F.log2(F.col("size").cast("double")) / 48.0, F.lit(0.999))
    values = F.coalesce("lo_source", "source"), F.coalesce("lo_lang", "lang"), F.floor(size * float(1 << _VALUE)).cast("bigint")
    x = F.array(*[F.shiftleft(v, 32) + F.shiftrightunsigned("th", 32) for v in values], F.shiftrightunsigned(F.xxhash64(*apart), 1))
    return rows.join(several, F.col("th") == F.col("__th"), "left").withColumn("x", x).drop("__th", "lo_source", "lo_lang")


class Tree:
    """Splits by node: a dimension (-1: a leaf), a threshold, two children, and the shards from `first` on that it gets."""

    def __init__(self, shards: int) -> None:
        self.dim, self.at, self.left, self.first, self.shards, self.deep = [-1], [0], [0], [0], [shards], [0]

    def split(self, node: int, dim: int, at: int, below: int) -> tuple[int, int]:
        left = len(self.dim)
        self.dim[node], self.at[node], self.left[node] = dim, at, left
        for first, n in ((self.first[node], below), (self.first[node] + below, self.shards[node] - below)):
            for a, v in ((self.dim, -1), (self.at, 0), (self.left, 0), (self.first, first), (self.shards, n), (self.deep, self.deep[node] + 1)):
                a.append(v)
        return left, left + 1

    def walk(self) -> str:
        """SQL for the leaf of a row with coordinates x."""
        if len(self.dim) == 1:
            return "0"
        dim, at, left = (f"array({', '.join(f'{v}{t}' for v in a)})" for a, t in ((self.dim, ""), (self.at, "L"), (self.left, "")))
        return f"aggregate(sequence(1, {max(self.deep)}), 0, (n, i) -> if({dim}[n] < 0, n, {left}[n] + if(get(x, {dim}[n]) >= {at}[n], 1, 0)))"

    def shard(self) -> str:
        """SQL for the shard of a row with x; of a box of several shards, which only equal rows can be, the first."""
        return f"array({', '.join(map(str, self.first))})[{self.walk()}]"


def _medians(rows: DataFrame, tree: Tree, wanted: dict[int, tuple[int, int, int, float]], exact: float, bins: int) -> dict[int, tuple[int, int]]:
    """For each node (dimension, least and largest coordinate, bytes that should lie below): the cut and the bytes below it."""
    # Of a node in work: the interval in which its cut lies, the bytes below it, and the first coordinate behind it.
    work = {n: (lo, hi, 0, None) for n, (_, lo, hi, _) in wanted.items()}
    out: dict[int, tuple[int, int]] = {}
    while work:
        size = range(len(tree.dim))
        d, lo, step = (f"array({', '.join(str(f(n)) for n in size)})" for f in (lambda n: wanted[n][0] if n in work else -1, lambda n: f"{work[n][0]}L" if n in work else "0L", lambda n: f"{(work[n][1] - work[n][0]) // bins + 1}L" if n in work else "1L"))
        hi = f"array({', '.join(f'{work[n][1]}L' if n in work else '-1L' for n in size)})"
        at = rows.select("size", "x", F.expr(tree.walk()).alias("node")).where(F.expr(f"{d}[node] >= 0")).select("size", "node", F.expr(f"get(x, {d}[node])").alias("v")).where(F.expr(f"v between {lo}[node] and {hi}[node]"))
        found: dict[int, list] = {}
        for r in at.groupBy("node", F.expr(f"(v - {lo}[node]) div {step}[node]").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            found.setdefault(r["node"], []).append(r)
        for n, (_, _, below, after) in list(work.items()):
            target, got = wanted[n][3], sorted(found[n], key=lambda r: r["bin"])
            i = 0
            while i < len(got) - 1 and below + got[i]["bytes"] < target:
                below += got[i]["bytes"]
                i += 1
            after = got[i + 1]["lo"] if i + 1 < len(got) else after
            if got[i]["lo"] < got[i]["hi"] and got[i]["bytes"] > exact:
                work[n] = got[i]["lo"], got[i]["hi"], below, after
                continue
            # Before the bin or behind it, whichever comes nearer and leaves something on both sides.
            cuts = [(abs(below - target), got[i]["lo"], below)] * (below > 0) + [(abs(below + got[i]["bytes"] - target), after, below + got[i]["bytes"])] * (after is not None)
            out[n] = min(cuts)[1:]
            del work[n]
    return out


def grow(rows: DataFrame, shards: int = SHARDS, bins: int = BINS) -> Tree:
    """The tree over `rows` (size, x). What reaches the driver is bounded by open boxes, of which there are fewer than shards, times bins."""
    tree, open_, spread, share = Tree(shards), {0} if shards > 1 else set(), None, 0.0
    n_dims = len(DIMS)
    while open_:
        mark = f"array({', '.join('true' if n in open_ else 'false' for n in range(len(tree.dim)))})"
        ends = [f(F.col("x")[d]).alias(f"{k}{d}") for d in range(n_dims + 1) for k, f in (("lo", F.min), ("hi", F.max))]
        boxes = rows.select("size", "x", F.expr(tree.walk()).alias("node")).where(F.expr(f"{mark}[node]")).groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()
        value = lambda r, d: (r[f"hi{d}"] >> 32) - (r[f"lo{d}"] >> 32)
        if spread is None and boxes:
            spread, share = [max(value(boxes[0], d), 1) for d in range(n_dims)], boxes[0]["bytes"] / shards
        wanted, weight = {}, {}
        for r in boxes:
            d = max(range(n_dims), key=lambda d: value(r, d) / spread[d])
            d = d if r[f"lo{d}"] < r[f"hi{d}"] else n_dims  # one text, which outweighs a shard
            if r[f"lo{d}"] < r[f"hi{d}"]:
                n, k = r["node"], tree.shards[r["node"]]
                wanted[n], weight[n] = (d, r[f"lo{d}"], r[f"hi{d}"], r["bytes"] * (k // 2) / k), r["bytes"]
        open_ = set()
        for n, (at, below) in sorted(_medians(rows, tree, wanted, EXACT * share, bins).items()):
            k = tree.shards[n]
            # A heavy text may keep the cut off its place; the shards follow the bytes.
            for child in tree.split(n, wanted[n][0], at, min(k - 1, max(1, round(k * below / weight[n])))):
                if tree.shards[child] > 1:
                    open_.add(child)
    return tree


def slotted(rows: DataFrame, narrow: DataFrame, n_rows: int, piece: list[str], order: list[str], shards: int) -> DataFrame:
    """`rows` (shard, ...) with slot: gapless from 0 in each shard. Rows are numbered in pieces of a shard, told by a hash of the columns `piece`, behind the pieces before; `narrow` holds shard and `piece` of the same rows."""
    pieces = max(1, math.ceil(n_rows / shards / SLOT_ROWS))
    of = F.pmod(F.xxhash64(*piece), F.lit(pieces)).cast("int")
    counts = narrow.select("shard", of.alias("__p")).groupBy("shard", "__p").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("__s"), F.col("__p").alias("__q"), before.alias("__before"))
    numbered = rows.withColumn("__p", of).withColumn("__n", F.row_number().over(Window.partitionBy("shard", "__p").orderBy(*order)) - 1)
    return numbered.join(starts, (F.col("shard") == F.col("__s")) & (F.col("__p") == F.col("__q"))).withColumn("slot", (F.col("__before") + F.col("__n")).cast("bigint"))


def shard(docs: DataFrame, shards: int = SHARDS, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""

    def made() -> DataFrame:
        # Rows get numbers, which stay as the table is written, so that even equal rows fall into many pieces.
        narrow = written(points(docs).withColumn("n", F.monotonically_increasing_id()), "points")
        rows = written(placed_at(narrow, unlike(narrow), "doc_id", "n").select("doc_id", "size", "text_crc32", "n", "x"), "coordinates")
        told = rows.withColumn("shard", F.expr(grow(rows, shards, bins).shard()))
        out = slotted(told, told, rows.count(), ["n"], ["doc_id", "text_crc32", "n"], shards)
        return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

    return settled(made, "shards")


def free_name(name: str, taken: list[str]) -> str:
    """`name`, behind as many underscores as it takes not to clash."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def placed(docs: DataFrame, shards: int = SHARDS, bins: int = BINS) -> DataFrame:
    """`docs` with size, shard and slot, the same law as `shard`; where a column has such a name, ours gets an underscore before it.

    The tree is grown on narrow rows; texts move once, to their shard's pieces.
    """
    narrow = written(points(docs), "points")
    several = written(unlike(narrow), "several")
    rows = written(placed_at(narrow, several, "doc_id").select("doc_id", "size", "th", "x"), "coordinates")
    tree = grow(rows, shards, bins)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wide = placed_at(points(docs, row.alias("__row"), F.xxhash64(row).alias("__all")), several, "doc_id")
    told = wide.withColumn("shard", F.expr(tree.shard()))
    out = slotted(told, rows.withColumn("shard", F.expr(tree.shard())), rows.count(), ["doc_id", "th"], ["doc_id", "th", "__all"], shards)
    return out.select("__row.*", *[F.col(c).alias(free_name(c, docs.columns)) for c in ("size", "shard", "slot")])

