"""Benchmark decontamination (native).

A benchmark item of m words is looked for in windows of m words. Each window
that can matter has a 64-bit SimHash of its words; fingerprints are cut into
`radius + 1` blocks, and a window meets an item where any block of theirs is
equal. By the pigeonhole principle that finds every item within the radius,
which is then checked, and what remains is verified exactly: the similarity of
the weighted five-word shingles (weight: a shingle's count) must reach 0.8.

A window that shares no shingle with an item can't reach any similarity with
it, so windows are only laid where one is shared, aligned to the shingle's
places in the item; that loses nothing. A window is compared with the item that
laid it, so windows of items of other lengths at the same place don't mix.

Documents are scanned in place: a map of fixed size tells which of their
shingles may be the benchmark's, and only these are moved, as a number and a
hash. Where windows were laid the text is looked up afterwards. No side is
broadcast but the map; whether the tables of the benchmark are small enough to
be is for Catalyst to tell by their size, and beyond that the same joins are
shuffled.

Edge cases: null and empty texts and items match nothing; an item of fewer than
five words is one shingle; windows at a text's end are cut there;
items that repeat are found each, a null item_id too; rows of one doc_id are
judged each by its own text and reported together, repeated rows once; a null
doc_id can't be reported but is dropped by `keep` all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, let, words_sql, written

WIDTH = 5
LEAST = 0.8
BITS = 64
RADIUS = 24


def _hashed(text: str) -> str:
    """SQL for the word hashes of `text`: runs of letters and digits, lower-cased, so that a copy's punctuation doesn't matter."""
    plain = rf"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ')"
    return f"transform({words_sql(plain)}, w -> xxhash64(w))"


def _shingles(h: str, width: int) -> str:
    """SQL for the hashes of the shingles of `width` words of the word hashes `h`, in order."""
    parts = ", ".join(f"{h}[i + {k}]" if k else f"{h}[i]" for k in range(width))
    return f"if(size({h}) >= {width}, transform(sequence(0, size({h}) - {width}), i -> xxhash64({parts})), cast(array() as array<bigint>))"


def simhash_sql(h: str) -> str:
    """SQL for the SimHash of the word hashes `h`: each bit is the majority of the words' bits."""
    bit = f"if(aggregate({h}, 0, (s, x) -> s + if((shiftrightunsigned(x, b) & 1L) = 1L, 1, -1)) > 0, shiftleft(1L, b), 0L)"
    return f"aggregate(transform(sequence(0, {BITS - 1}), b -> {bit}), 0L, (s, x) -> s | x)"


def blocks_sql(f: str, radius: int = RADIUS) -> str:
    """SQL for (block number, value) of the radius + 1 blocks of a fingerprint."""
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return "array({})".format(", ".join(f"named_struct('no', {i}, 'value', shiftrightunsigned({f}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(edges, edges[1:]))))


def prepared(items: DataFrame) -> DataFrame:
    """A number, item_id, m, width, word hashes, shingles and fingerprint of the items that have words; equal ones of one item_id are one."""
    hashed = items.select("item_id", F.expr(_hashed("coalesce(text, '')")).alias("h")).where("size(h) > 0").dropDuplicates()
    short = " ".join(f"when size(h) = {k} then {_shingles('h', k)}" for k in range(1, WIDTH))
    # Items have numbers of their own, which stay as the table is written: item_id may be null or repeat.
    return written(hashed.selectExpr("monotonically_increasing_id() as item", "item_id", "h", "size(h) as m", f"least({WIDTH}, size(h)) as width", f"case {short} else {_shingles('h', WIDTH)} end as s", f"{simhash_sql('h')} as f"), "items")


def _weighted(a: str, b: str) -> str:
    """SQL for the weighted Jaccard of two arrays of shingles: sum of smaller counts over sum of larger counts.

    Both are sorted once; a merge by a running pointer counts the common part.
    """
    common = "aggregate(x, named_struct('j', 0, 'n', 0), (s, v) -> " + let(
        "j", "aggregate(sequence(s.j, size(y)), s.j, (k, i) -> if(k < size(y) and k = i and y[k] < v, k + 1, k))", "named_struct('j', if(j < size(y) and y[j] = v, j + 1, j), 'n', s.n + if(j < size(y) and y[j] = v, 1, 0))"
    ) + ", s -> s.n)"
    both = let("c", common, "cast(c as double) / (size(x) + size(y) - c)")
    return let("x", f"sort_array({a})", let("y", f"sort_array({b})", both))


def matches(docs: DataFrame, items: DataFrame, *, key: list[str], radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """key, item_id, start and similarity of each verified window of `docs` (key, text); `key` names columns that tell rows of unlike texts apart."""
    known = prepared(items)
    places = written(known.select("item", "m", "width", F.posexplode("s").alias("at", "s")), "places")
    hashed = docs.select(*key, F.expr(_hashed("coalesce(text, '')")).alias("h"))
    # Bounded: distinct widths are 1 to 5. What a place holds of the document ends here: its number and its shingle.
    found = None
    for width in sorted(r[0] for r in known.select("width").distinct().collect()):
        own = places.where(F.col("width") == width).select("item", "m", "at", F.col("s").alias("__s"))
        rolled = hashed.select(*key, F.expr("size(h)").alias("n"), F.posexplode(F.expr(_shingles("h", width))).alias("p", "v"))
        # A map of fixed size leaves the places that may hold a shingle of the benchmark; the join after it is exact.
        met = among(rolled, ["v"], own.select("__s").distinct()).join(own, F.col("v") == F.col("__s"))
        starts = met.select(*key, "item", "m", "n", "p", F.expr("p - at").alias("start"))
        found = starts if found is None else found.unionByName(starts)
    if found is None:
        return docs.where(F.lit(False)).select(*key, F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    # Each window of a document stands once for an item, however many shingles lead to it. One that the text's end cuts off is laid from its first shared shingle, too.
    aligned = found.groupBy(*key, "item", "m", "start").agg(F.min("p").alias("p"), F.max("n").alias("n"))
    laid = written(aligned.select(*key, "item", "m", F.explode(F.expr("if(p + m > n, array(greatest(start, 0), p), array(greatest(start, 0)))")).alias("start")).distinct(), "laid")
    rows = among(docs.select(*key, "text"), key, laid.select(*key)).groupBy(*key).agg(F.first("text").alias("text")).select(*key, F.expr(_hashed("coalesce(text, '')")).alias("h"))
    windows = laid.join(rows, key).select(*key, "item", "start", F.expr("slice(h, start + 1, m)").alias("w")).withColumn("f", F.expr(simhash_sql("w")))
    windows = written(windows, "windows")
    blocks = known.select("item", F.col("f").alias("__f"), F.inline(F.expr(blocks_sql("f", radius))).alias("no", "value"))
    cut = windows.select(*key, "item", "start", "f", F.inline(F.expr(blocks_sql("f", radius))).alias("no", "value"))
    near = cut.join(blocks, ["item", "no", "value"]).where(F.expr(f"bit_count(f ^ __f) <= {radius}")).select(*key, "item", "start").distinct()
    sides = near.join(windows.select(*key, "item", "start", "w"), [*key, "item", "start"]).join(known.select("item", "item_id", "width", "s"), "item")
    of_window = " ".join(f"when width = {k} then {_shingles('w', k)}" for k in range(1, WIDTH))
    return sides.withColumn("similarity", F.expr(_weighted(f"case {of_window} else {_shingles('w', WIDTH)} end", "s"))).where(F.col("similarity") >= least).select(*key, "item_id", "start", "similarity")


def _told(docs: DataFrame, *columns: str) -> DataFrame:
    """`docs` with a hash that tells texts apart."""
    return docs.select(*columns, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__text"), "text")


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, the place of the best window (words, from 0) and its similarity, for every document that holds an item."""
    found = matches(_told(docs.where("doc_id is not null"), "doc_id"), items, key=["doc_id", "__text"], **how)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("place"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.place")).cast("long").alias("start_word"), F.col("b.similarity").alias("similarity"))


def keep(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows that hold no item, with the columns of `docs`; they are told apart by a hash of their text.

    Only rows that a map can't clear are moved to be told apart exactly.
    """
    leaks = written(matches(_told(docs), items, key=["__text"], **how).select("__text").distinct(), "leaks")
    tagged = docs.withColumn("__text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    unsure = among(tagged, ["__text"], leaks).join(leaks, "__text", "left_anti")
    return among(tagged, ["__text"], leaks, wanted=False).unionByName(unsure.select(*tagged.columns)).select(*docs.columns)
