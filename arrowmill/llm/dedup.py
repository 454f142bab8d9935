"""MinHash near-duplicates: circulant signatures, banding, exact verification, components.

A signature needs two permutations of the 32-bit hash space: sigma scatters the
shingles once, and coordinate k is the least pi(sigma(x) + k), that is pi
shifted circularly by k. 25 bands of 5 coordinates miss a pair at the threshold
of 0.85 with a chance of 4e-7.

Copies with equal shingle sets are folded into one node first. In the first
round each node is compared with the least node of one bucket, the one it shares
most buckets with: a group of m near copies costs m comparisons, not m * m.
Buckets that still hold more than one component go into a second round. There a
bucket's nodes are cut into pieces of bounded size by their number of shingles
and a hash. Two pieces meet in one task if their sizes allow the threshold and
not both lie in the bucket's largest component. A first pass over signatures
tells which nodes have a likely partner outside their component, each pair in
the first bucket it shares only; a second compares the whole shingle sets of
these. Both passes emit at most a row for each row they read, so no list of
pairs ever grows as a bucket's square. Signatures rule a linked pair out with a
chance of `MISS` at most, by the exact binomial tail. Links are confirmed on
whole shingle sets.

Components come from alternating large-star and small-star steps over the
links, each a distributed aggregation and join, until nothing changes; nothing
reaches the driver but counts.

A row is known by its doc_id and a hash of its text, so rows of one id with
different texts are told apart. doc_id may be of any type that can be ordered.

Edge cases: texts without words are linked with nothing; a null doc_id is
linked with nothing, has a null component and is kept; repeated rows of one id
and text count as one document, and each row gets its result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, settled, ships, written
from .shingles import Hasher, mix64

ships(__name__)

BANDS, ROWS = 25, 5
#: Percent that the intersection must be of the union.
THRESHOLD = 85
#: Chance at which signatures may rule out a pair at the threshold.
MISS = 1e-9
#: Nodes and shingles that a piece of a bucket holds, about.
PIECE_ROWS, PIECE_SHINGLES = 4096, 1 << 21
#: Pairs whose signatures are compared at a time.
TILE = 1 << 20

def _scatter(x: np.ndarray, shift: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """The finaliser of a 32-bit hash, a bijection, in place."""
    for s, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(s), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        if m:
            np.multiply(x, np.uint32(m), out=x)
    return x


def signatures(hashes: np.ndarray, places: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Circulant MinHash of each text that has shingles, as uint32 of shape (texts, bands * rows)."""
    starts = places[:-1][np.diff(places) > 0]
    out = np.zeros((len(starts), bands * rows), np.uint32)
    if not len(starts):
        return out
    sigma = ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    tmp, x = np.empty_like(sigma), np.empty_like(sigma)
    _scatter(sigma, sigma, tmp)
    for k in range(bands * rows):
        np.add(sigma, np.uint32(k), out=x)
        out[:, k] = np.minimum.reduceat(_scatter(x, x, tmp), starts)
    return out


def _signer(width: int, bands: int, rows: int):
    def sign(batches):
        import pyarrow as pa

        hasher = Hasher(width)
        for batch in batches:
            for a, b, hashes, places in hasher.batches(batch.column(2)):
                n = np.diff(places)
                full = n > 0
                sig = signatures(hashes, places, bands, rows)
                keys = np.zeros((len(sig), bands), np.uint64)
                for i in range(rows):
                    keys = mix64(keys * np.uint64(31) + sig[:, i::rows] + np.uint64(1))
                keys = mix64(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
                folded = []
                for seed in (0x51ED, 0xA5A5A5):
                    k = np.zeros(b - a, np.uint64)
                    if full.any():
                        k[full] = np.add.reduceat(mix64(hashes + np.uint64(seed)), places[:-1][full])
                    folded.append(k.view(np.int64))
                offsets = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
                rows_of = iter((sig & np.uint32(255)).astype(np.uint8))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(folded[0]), pa.array(folded[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())), pa.array([next(rows_of).tobytes() if f else None for f in full], pa.binary())],
                    names=["doc_id", "th", "n_shingles", "k1", "k2", "bands", "sig"],
                )

    return sign


def least_agreement(threshold: int, coordinates: int, miss: float = MISS) -> int:
    """How many coordinates of a pair at the threshold agree but for a chance of `miss`, by the exact binomial tail."""
    p, tail = threshold / 100, 0.0
    for k in range(coordinates + 1):
        tail += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if tail > miss:
            return k
    return coordinates


def _matrix(column, width: int) -> np.ndarray:
    """A binary column of equal widths as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _agreeing(threshold: int, coordinates: int):
    """Of the rows a, b, n, and two signatures, whether they may be linked."""
    need = least_agreement(threshold, coordinates)

    def agree(batches):
        import pyarrow as pa

        for batch in batches:
            alike = pa.array((_matrix(batch.column(3), coordinates) == _matrix(batch.column(4), coordinates)).sum(axis=1) >= need)
            yield pa.record_batch([*batch.columns[:3], alike], names=["a", "b", "n", "alike"])

    return agree


def _groups(batches):
    """Runs of rows with equal first three columns, as a key and the parts of batches that hold them."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(keys[a].tolist())
            if own != key and parts:
                yield key, parts
                parts = []
            key = own
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, parts


def _likely(threshold: int, coordinates: int, bands: int):
    """Of a group's rows those that may be linked with a row of another component on the other side."""
    need = least_agreement(threshold, coordinates)

    def run(batches):
        import pyarrow as pa

        for (key, u1, u2), parts in _groups(batches):
            table = pa.Table.from_batches(parts).combine_chunks()
            if table.num_rows < 2:
                continue
            side, node, c, n, tried = (table.column(i).to_numpy() for i in range(3, 8))
            sig = _matrix(table.column(8), coordinates)
            band = table.column(9).combine_chunks().flatten().to_numpy().reshape(-1, bands)
            first = np.flatnonzero(side == 0)
            second = first if u1 == u2 else np.flatnonzero(side == 1)
            hit = np.zeros(len(node), bool)
            wide = np.ascontiguousarray(sig[second].T)
            step = max(1, TILE // max(1, len(second)))
            for at in range(0, len(first), step):
                x = first[at : at + step]
                agree = np.zeros((len(x), len(second)), np.uint16)
                for k in range(coordinates):
                    agree += sig[x, k, None] == wide[k]
                likely = (agree >= need) & (c[x, None] != c[second]) & (100 * np.minimum(n[x, None], n[second]) >= threshold * np.maximum(n[x, None], n[second]))
                likely &= (tried[x, None] != node[second]) & (node[x, None] != tried[second])
                if u1 == u2:
                    likely &= np.arange(at, at + len(x))[:, None] < np.arange(len(second))
                i, j = np.nonzero(likely)
                for lo in range(0, len(i), TILE // 32):
                    p, q = x[i[lo : lo + TILE // 32]], second[j[lo : lo + TILE // 32]]
                    at_first = (band[p] == band[q]).argmax(axis=1)
                    here = band[p, at_first] == key
                    hit[p[here]] = hit[q[here]] = True
            if hit.any():
                chosen = np.flatnonzero(hit)
                k = len(chosen)
                yield pa.record_batch([pa.array(np.full(k, key)), pa.array(np.full(k, u1)), pa.array(np.full(k, u2)), pa.array(side[chosen]), pa.array(node[chosen]), pa.array(c[chosen])], names=["key", "u1", "u2", "side", "node", "c"])

    return run


def _find(root: dict, x: int) -> int:
    """The root of x, whose path is halved on the way."""
    while root.get(x, x) != x:
        root[x] = x = root.get(root[x], root[x])
    return x


def _linker(width: int, threshold: int, coordinates: int):
    """Links of the groups whose rows come with their texts, first side first; of the links between two components one.

    Only the first side's sets are held; of the second a slice of texts at a time.
    """
    need = least_agreement(threshold, coordinates)

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(width)
        now = None
        for batch in batches:
            g, u1, u2, side, nodes, labels = (batch.column(i).to_numpy() for i in range(6))
            sigs, links = _matrix(batch.column(6), coordinates), []
            for a, b, hashes, places in hasher.batches(batch.column(7)):
                for i in range(a, b):
                    if (key := (g[i], u1[i], u2[i])) != now:
                        now, held, node, label, root = key, [], [], [], {}
                        known, n = np.zeros((8, coordinates), np.uint8), np.zeros(8, np.int64)
                    own, m = hashes[places[i - a] : places[i - a + 1]], len(held)
                    if side[i] == 1 or u1[i] == u2[i]:
                        size = n[:m]
                        for j in np.flatnonzero(((known[:m] == sigs[i]).sum(axis=1) >= need) & (100 * np.minimum(size, len(own)) >= threshold * np.maximum(size, len(own)))).tolist():
                            x, y = _find(root, label[j]), _find(root, labels[i])
                            if x != y and linked(own, held[j], threshold):
                                root[x] = y
                                links.append((node[j], nodes[i]))
                    if side[i] == 0:
                        if m == len(n):
                            known, n = np.concatenate((known, np.zeros_like(known))), np.concatenate((n, np.zeros_like(n)))
                        known[m], n[m] = sigs[i], len(own)
                        held.append(own.copy())  # not a view that would hold the whole slice
                        node.append(nodes[i])
                        label.append(labels[i])
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = len(x) + len(y)
    merged = np.concatenate((x, y))
    merged.sort(kind="stable")
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return common > 0 and 100 * common >= threshold * (both - common)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) for every node of `edges` (a, b)."""

    def both_ways(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(edges)
    while True:
        und = both_ways(edges)
        least = und.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = und.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node's smaller neighbours, and itself, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, "edges")
        after = mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after

def _links(rows: DataFrame, reps: DataFrame, texts: DataFrame, linker) -> DataFrame:
    """The links (a, b) of `rows` (key, u1, u2, side, node, c). Only texts that a map can't rule out are moved; a row that repeats moves once from its partition."""
    known = rows.join(reps.select("node", "doc_id", "th", "sig"), "node")
    moved = among(texts, ["doc_id", "th"], known.select("doc_id", "th")).groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    keys = ["key", "u1", "u2"]
    ready = known.join(moved, ["doc_id", "th"]).select(*keys, "side", "node", "c", "sig", "text").repartition(*keys).sortWithinPartitions(*keys, "side")
    return written(ready.mapInArrow(linker, "a long, b long"), "links")


def _pieces(mixed: DataFrame, threshold: int) -> DataFrame:
    """The rows of buckets of several components (key, node, c, main, n) in each pair of pieces in which they stand: key, u1, u2, side, node, c.

    A piece's number holds whether it is of the main component, the class of
    its sizes and a count; sizes of unlike classes that don't touch can't reach
    the threshold.
    """
    rows = mixed.withColumn("rest", (F.col("c") != F.col("main")).cast("int")).withColumn("cl", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / threshold)).cast("int"))
    counted = rows.groupBy("key", "rest", "cl").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PIECE_ROWS), F.ceil(F.sum("n") / PIECE_SHINGLES)).cast("int").alias("pieces"))
    own = rows.join(counted, ["key", "rest", "cl"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")))
    other = counted.select(F.col("key").alias("k2"), F.col("rest").alias("r2"), F.col("cl").alias("cl2"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p2"))
    met = own.join(other, (F.col("key") == F.col("k2")) & (F.col("rest") + F.col("r2") > 0) & (F.abs(F.col("cl") - F.col("cl2")) <= 1))
    code = lambda rest, cl, piece: F.shiftleft(F.col(rest).cast("bigint"), 60) + F.shiftleft(F.col(cl).cast("bigint"), 44) + F.col(piece)
    coded = met.withColumn("x", code("rest", "cl", "piece")).withColumn("y", code("r2", "cl2", "p2"))
    return coded.select("key", F.least("x", "y").alias("u1"), F.greatest("x", "y").alias("u2"), (F.col("x") > F.col("y")).cast("int").alias("side"), "node", "c", "n")


def _components_of(docs: DataFrame, *, width: int, threshold: int, bands: int, rows: int) -> DataFrame:
    texts = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text")
    own_id = texts.schema["doc_id"].dataType
    long, coordinates = T.LongType(), bands * rows
    schema = T.StructType([T.StructField("doc_id", own_id)] + [T.StructField(c, long) for c in ("th", "n_shingles", "k1", "k2")] + [T.StructField("bands", T.ArrayType(long)), T.StructField("sig", T.BinaryType())])
    signed = written(texts.mapInArrow(_signer(width, bands, rows), schema), "signed")
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    # One node for each distinct set; copies are folded before anything is moved. Numbers stay as the table is written.
    folded = sets.groupBy("n_shingles", "k1", "k2").agg(F.min_by(F.struct("doc_id", "th", "bands", "sig"), F.struct("doc_id", "th")).alias("r"))
    reps = written(folded.select(F.monotonically_increasing_id().alias("node"), F.col("n_shingles").alias("n"), "k1", "k2", "r.doc_id", "r.th", "r.bands", "r.sig"), "reps")
    buckets = reps.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "lead")
    crowded = written(buckets.join(shared, "key").select("key", "node", "lead"), "buckets")
    votes = crowded.where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("m"))
    best = votes.groupBy("node").agg(F.max(F.struct("m", -F.col("lead"))).alias("v")).select((-F.col("v.col2")).alias("a"), F.col("node").alias("b"))
    of_rep = lambda k, *more: reps.select(F.col("node").alias(k), *more)
    signs = best.join(of_rep("a", F.col("sig").alias("sa")), "a").join(of_rep("b", "n", F.col("sig").alias("sb")), "b").select("a", "b", "n", "sa", "sb")
    best = written(signs.mapInArrow(_agreeing(threshold, coordinates), "a long, b long, n long, alike boolean"), "best")
    pairs = best.where("alike").select("a", "b", "n")
    # A lead with many partners meets them in pieces.
    leads = pairs.groupBy("a").agg(F.ceil(F.sum("n") / (2 * PIECE_SHINGLES)).alias("pieces"))
    role = lambda u1, side, node: (F.col("a").alias("key"), u1.cast("bigint").alias("u1"), F.lit(-1).cast("bigint").alias("u2"), F.lit(side).alias("side"), F.col(node).alias("node"), F.col(node).alias("c"))
    first = leads.select("a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p")).select(*role(F.col("p"), 0, "a"))
    second = pairs.join(leads, "a").select(*role(F.pmod(F.xxhash64("b"), F.col("pieces")), 1, "b"))
    linker = _linker(width, threshold, coordinates)
    found = components(_links(first.unionByName(second), reps, texts, linker))

    named = F.coalesce(F.col("component"), F.col("node"))
    held = crowded.select("key", "node").join(found, "node", "left").select("key", "node", named.alias("c"))
    parts = held.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
    mixed = written(held.join(main, "key").join(reps.select("node", "n"), "node"), "mixed")
    keys = ["key", "u1", "u2"]
    facts = reps.select("node", "sig", "bands").join(best.select(F.col("b").alias("node"), F.col("a").alias("tried")), "node", "left")
    met = _pieces(mixed, threshold).join(facts, "node").select(*keys, "side", "node", "c", "n", F.coalesce("tried", F.lit(-1)).alias("tried"), "sig", "bands")
    likely = written(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_likely(threshold, coordinates, bands), "key long, u1 long, u2 long, side int, node long, c long"), "likely")
    if not likely.isEmpty():
        more = _links(likely, reps, texts, linker)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    # A component is named by its least row.
    rows_of = found.join(reps.select("node", F.struct("doc_id", "th").alias("r")), "node")
    least = rows_of.groupBy("component").agg(F.min("r").alias("least"))
    named_reps = reps.select("n", "k1", "k2", "node", F.struct("doc_id", "th").alias("r")).join(rows_of.select("node", "component").join(least, "component").select("node", "least"), "node", "left")
    names = named_reps.select(F.col("n").alias("n_shingles"), "k1", "k2", F.coalesce("least", "r").alias("least"))
    joined = signed.select("doc_id", "th", "n_shingles", "k1", "k2").join(names, ["n_shingles", "k1", "k2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    own = lambda c: F.when(alone, F.col(c)).otherwise(F.col(f"least.{c}"))
    return joined.select("doc_id", "th", "n_shingles", own("doc_id").alias("component_id"), own("th").alias("component_th"))


def near_duplicates(docs: DataFrame, *, width: int = 3, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id and component_th (the least row of the component) of every row of `docs` (doc_id, text)."""
    return settled(lambda: _components_of(docs, width=width, threshold=threshold, bands=bands, rows=rows), "classes")


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; kept is true where doc_id is null or the text has no words."""
    found = near_duplicates(docs, **how).drop("th", "component_th")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, *, width: int = 5, threshold: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row of each component, that of the least doc_id (and least hash of its text), with the columns of `docs`.

    Rows without words or doc_id stay. Of rows that agree in doc_id and text one
    stays, the one of the least hash over all columns. Rows of one doc_id with
    unlike texts are judged each by its own text. Only rows that may be dropped
    are moved to be told apart exactly.
    """
    found = near_duplicates(docs, width=width, threshold=threshold, bands=bands, rows=rows).where("doc_id is not null")
    row = ["doc_id", "th"]
    doubtful = found.groupBy(*row).agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("doc_id", "th") != F.struct(F.col("component_id"), F.col("component_th"))).alias("goes")).where("goes or m > 1")
    doubtful = written(doubtful.select(F.col("doc_id").alias("__i"), F.col("th").alias("__h"), "goes"), "doubtful")
    told = docs.withColumn("__t", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    keys = doubtful.select("__i", "__h")
    sure = among(told, ["doc_id", "__t"], keys, wanted=False)
    unsure = among(told, ["doc_id", "__t"], keys).join(doubtful, (F.col("doc_id") == F.col("__i")) & (F.col("__t") == F.col("__h")), "left").where("not coalesce(goes, false)")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    single = unsure.where("goes is null").select(*docs.columns)
    repeated = unsure.where("goes is not null").select("doc_id", "__t", own, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all")).groupBy("doc_id", "__t").agg(F.min_by("__row", "__all").alias("__row"))
    return sure.select(*docs.columns).unionByName(single).unionByName(repeated.select("__row.*"))
