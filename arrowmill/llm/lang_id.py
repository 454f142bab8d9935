"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point. The vector of three letters binds them by multiplication after permuting
(rotating) the first two: order counts. A text is the bundle (sum) of its
trigram vectors, a language the bundle of the unit vectors of its sample, and
the prediction the language whose bundle has the largest cosine with the text.

A batch's texts are bundled at once: counts of distinct trigrams times their
vectors. Memory is bounded by slices of text, whatever the batch.

What is learned is bounded: at most `per_lang` documents of each language, the
first by a hash of doc_id among those outside the held-out fifth, and one
vector per language in the end. Language values are taken to be few (codes);
one vector of each reaches the driver.

Edge cases: null texts and texts without letters give `und` and score 0; a null
lang is not learned; a null doc_id counts as held out; without any language to
learn all predictions are `und`; a negative cosine scores 0; ties go to the
first value in code-point order; repeated rows get equal predictions; doc_id may
be of any type.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import ships, written
from .shingles import mix64

ships(__name__)

DIMENSIONS = 1024
PER_LANG = 500
#: Characters that are bundled at a time.
SLICE = 300_000
UNIT = 10_000
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 5 = 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Bundler:
    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.alpha = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)
        self.letters: dict[int, np.ndarray] = {}

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            words = mix64(mix64(np.array([code + 0xABCDEF], np.uint64)) + np.arange(self.dimensions // 64, dtype=np.uint64))
            self.letters[code] = np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letters[code]

    def _codes(self, text: str) -> np.ndarray:
        """Letters as code points, each other run of characters as one 0, with a 0 at both ends."""
        codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)[1:]
        fresh = codes[~self.known[codes]]
        for c in np.unique(fresh):
            self.known[c], self.alpha[c] = True, chr(c).isalpha()
        s = np.where(self.alpha[codes], codes, 0).astype(np.int64)
        return s[(s > 0) | np.concatenate(([True], s[:-1] > 0))]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of the texts, and which of them have a letter."""
        grams, owner = [], []
        for i, t in enumerate(texts):
            s = self._codes(t)
            if len(s) < 3:
                continue
            g = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
            g = g[s[1:-1] > 0]
            grams.append(g)
            owner.append(np.full(len(g), i))
        out = np.zeros((len(texts), self.dimensions), np.float32)
        some = np.zeros(len(texts), bool)
        if not grams:
            return out, some
        keys, at = np.unique(np.concatenate(grams), return_inverse=True)
        owner_ = np.concatenate(owner)
        some[owner_] = True
        for lo in range(0, len(keys), 4096):  # a block of distinct trigrams at a time
            block = keys[lo : lo + 4096]
            parts = [np.array([self._letter(int(c)) for c in (block >> shift) & 0x1FFFFF]) for shift in (42, 21, 0)]
            vectors = np.roll(parts[0], 2, axis=1) * np.roll(parts[1], 1, axis=1) * parts[2]
            here = (at >= lo) & (at < lo + 4096)
            counts = np.bincount(owner_[here] * len(block) + at[here] - lo, minlength=len(texts) * len(block)).reshape(len(texts), -1)
            out += counts.astype(np.float32) @ vectors.astype(np.float32)
        return out, some

    def slices(self, texts: list[str | None]):
        """First row, vectors and letter marks of slices with a bounded number of characters."""
        at, run, first = 0, [], 0
        for i, t in enumerate(texts):
            run.append(t or "")
            at += len(run[-1])
            if at >= SLICE or len(run) >= 256 or i == len(texts) - 1:
                yield first, *self.bundle(run)
                at, run, first = 0, [], i + 1


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _learner(dimensions: int):
    def learn(batches):
        import pyarrow as pa

        bundler, sums = Bundler(dimensions), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, vectors, some in bundler.slices(batch.column(1).to_pylist()):
                whole = np.rint(_unit(vectors) * UNIT).astype(np.int64)  # integers, so that sums don't depend on order
                for i in np.flatnonzero(some):
                    lang = langs[first + i]
                    sums[lang] = sums.get(lang, 0) + whole[i]
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "i", "v"])

    return learn


def prototypes(docs: DataFrame, *, dimensions: int = DIMENSIONS, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit vectors, from a bounded sample of documents with a language."""
    free = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ranked = free.select("lang", "doc_id").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    chosen = written(ranked.where(F.col("r") <= per_lang).select("lang", "doc_id").distinct(), "sample")
    sample = free.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", "text")
    rows = sample.mapInArrow(_learner(dimensions), "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in rows})
    at = {x: n for n, x in enumerate(langs)}
    out = np.zeros((len(langs), dimensions))
    for r in rows:
        out[at[r["lang"]], r["i"]] = r["v"]
    return langs, _unit(out).astype(np.float32)


def _predictor(langs: list[str], vectors: np.ndarray, dimensions: int):
    def predict(batches):
        import pyarrow as pa

        bundler = Bundler(dimensions)
        for batch in batches:
            names, scores = [], []
            for _, bundles, some in bundler.slices(batch.column(2).to_pylist()):
                cosines = _unit(bundles) @ vectors.T if len(langs) else np.zeros((len(bundles), 1))
                best = cosines.argmax(axis=1)
                for i, b in enumerate(best):
                    named = bool(some[i]) and len(langs) > 0
                    names.append(langs[b] if named else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(cosines[i, b]))) if named else 0.0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, *, dimensions: int = DIMENSIONS, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    langs, vectors = prototypes(docs, dimensions=dimensions, per_lang=per_lang)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predictor(langs, vectors, dimensions), T.StructType([*rows.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
