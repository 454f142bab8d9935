"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. The
hash of a word is a polynomial over random values of its bytes, taken from
prefix sums of a whole batch; that of a shingle mixes the hashes of its words.
Two different shingles agree with a chance of about 2**-60.
"""

from __future__ import annotations

import numpy as np

from .common import ships

ships(__name__)

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_MIXERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at a time.
SLICE = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIXERS[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIXERS[1])
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Holds the tables; one per task."""

    def __init__(self, width: int = 3) -> None:
        self.width = width
        byte = np.arange(256)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.values = mix64(lower.astype(np.uint64) + np.uint64(0x1234567))
        self.space = (byte == 32) | ((byte >= 9) & (byte <= 13))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            for name, base in (("powers", _P), ("inverses", _P_INVERSE)):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of all texts, one after another, and the place where each text's begin (and the end)."""
        n_docs, base, end = len(offsets) - 1, int(offsets[0]), int(offsets[-1])
        data = data[base:end]
        n = len(data)
        none = np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
        if not n:
            return none
        self._grow(n)
        ink = ~self.space[data]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1] - base] = True  # a text's start parts words
        starts = np.flatnonzero(ink & (first[:n] | np.concatenate(([True], ~ink[:-1]))))
        ends = np.flatnonzero(ink & (np.concatenate((first[1:n], [True])) | np.concatenate((~ink[1:], [True])))) + 1
        if not len(starts):
            return none
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        words = mix64((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        of = np.searchsorted(offsets - base, starts, side="right") - 1
        bounds = np.searchsorted(of, np.arange(n_docs + 1))
        counts = np.diff(bounds)
        k = self.width
        rolled = [words]  # the hash of 1, 2, ... words
        for j in range(1, k):
            rolled.append(mix64(rolled[-1][: len(words) - j] * np.uint64(_P) + words[j:]))
        whole = np.flatnonzero(of[k - 1 :] == of[: len(of) - k + 1]) if len(of) >= k else np.zeros(0, np.int64)
        hashes, owner = rolled[k - 1][whole] if len(of) >= k else np.zeros(0, np.uint64), of[whole]
        for short in range(1, k):  # fewer words than a shingle has: the whole sequence is one
            at = np.flatnonzero(counts == short)
            if len(at):
                hashes, owner = np.concatenate((hashes, rolled[short - 1][bounds[at]])), np.concatenate((owner, at))
        if len(owner) and (np.diff(owner) < 0).any():
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
        places = np.searchsorted(owner, np.arange(n_docs + 1))
        for a, b in zip(places[:-1], places[1:]):
            if b - a > 1:
                hashes[a:b].sort()
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        return hashes[fresh], np.searchsorted(owner[fresh], np.arange(n_docs + 1))

    def batches(self, column):
        """Slices of an Arrow column of texts with a bounded number of bytes: first row, row after the last, hashes, places."""
        import pyarrow as pa

        column = column.cast(pa.large_string())
        n = len(column)
        if not n:
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            to = min(to, n)
            yield at, to, *self(data, offsets[at : to + 1])
            at = to
