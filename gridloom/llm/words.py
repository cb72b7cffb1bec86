"""Words of many texts at once, as 64-bit hashes: NumPy over the bytes of an Arrow column.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return. These are
single bytes in UTF-8, so words are found in the bytes. The hash of a word is a polynomial over its bytes modulo 2^64
(from prefix sums, so no loop over words), then mixed. Equal words have equal hashes in every task and run.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_LETTERS = np.ones(256, bool)                       # ASCII without letters and digits; all else is part of a word
NOT_LETTERS[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_LETTERS[_a:_b] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20_24).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPREAD = np.random.default_rng(20_25).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept up to the usual size, a longer table is made anew."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= 1 << 21:
            _powers[base] = known
    return known[:n]


@dataclass
class Words:
    """Words of all texts in order. doc: text number; start, end: byte positions in `data`; bounds: first byte of each text, and the end."""
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def texts(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist())]


def text_bytes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins and the last one ends; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset:].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return (LOWER[data] if lower else data), bounds - bounds[0]


def find_words(column: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE) -> Words:
    """`gaps`: the bytes between words."""
    data, bounds = text_bytes(column, lower)
    gap = gaps[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True                                       # a text's first byte begins a word even right after another text
    before = np.concatenate([[True], gap])[:-1] if len(data) else gap
    start = np.flatnonzero(~gap & (before | first[:-1]))
    after = np.concatenate([gap, [True]])[1:] if len(data) else gap
    end = np.flatnonzero(~gap & (after | first[1:])) + 1
    return Words(data, bounds, start, end, np.searchsorted(bounds, start, "right") - 1, len(bounds) - 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers(_BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64) * U(0x2545F4914F6CDD1D))


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words inside one text, and the number of each run's first word."""
    many = len(hashes) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:many] == doc[n - 1:])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total += hashes[at + k] * _SPREAD[k]
    return mix(total), at


def whole_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's whole sequence of words (0 without words)."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, n), out=sums[1:])
    a, b = first[:-1], first[1:]
    return np.where(b > a, mix((sums[b] - sums[a]) * powers(_INVERSE, n + 1)[a] + (b - a).astype(np.uint64)), U(0))
