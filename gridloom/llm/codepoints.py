"""From code points to bytes and back, for many UTF-8 texts at once, by a sparse index of exceptions.

Only characters of several bytes are recorded: where they stand, in code points, and how many bytes beyond one they and
those before them take. A position between them is its code point plus the excess so far, found by a binary search; a stretch of
ASCII costs nothing. Positions count on through all texts, so one search serves them together.
"""
from __future__ import annotations

import numpy as np


class CodePoints:
    """Index of texts whose bytes `data` stand one after the other, cut at `bounds`."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)                     # first bytes of characters of two, three or four
        size = data[lead]
        self.excess = np.zeros(len(lead) + 1, np.int64)         # bytes beyond one a character, of the first k exceptions
        np.cumsum(1 + (size >= 0xE0).astype(np.int64) + (size >= 0xF0), out=self.excess[1:])
        self.at = lead - self.excess[:-1]                       # the exceptions' places in code points
        self.lead = lead
        self.first = bounds - self.excess[np.searchsorted(lead, bounds)]
        self.counts = np.diff(self.first)                       # code points of each text

    def to_bytes(self, text: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The byte in `data` at which code point number `point` of each of the texts numbered `text` begins."""
        place = self.first[text] + point
        return place + self.excess[np.searchsorted(self.at, place)]

    def to_points(self, text: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The code point of each text that begins at a byte of `data`."""
        return byte - self.excess[np.searchsorted(self.lead, byte)] - self.first[text]
