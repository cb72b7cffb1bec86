"""Minimal hitting sets: the smallest column sets that meet every one of a family of column sets.

Two different rows differ in a set of columns. A key is a column set that meets the difference set of every two rows, so the
minimal keys are the minimal hitting sets of the difference sets, and only the smallest difference sets matter. Sets are
whole numbers here, one bit a column.
"""
from __future__ import annotations

import functools
import operator
import time
from collections.abc import Iterable

import numpy as np


class OutOfTime(Exception):
    pass


def smallest_sets(sets: Iterable[int]) -> list[int]:
    """The sets that contain no other one, smallest first."""
    kept: list[int] = []
    array = np.zeros(0, np.uint64)
    for s in sorted(set(sets), key=lambda s: (s.bit_count(), s)):
        if s < 1 << 64:                                 # one comparison with all kept sets
            if len(array) and (array & np.uint64(s) == array).any():
                continue
            array = np.append(array, np.uint64(s))
        elif any(k & s == k for k in kept):
            continue
        kept.append(s)
    return kept


def minimal_hitting_sets(family: list[int], most: int, deadline: float | None = None) -> tuple[list[int], bool]:
    """All minimal hitting sets of up to `most` elements, and whether larger ones may exist.

    A prefix tree is walked depth first. A set not yet met is chosen, and each of its elements opens a branch. Every element of
    a prefix must be the only one to meet some set, else no minimal hitting set contains the prefix and its branch ends. An
    element is given to later branches only once its own is done, so no set is found twice."""
    found: list[int] = []
    cut = False

    def grow(chosen: int, size: int, usable: int, unmet: list[int], alone: list[list[int]]) -> None:
        nonlocal cut
        if not unmet:
            found.append(chosen)
            return
        if size == most:
            cut = True
            return
        if deadline is not None and time.monotonic() > deadline:
            raise OutOfTime
        branches = min((s & usable for s in unmet), key=int.bit_count)
        if size == most - 1:                            # only an element of all unmet sets completes the set
            last = functools.reduce(operator.and_, unmet) & usable
            cut = cut or last != branches
            branches = last
        usable &= ~branches
        while branches:
            element = branches & -branches
            branches ^= element
            still = [[s for s in sets if not s & element] for sets in alone]
            if all(still):
                met = [s for s in unmet if s & element]
                grow(chosen | element, size + 1, usable, [s for s in unmet if not s & element], [*still, met])
                usable |= element
    if 0 not in family:
        grow(0, 0, functools.reduce(operator.or_, family, 0), family, [])
    return found, cut
