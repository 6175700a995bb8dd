"""Spanning forests of links that are found in a batch, so that what leaves a task is linear in its rows."""

from __future__ import annotations

import numpy as np


def merge(top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining ``i`` and ``j``; ``top[x]`` is the root of ``x`` before, each root its own."""
    top = top.copy()
    while len(i):
        a, b = top[i], top[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        if not apart.any():
            break
        np.minimum.at(top, hi[apart], lo[apart])
        while not np.array_equal(nxt := top[top], top):
            top = nxt
        i, j = i[apart], j[apart]
    return top


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal rows of ``keys`` (rows x columns)."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
    return starts, np.diff(np.r_[starts, len(keys)])


def neighbours(starts: np.ndarray, sizes: np.ndarray, most: int):
    """Pairs of places within the runs of at most ``most`` rows, one shift at a time."""
    run = np.repeat(np.where(sizes <= most, starts, -1), sizes)
    for shift in range(1, min(most, int(sizes.max(initial=1)))):
        i = np.flatnonzero((run[:-shift] == run[shift:]) & (run[:-shift] >= 0))
        if not len(i):
            break
        yield i, i + shift
