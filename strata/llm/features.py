"""Sparse text features as integer ids, the same in every process.

A shape is what is left of a word when letters become ``x`` or ``X``, digits ``9``, and runs of one
character one character: ``stop!!!`` -> ``x!``. Words and shapes are numbered by CRC-32.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 18
SIZE = 1 << BITS
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("x")
_CLASS[ord("A") : ord("Z") + 1] = ord("X")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[128:] = ord("x")
_CLASS[[9, 11, 12, 13]] = 32
_TABLE = _CLASS.tobytes()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Numbers(dict):
    """word -> CRC-32 of it, or of its ``first`` bytes; remembered up to a bound."""

    def __init__(self, keep: int = 300_000, first: int | None = None):
        super().__init__()
        self.keep, self.first = keep, first

    def __missing__(self, word) -> int:
        n = zlib.crc32(word[: self.first], self.first or 0)
        if len(self) < self.keep:
            self[word] = n
        return n


def shapes(raw: bytes) -> list[bytes]:
    """The shapes of a text's words; a line end is a shape of its own."""
    if not raw:
        return []
    a = np.frombuffer(raw.translate(_TABLE), np.uint8)
    a = a[np.r_[True, a[1:] != a[:-1]]]
    return a.tobytes().replace(b"\n", b" \n ").split(b" ")


def _ids(words: list[bytes], numbers: Numbers) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))


def _place(h: np.ndarray) -> np.ndarray:
    return ((h * _A) >> np.uint64(64 - BITS)).astype(np.int64)


def shape_ngrams(text: str, numbers: Numbers, most: int = 3) -> np.ndarray:
    """Distinct ids of the 1- to ``most``-grams of shapes. No words: none."""
    s = _ids([x for x in shapes(text.encode()) if x], numbers)
    out = []
    h = np.zeros(len(s), np.uint64)
    for n in range(1, most + 1):
        if len(s) < n:
            break
        h = h[: len(s) - n + 1] * _B + s[n - 1 :] + np.uint64(n)
        out.append(np.unique(_place(h)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_tables(keep: int = 150_000) -> list[Numbers]:
    """For :func:`words`: the whole word and its first 4, 6, 8 and 10 bytes, for families that share a stem."""
    return [Numbers(keep, first) for first in (None, 4, 6, 8, 10)]


def words(text: str, tables: list[Numbers]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of the lower-cased words (letters and digits) and of their stems, and how often each occurs."""
    w = text.lower().encode().translate(_APART).split()
    if not w:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(_place(np.concatenate([_ids(w, t) for t in tables])), return_counts=True)
