"""Vectorised word hashing: whole Arrow batches of texts become numpy arrays of word hashes, with no Python loop over words.

A word is a maximal run of Unicode letters and digits (general categories L* and N*) of the lower-cased text. Its hash
is a 64-bit polynomial over random per-character values, read off prefix sums; n-gram hashes combine word hashes."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
U = np.uint64
#: Characters worked on at once; longer texts are taken alone, whole.
CHUNK = 600_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.cache
def _char_values() -> np.ndarray:
    return mix64(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * U(_ODD))


@functools.cache
def _word_char() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    cat = unicodedata.category
    table[[c for c in range(sys.maxunicode + 1) if cat(chr(c))[0] in "LN"]] = True
    return table


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("r")
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("r", _ODD), ("i", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["r"], _POWERS["i"]


class Words:
    """Word hashes of some texts: ``hash`` of all words in order, ``first[d]:first[d + 1]`` those of text d."""

    __slots__ = ("first", "hash")

    def __init__(self, texts: list[str]):
        lowered = [t.lower() if t else "" for t in texts]
        codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = np.zeros(len(codes) + 2, dtype=np.int8)
        inside[1:-1] = _word_char()[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        r, inverse = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_char_values()[codes] * r[: len(codes)], out=sums[1:])
        self.hash = mix64((sums[end] - sums[start]) * inverse[start])
        self.first = np.searchsorted(start, begins)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words at every position (garbage where they would cross texts), and how many each text has."""
        total = len(self.hash)
        out = np.zeros(max(0, total - n + 1), dtype=np.uint64)
        for j in range(n):
            out = out * U(0xD6E8FEB86659FD93) + self.hash[j : j + len(out)]
        return mix64(out), np.maximum(0, np.diff(self.first) - n + 1)


def chunks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
