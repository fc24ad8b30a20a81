"""Vectorised work on spans of a long text: code points, span hashes, ragged gathers."""

from __future__ import annotations

import functools
import re

import numpy as np

#: An odd 64-bit multiplier and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INV):
        powers = np.full(size, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _MIX[2])
    h = h * _MIX[0]
    h ^= h >> _MIX[2]
    h = h * _MIX[1]
    return h ^ (h >> _MIX[2])


class SpanHash:
    """Hashes of any spans of one sequence of symbols, from one prefix sum.

    Equal spans of symbols get equal 64-bit hashes. Different short ones differ but for a chance of about
    2**-60 a pair; long spans of two alternating symbols can be made to collide, so this is for spans no
    longer than a vocabulary's pieces.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        size = 1 << max(12, int(n).bit_length())
        powers, self.inverse = _powers(size)
        values = symbols.astype(np.uint64)
        values += np.uint64(1)
        values *= _MIX[0]
        values ^= values >> _MIX[2]
        values *= powers[:n]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offset, offset + 1, ... of each of many slices, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(offsets - (ends - lengths), lengths)


def offsets_of(lengths: list[int]) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def cut_text(text: str, border: re.Pattern, limit: int) -> list[str]:
    """Consecutive parts of a text that end at a border each, of ``limit`` characters or a little more.

    A text without a border stays whole from there on.
    """
    parts, at = [], 0
    while len(text) - at > limit:
        found = border.search(text, at + limit)
        if found is None:
            break
        parts.append(text[at : found.end()])
        at = found.end()
    return [*parts, text[at:]]
