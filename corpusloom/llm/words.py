"""Words of many texts at a time, as array operations over their bytes."""

from __future__ import annotations

import numpy as np

from corpusloom.llm.arrow import chunks, cut, raw_values  # noqa: F401 - used as parts of this module
from corpusloom.llm.suffix import _MIX, _hash, _scatter, _sums

# The white space that ends words.
SPACES = b" \t\n\v\f\r"
WORD, SPACE, BREAK = range(3)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def kinds(spaces: bytes = SPACES, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: part of a word, a space, or the end of a piece."""
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(spaces, np.uint8)] = SPACE
    out[np.frombuffer(breaks, np.uint8)] = BREAK
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z as a to z."""
    return _LOWER[data]


def word_bounds(kind: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the words; none crosses the end of a text."""
    inside = kind == WORD
    edge = np.zeros(len(kind) + 1, bool)
    edge[np.r_[0, ends]] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, the same wherever they stand."""
    mix = _MIX[0] if not seed else np.random.default_rng((11, seed)).integers(0, 1 << 64, 256, dtype=np.uint64)
    return _hash(_sums(data, mix), starts, stops) if len(starts) else np.zeros(0, np.uint64)


def chain(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several in a row."""
    out = np.full(len(hashes[0]), np.uint64(len(hashes)))
    for h in hashes:
        out = _scatter(out * _STEP + h)
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word equals the word numbered `like` in its place."""
    sizes = stops - starts
    if not np.array_equal(sizes, sizes[like]):
        return False
    shift = np.repeat(starts[like] - starts, sizes)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return np.array_equal(data[at], data[at + shift])
