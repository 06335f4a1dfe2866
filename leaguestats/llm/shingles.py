"""Word shingles of texts as 64-bit numbers, computed on whole arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = 1 << 16
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    spaces = np.zeros(256, bool)
    spaces[[32, *range(9, 14)]] = True
    up = np.cumprod(np.full(_STEPS, _BASE, np.uint64))
    down = np.cumprod(np.full(_STEPS, _INVERSE, np.uint64))
    return values, spaces, up, down


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse (modulo 2^64), from the first power on."""
    up, down = _tables()[2:]
    while len(up) < n:
        up = np.concatenate((up, up * up[-1]))
        down = np.concatenate((down, down * down[-1]))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length in bytes of each word of a text; words lie between the ASCII white-space characters.

    ``lower`` folds A-Z.  Hashes are the same in every process.
    """
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.lower() if lower else raw, np.uint8)
    values, spaces = _tables()[:2]
    inside = ~spaces[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)])))
    return mix((total[end] - total[start]) * down[start]) if len(start) else np.zeros(0, np.uint64), end - start


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter, none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    key = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        key = mix(key) + words[i : len(words) - size + 1 + i]
    return mix(key)


def sums(lengths: np.ndarray, size: int) -> np.ndarray:
    """Sum over each run of ``size`` numbers, or of all if there are fewer."""
    if not len(lengths):
        return lengths
    total = np.concatenate(([0], np.cumsum(lengths)))
    size = min(size, len(lengths))
    return total[size:] - total[:-size]
