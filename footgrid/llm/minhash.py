"""Minhash values of word shingles."""

from __future__ import annotations

import numpy as np

from .shingles import mix


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and offsets of n hash functions x -> (a x + b) mod 2^64, fixed for all time."""
    with np.errstate(over="ignore"):
        base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n] | np.uint64(1), base[n:]


def minima(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n minima (columns) of each run of `values` that begins at `starts`; every run has values."""
    a, b = seeds(n)
    out = np.empty((len(starts), n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[:, k] = np.minimum.reduceat(values * a[k] + b[k], starts)
    return out


def bands(least: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` minima; the key also says which band it is."""
    out = np.empty((len(least), count), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(count):
            key = np.full(len(least), k + 1, np.uint64)
            for c in range(k * rows, (k + 1) * rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, c])
            out[:, k] = key
    return out


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Smallest number of bands of `rows` values that meets a pair of the given similarity with probability `recall`."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows)))
