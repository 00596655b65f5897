"""Words and word shingles of whole Arrow string columns as 64-bit hashes, in numpy.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text. A text of fewer than
`n` words has one shingle, all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15                       # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    """The first 2^bits powers. The cache stays where it is: functions that are sent to executors name it, they don't carry it."""
    steps = np.full(1 << bits, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, max(n - 1, CHUNK_BYTES - 1).bit_length())


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice): runs of `rows` rows and about `limit` bytes at most; one longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > limit or i - start >= rows):
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield start, texts.slice(start)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column after each other, and where each text starts (one more at the end); null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def runs(marked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of marked bytes, none across texts; offsets of each text's first run."""
    inside = np.concatenate([[False], marked, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[0::2], change[1::2]
    cut = at[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(marked))])
    cut = cut[inside[cut] & inside[cut + 1]]         # a run goes on across a border of texts
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, at)


def run_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: a polynomial modulo 2^64, made independent of the place, then scrambled with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(body))[: len(body)])])
        value = (total[ends] - total[starts]) * _power(_INVERSE, len(body))[starts]
        return mix(mix(value) + (ends - starts).astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the offset of each text's first one."""
    body, at = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = runs(_WORD[body], at)
    return run_hashes(body, starts, ends), first


def shingles(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of n words in order, repeats included, and the offset of each text's first one."""
    word, first = words(texts)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        factors = [np.uint64((_BASE * (2 * k + 3) ** 3) & _MASK | 1) for k in range(n)]
        if len(word) >= n:
            total = np.zeros(len(word) - n + 1, np.uint64)
            for k in range(n):
                total += word[k: len(word) - n + 1 + k] * factors[k]
            total = mix(total)
        else:
            total = np.zeros(0, np.uint64)
        made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        offsets = np.concatenate([[0], np.cumsum(made)])
        # a shingle starts at each word but the last n-1 of its text
        keep = np.zeros(len(word), bool)
        long = counts >= n
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, first[:-1][long], 1)
        np.add.at(edge, first[1:][long] - n + 1, -1)
        keep = np.cumsum(edge[:-1]) > 0
        out = np.empty(int(offsets[-1]), np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < n))
        slot = np.ones(len(out), bool)
        slot[offsets[short]] = False
        out[slot] = total[keep[: len(total)].nonzero()[0]] if len(total) else out[slot]
        for i in short:
            own = np.uint64(counts[i])
            for k in range(int(counts[i])):
                own = own + word[first[i] + k] * factors[k]
            out[offsets[i]] = mix(np.array([own], np.uint64))[0]
    return out, offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, ascending, with new offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(offsets) - 1))]).astype(np.int64)
