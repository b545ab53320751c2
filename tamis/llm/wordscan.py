"""Words, word hashes and shingle hashes of many texts at once, over the bytes of an Arrow column.

Words are `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased. All hashes are 64 bits: different words of a
corpus meet with a chance of one in 2**64 a pair, but words made on purpose to have one hash can be found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
#: Masks of the first bytes of eight.
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = (np.full(n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end]: eight bytes at a time, each mixed into what is before; the length comes first.

    A sum over places, as of a polynomial modulo 2**64, would give some different long words one value, whatever its base.
    """
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    out = mix(length.astype(np.uint64) + np.uint64(_BASE))
    left, k = np.arange(len(start)), 0
    while len(left):
        out[left] = mix(out[left] ^ (eights[start[left] + k] & _TAIL[np.minimum(length[left] - k, 8)]))
        k += 8
        left = left[length[left] > k]
    return out


@dataclass
class Words:
    """Words of all texts one after another; text i has words first[i] to first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def scan(column: pa.Array) -> Words:
    """Null counts as empty."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = _WORD[data]
    begins = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    cuts = offsets[1:-1]
    inside = cuts[(cuts > 0) & (cuts < len(data))]
    begins[inside] |= word[1:-1][inside]
    ends[inside - 1] |= word[1:-1][inside - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    return Words(data, start, end, first, word_hashes(data, start, end))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words, in order, and where each text's begin. A shorter text is one shingle, whole."""
    h, counts = words.hashes, words.counts
    n = len(h)
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(first[-1], np.uint64)
    run = np.zeros(max(0, n - width + 1), np.uint64)
    factor = 1
    for j in range(width if len(run) else 0):
        run += h[j : j + len(run)] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    long = counts >= width
    # Positions of long texts' shingles: all words but the last width - 1.
    keep = np.zeros(n + 1, np.int64)
    np.add.at(keep, words.first[:-1][long], 1)
    np.add.at(keep, (words.first[1:] - width + 1)[long], -1)
    at = np.flatnonzero(np.cumsum(keep)[:n] > 0)
    text_of = np.repeat(np.arange(len(counts)), np.where(long, many, 0))
    within = np.arange(len(at)) - np.repeat(np.cumsum(np.where(long, many, 0)) - np.where(long, many, 0), np.where(long, many, 0))
    out[first[text_of] + within] = mix(run[at])
    for i in np.flatnonzero((counts > 0) & ~long):
        value, factor = int(counts[i]), 1
        for x in h[words.first[i] : words.first[i + 1]].tolist():
            value, factor = (value + x * factor) % (1 << 64), factor * _BASE % (1 << 64)
        out[first[i]] = mix(np.array([value], np.uint64))[0]
    return out, first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[first[:-1][first[:-1] < len(values)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], total[first]
