"""64-bit keys of the words of whole Arrow batches, without a Python object per word.

A word's key is a polynomial in its bytes, each replaced by a fixed random number,
modulo 2**64, finished by a bit mixer.  Equal words have equal keys in every
process; different words share one with a chance of about 2**-60 a pair (at
10**8 different words well below one chance pair is expected).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts are hashed together up to this size; a longer one alone

_random = random.Random(12)
_VALUES = np.array([_random.getrandbits(64) | 1 for _ in range(256)], dtype=np.uint64)
_LOWER = _VALUES.copy()
_LOWER[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P1, _P2, _P3, _P4, _P5 = (  # the constants of XXH64
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _xxh64(x: np.ndarray, seed) -> np.ndarray:
    """XXH64 of the eight bytes of each number."""
    x = x * _P2
    h = (seed + _P5 + np.uint64(8)) ^ (((x << np.uint64(31)) | (x >> np.uint64(33))) * _P1)
    h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of an ordered pair of keys: ``xxhash64(a, b)`` of the engine."""
    return _xxh64(b, _xxh64(a, np.uint64(42)))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to at least ``size``."""
    room = SLICE_BYTES
    while room < size:
        room *= 2
    if room in _powers:
        return _powers[room]
    up, down = np.full(room + 1, _BASE), np.full(room + 1, _INVERSE)
    up[0] = down[0] = np.uint64(1)
    tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if room == SLICE_BYTES:
        _powers[room] = tables
    return tables


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of a text column: parts of whole texts, about ``SLICE_BYTES`` each."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, texts.slice(first, last - first)
        first = last


def word_keys(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words `[^\\x20\\x09-\\x0D]+` in order, and where each text's begin (and the end).

    Null texts have no words; ``lower`` takes A-Z as a-z.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    space = _SPACE[data]
    cut = np.zeros(size + 1, dtype=bool)  # no word goes on across the start of a text
    cut[bounds] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | cut[1:-1]
    ends[:-1] &= space[1:] | cut[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _power_tables(size)
    sums = np.empty(size + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _VALUES)[data] * up[:size], out=sums[1:])
    keys = mix((sums[ends + 1] - sums[begins]) * down[begins])
    return keys, np.searchsorted(begins, bounds)
