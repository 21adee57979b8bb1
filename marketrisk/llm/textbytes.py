"""Words of many texts at once: Arrow buffers of UTF-8 to arrays of 64-bit word hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many bytes, a longer text alone.
CHUNK_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | _U(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = _byte_values()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, where


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of texts of at most ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, words before each text and in all) of one chunk of texts.

    ``offsets`` point into ``data``.  A word's hash is a polynomial of its bytes' random values, mixed.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    own = data[base:end]
    starts = offsets - base
    is_word = ~_IS_SPACE[own]
    fresh = np.empty(len(own), bool)
    fresh[:1] = True
    fresh[1:] = ~is_word[:-1]
    fresh[starts[:-1][starts[:-1] < len(own)]] = True
    begins = np.flatnonzero(is_word & fresh)
    counts = np.searchsorted(begins, starts)
    if not len(begins):
        return np.empty(0, np.uint64), counts
    lead = int(begins[0])
    lengths = np.diff(begins, append=len(own))
    place = np.arange(len(own) - lead) - np.repeat(begins - lead, lengths)
    powers = np.full(int(lengths.max()), _ODD)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    terms = _VALUES[own[lead:]]
    terms *= powers[place]
    terms *= is_word[lead:]
    return mix(np.add.reduceat(terms, begins - lead)), counts


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ _U(0xA5A5A5A5DEADBEEF)) * _ODD + _U(1))
