"""Words of a text shard as positions and 64-bit hashes, computed over whole byte buffers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Alphanumeric ASCII and everything beyond ASCII.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Everything but ASCII white space.
SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    key: np.ndarray


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with (c[j] - c[i]) * inverse_power[i] as the hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def words_of(data: np.ndarray, ends: np.ndarray, word: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes in the class ``word``, A-Z lower-cased unless said otherwise; ends: the documents' offsets in data."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    inside = word[data]
    edges = ends[(ends > 0) & (ends < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_hashes(LOWER[data] if lower else data)
    key = mix((sums[end] - sums[start]) * powers(len(data))[1][start])
    return Words(start, end, np.searchsorted(ends, start, side="right") - 1, key)
