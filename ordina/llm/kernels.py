"""Array kernels over Arrow text columns: words, word hashes and rolling hashes of word windows.

All work on the UTF-8 bytes of a whole batch at once. Hashes are polynomials modulo 2**64 (Rabin-Karp), taken from
running sums: the sum of value * base**position between two places, times base**-start, does not depend on where it
stands. Each is mixed at the end. Blocks bound the memory whatever the length of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64
#: Odd constants of the published splitmix64 finaliser.
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


Batches = Iterator[pa.RecordBatch]


def _give_back() -> None:
    """Return freed memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, which gives back what it freed as its task ends: Spark keeps its Python workers waiting for other tasks."""

    def out(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(_MIX1)
    x = (x ^ (x >> _U(27))) * _U(_MIX2)
    return x ^ (x >> _U(31))


def _base(seed: int) -> int:
    return int(mix(np.array([seed * 2 + 1], _U) * _U(_GOLDEN))[0]) | 5


@lru_cache(4)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_GOLDEN) + _U(seed))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 ... base**(n - 1), or of the base's inverse, modulo 2**64."""
    found = _powers.get((seed, inverse))
    if found is None or len(found) < n:
        base = _base(seed)
        step = np.full(max(n, BLOCK + 1024), pow(base, -1, 1 << 64) if inverse else base, _U)
        step[0] = 1
        found = np.cumprod(step)
        if n <= 4 * BLOCK:
            _powers[seed, inverse] = found
    return found[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places where its rows begin, and the last ends; null rows are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most ``limit`` bytes each, or of a single row."""
    _, offsets = text_bytes(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all words, and for each row the index of its first word (and the number of words at the end).

    A word is a maximal run of bytes other than space and 9 to 13 within a row.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, seed: int = 1, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; with ``lower``, of A-Z in lower case."""
    values = _byte_values(seed)
    if lower:
        values = values[_LOWER]
    out = np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, "right")))
        low, high = starts[a], ends[b - 1]
        total = np.zeros(high - low + 1, _U)
        np.cumsum(values[data[low:high]] * powers(seed, high - low), out=total[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = (total[e] - total[s]) * powers(seed, high - low, True)[s] + (e - s).astype(_U) * _U(_GOLDEN)
        a = b
    return mix(out)


def rolling(tokens: np.ndarray, width: int, *, seed: int = 2) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive tokens, whatever rows they belong to."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.empty(n, _U)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        total = np.zeros(b - a + width, _U)
        np.cumsum(tokens[a : b + width - 1] * powers(seed, b - a + width - 1), out=total[1:])
        out[a:b] = (total[width:] - total[: b - a]) * powers(seed, b - a, True)
    return mix(out)


def room(first: np.ndarray) -> np.ndarray:
    """For each word the number of words from it to the end of its row; ``first`` is from :func:`words`."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[0], first[-1])


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = op(values[:-step], values[step:])
        have += step
    return values


#: Letters (and all bytes of other scripts) 1, digits 2, punctuation 3, space 0.
_KIND = np.full(256, 3, np.uint8)
_KIND[_IS_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`words`, with words cut where letters, digits and punctuation meet."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edge = np.flatnonzero(cut)
    starts, ends = edge[:-1], edge[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    return starts, ends, np.searchsorted(starts, offsets)
