"""NumPy views of an Arrow string column: byte buffers, word boundaries, word and shingle hashes.

Nothing here loops over characters or words in Python; every function works on one
concatenated byte buffer of a chunk of rows, so a chunk's memory is a fixed multiple of
its bytes. Hashes are 64-bit polynomial sums over a fixed random byte table (wrapping
arithmetic), finalised by an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche mix of uint64 values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(_BASE))

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n (grown on demand, kept by the worker)."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INV)):
                p = np.full(size, base, dtype=U)
                p[0] = 1
                _powers[name] = np.cumprod(p, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = (np.frombuffer(buffers[2], np.uint8)[offsets[0]: offsets[-1]]
            if buffers[2] is not None else np.zeros(0, np.uint8))
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of data[start:end] from its prefix sums."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(_INV))


def _class(pairs: list[tuple[int, int]]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for lo, hi in pairs:
        lut[lo: hi + 1] = True
    return lut


#: Runs of letters, digits and non-ASCII bytes; A-Z are lower-cased before hashing.
ALNUM = _class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
#: Everything but ASCII white space.
NONSPACE = ~_class([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IDENTITY = np.arange(256, dtype=np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per row) of the runs of ``lut`` bytes; runs never cross rows."""
    n = len(data)
    inside = lut[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    count = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
    return start, end, count


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, words per row) of every k-word shingle; a row of 1 to k-1 words is one shingle."""
    data = LOWER[data]
    start, end, count = words(data, offsets, ALNUM)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U), count
    w = range_hash(prefix_sums(data), start, end)
    row = np.repeat(np.arange(len(count)), count)
    padded = np.concatenate([w, np.zeros(k, U)])
    total = np.zeros(len(w), U)
    last = np.cumsum(count)[row]                       # end of the row's words
    length = np.minimum(last - np.arange(len(w)), k)   # words of this shingle
    for j in range(k):
        total += np.where(j < length, padded[j: j + len(w)], U(0)) * U(pow(_BASE, j + 1, 1 << 64))
    first = np.arange(len(w)) == last - count[row]
    keep = (length == k) | (first & (count[row] < k))
    return row[keep], mix(total[keep] + length[keep].astype(U)), count


def weighted_sets(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) in row order with their multiplicity."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
