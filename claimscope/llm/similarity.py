"""Shingle sets of units as sorted arrays, and the (probability) Jaccard index of two of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from claimscope.llm.textnum import U, row_chunks, shingles, strings, weighted_sets

#: A unit's distinct shingle hashes, ascending (8 bytes each), and how often it holds them (4 bytes each).
SETS = "key binary, grams binary, weights binary"
GRAMS = "key binary, gram bigint, weight bigint"
#: A unit's shingles as bits of 64-bit words, and the sum of their weights.
BIT_WORDS = 16
BIT_SCHEMA = "key binary, total bigint, " + ", ".join(f"b{i} bigint" for i in range(BIT_WORDS))


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two aligned weight vectors (absent: 0), each scaled to sum 1; 0 if either is empty."""
    if not x.sum() or not y.sum():
        return 0.0
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    x, y = x / x.sum(), y / y.sum()
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    below, above = np.cumsum(x[order]), np.append(np.cumsum(y[order][::-1])[::-1], 0)
    upto = np.searchsorted(ratio[order], ratio[both], "right")
    return float((1 / (below[upto - 1] / x[both] + above[upto] / y[both])).sum())


def index_of(ga: np.ndarray, wa: np.ndarray, gb: np.ndarray, wb: np.ndarray) -> float:
    """The index of two sets (ascending distinct hashes, weights)."""
    at = np.searchsorted(ga, gb)
    shared = np.flatnonzero(ga[np.minimum(at, len(ga) - 1)] == gb) if len(ga) else np.zeros(0, np.int64)
    if not len(shared):
        return 0.0
    alone = np.ones(len(gb), bool)
    alone[shared] = False
    x = np.concatenate([wa, np.zeros(int(alone.sum()))]).astype(float)
    y = np.concatenate([np.zeros(len(ga)), wb[alone]]).astype(float)
    y[at[shared]] = wb[shared]
    return probability_jaccard(x, y)


def similar_sets(least: float) -> Callable:
    """Keeps rows (a, b, grams and weights of a, of b) whose index is ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r, (ga, wa, gb, wb) in enumerate(zip(*(batch.column(k) for k in range(2, 6)))):
                view = lambda v, t: np.frombuffer(v.as_buffer(), t)
                if index_of(view(ga, U), view(wa, np.uint32), view(gb, U), view(wb, np.uint32)) >= least - 1e-12:
                    keep.append(r)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])
    return run


def _pieces(data: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
    offsets = (bounds * width).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def shingle_sets(words: int, weighted: bool = True) -> Callable:
    """SETS of rows (key, text); unweighted: every weight is 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in row_chunks(offsets):
                row, value, _ = shingles(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], words)
                row, value, weight = weighted_sets(row, value)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                weight = weight if weighted else np.ones_like(weight)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), _pieces(value, bounds, 8), _pieces(weight.astype(np.uint32), bounds, 4)], ["key", "grams", "weights"])
    return run


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GRAMS (one row per shingle) of SETS."""
    for batch in batches:
        for r in range(batch.num_rows):
            gram = np.frombuffer(batch.column(1)[r].as_buffer(), np.int64)
            weight = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint32).astype(np.int64)
            if len(gram):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(gram), r))), pa.array(gram), pa.array(weight)],
                                                 ["key", "gram", "weight"])


def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BIT_SCHEMA of SETS: shingle h sets bit h mod (64 BIT_WORDS)."""
    for batch in batches:
        bits = np.zeros((batch.num_rows, BIT_WORDS), U)
        total = np.zeros(batch.num_rows, np.int64)
        for r in range(batch.num_rows):
            at = (np.frombuffer(batch.column(1)[r].as_buffer(), U) % U(64 * BIT_WORDS)).astype(np.int64)
            np.bitwise_or.at(bits[r], at >> 6, U(1) << (at & 63).astype(U))
            total[r] = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint32).sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), *(pa.array(bits[:, i].view(np.int64)) for i in range(BIT_WORDS))],
                                         ["key", "total", *(f"b{i}" for i in range(BIT_WORDS))])
