"""Fill-in-the-middle transformation by displacement scatter.

A text is a row of units (a run of ASCII letters, or one other character). Two cuts between units
make prefix, middle and suffix; the output puts the middle last, each part behind its sentinel.
A batch is one byte buffer. The cuts of all its rows give, for every part, the distance its bytes
move; those distances go into a difference array over the input bytes, whose running sum is every
byte's shift, so that one scatter writes all outputs. The way back finds the sentinels in the
output, builds the opposite distances over the restored bytes and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import bound_batches
from claimscope.llm.textnum import row_chunks, strings

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many are transformed; of 100 transformed ones, so many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of every unit, units per row)."""
    letter = _LETTER[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[1:] & letter[:-1]
    edges = offsets[offsets < len(data)]
    inner[edges] = False
    start = np.flatnonzero(~inner & ((data & 0xC0) != 0x80))
    return start, np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])


def sentinels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of every sentinel that lies within one row."""
    at = np.flatnonzero((data[:-2] == 0x3C) & _MARK[data[1:-1]] & (data[2:] == 0x3E)) if len(data) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[row + 1]
    return at[inside], row[inside]


def _shifts(start: np.ndarray, moved: np.ndarray, size: int) -> np.ndarray:
    """Per byte, the shift of the part that holds it: ``start`` ascending over all parts (empty ones too), ``moved`` their shifts."""
    steps = np.diff(moved, prepend=0)
    difference = np.zeros(size + 1, np.int64)
    np.add.at(difference, start, steps)
    return np.cumsum(difference[:-1])


def scatter(data: np.ndarray, offsets: np.ndarray, cut1: np.ndarray, cut2: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs: rows cut at the byte places cut1 <= cut2, parts moved by their form."""
    begin, end = offsets[:-1], offsets[1:]
    a, b, c = cut1 - begin, cut2 - cut1, end - cut2
    moved = form != PLAIN
    out_offsets = np.append(0, np.cumsum(end - begin + 9 * moved))
    o = out_offsets[:-1]
    to_a = np.where(form == PSM, o + 3, np.where(form == SPM, o + 6 + c, o))
    to_b = np.where(moved, o + 9 + a + c, o + a)
    to_c = np.where(form == PSM, o + 6 + a, np.where(form == SPM, o + 3, o + a + b))
    start = np.stack([begin, cut1, cut2], 1)
    shift = _shifts(start.ravel(), (np.stack([to_a, to_b, to_c], 1) - start).ravel(), len(data))
    out = np.zeros(int(out_offsets[-1]), np.uint8)
    out[np.arange(len(data)) + shift] = data
    for place, mark in ((to_a, PREFIX), (to_b, MIDDLE), (to_c, SUFFIX)):
        for j, byte in enumerate(mark):
            out[place[moved] - 3 + j] = byte
    return out, out_offsets


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, well formed) of the texts behind outputs; a row without its three sentinels in order restores to empty."""
    begin, end = offsets[:-1], offsets[1:]
    at, row = sentinels(data, offsets)
    moved = form != PLAIN
    well = np.where(moved, np.bincount(row, minlength=len(begin)) == 3, True)
    first = np.searchsorted(row, np.arange(len(begin)))
    pick = lambda k: at[np.minimum(first + k, max(len(at) - 1, 0))] if len(at) else np.zeros(len(begin), np.int64)
    p0, p1, p2 = pick(0), pick(1), pick(2)
    lead = np.where(form == SPM, SUFFIX[1], PREFIX[1])
    if len(data):
        name = lambda p: data[np.minimum(p + 1, len(data) - 1)]
        well &= ~moved | ((p0 == begin) & (name(p0) == lead) & (name(p1) == PREFIX[1] + SUFFIX[1] - lead) & (name(p2) == MIDDLE[1]))
    ok = moved & well
    # parts of the output in restored order: prefix, middle, suffix
    a0 = np.where(ok, np.where(form == SPM, p1, p0) + 3, begin)
    a1 = np.where(ok, np.where(form == SPM, p2, p1), np.where(well, end, begin))
    b0, b1 = np.where(ok, p2 + 3, a1), np.where(ok, end, a1)
    c0 = np.where(ok, np.where(form == SPM, p0, p1) + 3, a1)
    c1 = np.where(ok, np.where(form == SPM, p1, p2), a1)
    a, b, c = a1 - a0, b1 - b0, c1 - c0
    out_offsets = np.append(0, np.cumsum(a + b + c))
    o = out_offsets[:-1]
    start = np.stack([o, o + a, o + a + b], 1)
    size = int(out_offsets[-1])
    return data[np.arange(size) + _shifts(start.ravel(), (np.stack([a0, b0, c0], 1) - start).ravel(), size)], out_offsets, well


def _column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    Cuts and form follow from the SHA-256 of ``seed:doc_id``, so that a rerun gives the same output
    in any partitioning, and rows that repeat an id are cut by the same numbers. A null or empty text,
    and one that holds a sentinel, stays plain; a null doc_id counts as the empty string. Only doc_id
    and text are read; an empty table gives an empty one. A text is one row of one task, whatever its
    length, and takes a fixed multiple of its bytes.
    """
    bound_batches(docs.sparkSession)
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in row_chunks(offsets):
                part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
                h = [batch.column(k).slice(i, j - i).to_numpy() for k in range(2, 6)]
                start, n = units(part, at)
                ends = np.append(start, len(part))
                first = np.cumsum(n) - n
                place = lambda k: np.where(k < n, ends[first + np.minimum(k, n)], at[1:])
                cut1, cut2 = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
                form = np.where(h[3] % 100 < SUFFIX_FIRST, SPM, PSM)
                form[(h[2] % 100 >= TRANSFORMED) | (n == 0)] = PLAIN
                form[sentinels(part, at)[1]] = PLAIN
                p1, p2 = place(cut1), place(cut2)
                out, out_at = scatter(part, at, p1, p2, form)
                chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(FORMS[form]),
                     pa.array(chars[p1] - chars[at[:-1]], pa.int64(), mask=plain), pa.array(chars[p2] - chars[p1], pa.int64(), mask=plain),
                     _column(out, out_at)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    return docs.select("doc_id", "text", *number).mapInArrow(run, schema)


def restore(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``restored``, the text rebuilt from its columns output and form alone.

    Null where the form is none of the three, or the output lacks the sentinels of its form; a null output counts as
    empty. All columns stay, in order; an empty table gives an empty one.
    """
    bound_batches(formatted.sparkSession)
    at_output, at_form = formatted.columns.index("output"), formatted.columns.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(at_output))
            known = np.array([{"plain": PLAIN, "psm": PSM, "spm": SPM}.get(x, -1) for x in batch.column(at_form).to_pylist()], np.int64)
            for i, j in row_chunks(offsets):
                form = known[i:j]
                out, out_at, well = gather(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], np.maximum(form, PLAIN))
                text = _column(out, out_at)
                text = pa.array(np.where(well & (form >= 0), text.to_numpy(zero_copy_only=False), None), pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), text], [*batch.schema.names, "restored"])

    return formatted.mapInArrow(run, T.StructType([*formatted.schema.fields, T.StructField("restored", T.StringType())]))
