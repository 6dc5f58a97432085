"""Quality rules, line first: every line is judged, failing lines go, then documents that lost too much.

A line (split at \\n) fails by the first of these rules that it meets:
  boilerplate  it holds a stock phrase of web pages
  navigation   separators (| > bullets) stand between at least a third of its words
  symbols      symbol characters exceed 15 % of its word characters
  shouting     it has 5 words or more, and over 70 % of its ASCII letters are capitals
  repetition   it has 10 words or more, and over half of them equal the word before
  punctuation  it has fewer than 4 words and does not end with a closing mark
Lines without words are neither judged nor counted as lost. A document is kept unless the base
rules fail it or its failing lines hold over half of its word characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimscope.llm.common import bound_batches
from claimscope.llm.textnum import NONSPACE, U, mix, prefix_sums, range_hash, row_chunks, strings, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_SHARE = 0.5
MAX_SYMBOL_SHARE = 0.15
MAX_CAPITAL_SHARE = 0.7

#: Stock phrases of web pages.
BOILERPLATE = re.compile(
    rb"(?i)all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|(?:accept|use[sd]?) cookies"
    rb"|enable javascript|lorem ipsum|click here|subscribe to our|sign up for our|skip to (?:main )?content")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"|>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".!?:;\"')]")] = True

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sum(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _repeats(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Per element, its place (0, 1, ..) among equal (group, value) elements and their number."""
    order = np.lexsort((value, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (value[order][1:] != value[order][:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    place, number = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(at, size)
    number[order] = np.repeat(size, size)
    return np.stack([place, number])


def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Metrics and verdicts of the rows, and their lines (line_row, line_start, line_end, line_ok)."""
    n = len(offsets) - 1
    start, end, n_words = words(data, offsets, NONSPACE)
    row = np.repeat(np.arange(n), n_words)
    sums = prefix_sums(data)
    value = range_hash(sums, start, end)
    point = _sum((data & 0xC0) != 0x80)
    chars = point[end] - point[start]
    word_chars = np.bincount(row, chars, n).astype(np.int64)
    symbol = _sum(_SYMBOL[data])
    n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]

    # words in 3-word windows that occur twice or more in their row
    marked = np.zeros(len(value) + 2, bool)
    if len(value) >= 3:
        at = np.flatnonzero(row[:-2] == row[2:])
        tri = mix(value[at] * U(3) + mix(value[at + 1] * U(5) + mix(value[at + 2])))
        twice = at[_repeats(row[at], tri)[1] > 1]
        for j in range(3):
            marked[twice + j] = True
    n_repeat = np.bincount(row, marked[: len(value)], n).astype(np.int64)

    # lines
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_row = np.repeat(np.arange(n), np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1)
    first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    count = last - first
    has = np.flatnonzero(count > 0)
    place = _repeats(line_row[has], range_hash(sums, line_start[has], line_end[has]))[0]
    n_dup = np.bincount(line_row[has], place > 0, n).astype(np.int64)

    done = _sum(chars)
    line_chars = done[last] - done[first]
    same = np.zeros(len(value), bool)
    same[1:] = value[1:] == value[:-1]
    same[first[has]] = False
    inner = lambda lut: (lambda c: c[line_end] - c[line_start])(_sum(lut[data]))
    upper, letters, separators = inner(_UPPER), inner(_LETTER), inner(_SEPARATOR)
    bullets = _sum((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] == 0xA2)) if len(data) > 2 else np.zeros(1, np.int64)
    top = len(bullets) - 1
    separators = separators + bullets[np.minimum(line_end, top)] - bullets[np.minimum(line_start, top)]
    repeated = _sum(same)[last] - _sum(same)[first]
    closing = np.zeros(len(line_start), bool)
    closing[has] = _CLOSING[data[end[last[has] - 1] - 1]]
    fails = (separators * 3 >= np.maximum(count - separators, 1)) & (separators > 1)
    fails |= symbol[line_end] - symbol[line_start] > MAX_SYMBOL_SHARE * line_chars
    fails |= (count >= 5) & (upper > MAX_CAPITAL_SHARE * letters)
    fails |= (count >= 10) & (2 * repeated > count)
    fails |= (count < 4) & ~closing
    text = data.tobytes()
    if hits := [m.start() for m in BOILERPLATE.finditer(text)]:
        fails[np.searchsorted(line_start, hits, "right") - 1] = True
    fails &= count > 0
    lost = np.bincount(line_row, np.where(fails, line_chars, 0), n)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words.astype(np.int64), "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
            "n_repeat_words": n_repeat, "base_failed": base_failed,
            "kept": ~base_failed & (lost <= MAX_LOST_SHARE * word_chars),
            "line_row": line_row, "line_start": line_start, "line_end": line_end, "line_ok": ~fails}


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five metrics, base_failed and kept, one row per row of ``docs``.

    Null and empty texts have no words, so the base rules fail them. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in row_chunks(offsets):
                found = judge(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                names = [*METRICS, "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(found[k]) for k in names)], ["doc_id", *names])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(k, T.LongType()) for k in METRICS),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, all columns as they were but ``text``, which loses its failing lines (and ``n_chars``, if there)."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(at))
            for i, j in row_chunks(offsets):
                part = data[offsets[i]: offsets[j]]
                found = judge(part, offsets[i: j + 1] - offsets[i])
                kept = np.flatnonzero(found["kept"])
                raw, ok = part.tobytes(), found["line_ok"]
                bounds = np.searchsorted(found["line_row"], np.arange(j - i + 1))
                texts = [b"\n".join(raw[found["line_start"][x]: found["line_end"][x]]
                                    for x in range(bounds[r], bounds[r + 1]) if ok[x]).decode() for r in kept]
                columns = [c.slice(i, j - i).take(pa.array(kept)) for c in batch.columns]
                columns[at] = pa.array(texts, pa.string()).cast(batch.column(at).type)
                if size_at is not None:
                    columns[size_at] = pa.array([len(x) for x in texts], pa.int64()).cast(batch.column(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
