"""Substring dedup on paragraphs: MinHash banding, exact Jaccard, removals clustered by components.

A paragraph is a \\n-separated line with words (letters, digits, non-ASCII; A-Z lower-cased), and also a
run of neighbouring lines of at most WRAP_WORDS words each, as hard-wrapped text has them. Paragraphs
of equal word sequences are one unit. Bands of 3 minima over five-word shingles are tuned for recall: a pair at exactly 0.8 shares one of 9 bands with probability 0.998.
Paragraphs of LEAST_WORDS words or more are compared so. Shorter ones repeat only if equal, and are reported only beside
a repeated one: a lone short line says nothing of a passage (``repeated_short_lines`` lists them).

A passage may also be copied into the middle of another paragraph. So every text is cut, across its lines, at words that
its own neighbourhood chooses (the least hash of a word pair among REACH on either side), which a copy's inside chooses as
well; two neighbouring segments of equal words elsewhere are a repeated passage, and overlapping ones are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import link_near, sized, stored
from claimscope.llm.near_dedup import SIMILARITY, WORDS, band_keys
from claimscope.llm.similarity import SETS, shingle_sets
from claimscope.llm.textnum import ALNUM, LOWER, U, mix, powers, prefix_sums, range_hash, row_chunks, shingles, strings, words

BANDS, ROWS = 9, 3
#: Lines of hard-wrapped text have at most so many words (some 150 characters).
WRAP_WORDS = 25
#: Shorter paragraphs are no passages by themselves.
LEAST_WORDS = 25
#: Words on either side among which a cut is the least: cuts are REACH + 1 to some 3 REACH words apart.
REACH = 5


def _binary16(high: np.ndarray, low: np.ndarray) -> pa.Array:
    raw = np.stack([high, low], 1).astype(">u8").tobytes()
    offsets = np.arange(0, 16 * len(high) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _units(part: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None):
    """(index, words, keys, bands) of the segments of ``part`` between ``bounds`` that have words (and are ``wanted``); words of all segments."""
    srow, value, count = shingles(part, bounds, WORDS)
    ws, we, _ = words(part, bounds, ALNUM)
    w = range_hash(prefix_sums(LOWER[part]), ws, we)
    first = np.cumsum(count) - count
    place = np.arange(len(w)) - np.repeat(first, count)
    keys = []
    for salt in (1, 2):
        total = np.append(U(0), np.cumsum(mix(w + mix(place.astype(U) * U(2) + U(salt)))))
        keys.append(mix(total[first + count] - total[first] + count.astype(U)))
    has = np.flatnonzero(count > 0 if wanted is None else (count > 0) & wanted)
    sig = np.empty((len(has), BANDS * ROWS), U)
    if len(has):
        sfirst = np.searchsorted(srow, has)
        inside = np.isin(srow, has)
        kept, at = value[inside], np.cumsum(np.append(0, inside))[sfirst]
        for k in range(BANDS * ROWS):
            sig[:, k] = np.minimum.reduceat(mix(kept ^ mix(np.full(1, k + 1, U))), at)
    return has, count[has], _binary16(keys[0][has], keys[1][has]), band_keys(sig, BANDS, ROWS).view(np.int64).reshape(-1), count


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column(3))
        for i, j in row_chunks(offsets):
            part, rows = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            breaks = np.flatnonzero(part == 0x0A)
            start = np.sort(np.concatenate([rows[:-1], breaks + 1]))
            per_row = np.searchsorted(breaks, rows[1:]) - np.searchsorted(breaks, rows[:-1]) + 1
            row = np.repeat(np.arange(j - i), per_row)
            index = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            n_lines = np.ones(len(row), np.int64)
            # a line runs up to the next line's start: the break between them is no word
            *lines, count = _units(part, np.append(start, len(part)))
            made = [(lines, row, index, n_lines)]
            short = (count > 0) & (count <= WRAP_WORDS)
            heads = np.flatnonzero(~np.append(False, short[1:] & short[:-1] & (row[1:] == row[:-1])))
            n_lines = np.diff(np.append(heads, len(row)))
            if (n_lines > 1).any():
                *runs, _ = _units(part, np.append(start[heads], len(part)), n_lines > 1)
                made.append((runs, row[heads], index[heads], n_lines))
            for (has, n_words, keys, bands), row, index, n_lines in made:
                rows_of = pa.array(row[has] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows_of), batch.column(1).take(rows_of), batch.column(2).take(rows_of), pa.array(index[has], pa.int32()),
                     pa.array(n_lines[has], pa.int32()), pa.array(n_words, pa.int32()), keys,
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands))],
                    ["doc_id", "tag", "nr", "line", "n_lines", "n_words", "key", "bands"])


def cuts(pair: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places whose value is the least (the first of equals) within REACH places on either side, in one row."""
    n = len(pair)
    ok = np.ones(n, bool)
    for d in range(1, REACH + 1):
        if d >= n:
            ok[:] = False
            break
        inside = row[d:] == row[:-d]
        ok[:-d] &= inside & (pair[:-d] <= pair[d:])
        ok[d:] &= inside & (pair[:-d] > pair[d:])
        ok[-d:] = False
        ok[:d] = False
    return np.flatnonzero(ok)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two neighbouring segments each: (h1, h2: their words, doc_id, nr, line of the first word, first word, words)."""
    for batch in batches:
        data, offsets = strings(batch.column(2))
        for i, j in row_chunks(offsets):
            part, rows = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            ws, we, count = words(part, rows, ALNUM)
            w = range_hash(prefix_sums(LOWER[part]), ws, we)
            row = np.repeat(np.arange(j - i), count)
            first = np.cumsum(count) - count
            after = np.append(w[1:], U(0)) if len(w) else w
            at = cuts(mix(w ^ mix(after + U(7))), row)
            a, b = at[:-2], at[2:]
            whole = row[a] == row[b] if len(a) else np.zeros(0, bool)
            a, b = a[whole], b[whole]
            h = []
            for salt in (3, 4):                                      # of the words and their places in the passage, wherever it stands
                power = np.append(U(0), np.cumsum(mix(w + U(salt)) * powers(len(w))[0]))
                h.append(mix((power[b] - power[a]) * powers(len(w) + 1)[1][a] + (b - a).astype(U)))
            breaks = np.flatnonzero(part == 0x0A)
            line = np.searchsorted(breaks, ws[a]) - np.searchsorted(breaks, rows[row[a]])
            take = pa.array(row[a] + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(line, pa.int32()), pa.array(a - first[row[a]], pa.int32()), pa.array(b - a, pa.int32())],
                ["h1", "h2", "doc_id", "nr", "line", "first", "n"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n_words, class_doc_id, class_line, removed): stretches of words that stand elsewhere as well, wherever lines break.

    Each is the union of overlapping pairs of segments that occur twice or more; its class is that of its first pair, named by the
    pair's first place (smallest doc_id, then row, then word), and it is removed unless all its pairs have their first place in it.
    """
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("nr"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(numbered.mapInArrow(_passages, f"h1 bigint, h2 bigint, doc_id {kind}, nr bigint, line int, first int, n int"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "nr", "first", "line")
    heads = stored(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("head")).where("copies > 1").drop("copies"))
    rows = found.join(sized(heads), ["h1", "h2"])
    mine = (F.col("nr") == F.col("head.nr")) & (F.col("first") == F.col("head.first"))
    in_text = Window.partitionBy("nr").orderBy("first")
    so_far = F.max(F.col("first") + F.col("n")).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.coalesce(F.col("first") > so_far, F.lit(True)).cast("int")).withColumn("mine", mine)
    rows = rows.withColumn("run", F.sum("opens").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("nr", "run").agg(
        F.min(F.struct("first", "line", "doc_id", "head")).alias("at"), F.max(F.col("first") + F.col("n")).alias("end"), F.bool_and("mine").alias("stays"))
    return out.select("at.doc_id", "at.line", (F.col("end") - F.col("at.first")).alias("n_words"), F.col("at.head.doc_id").alias("class_doc_id"),
                      F.col("at.head.line").alias("class_line"), (~F.col("stays")).alias("removed"))


def _units_of(docs: DataFrame) -> DataFrame:
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag bigint, nr bigint, line int, n_lines int, n_words int, key binary, bands array<bigint>"
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.monotonically_increasing_id().alias("nr"), "text")  # nr is only read from the stored units
    return stored(texts.mapInArrow(_paragraphs, schema))


def repeated_short_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n_words): every line of under LEAST_WORDS words that equals another line word for word."""
    units = _units_of(docs).where((F.col("n_lines") == 1) & (F.col("n_words") < LEAST_WORDS))
    several = units.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return units.join(several, "key").select("doc_id", "line", "n_words")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n_words, class_doc_id, class_line, removed, n_lines): every paragraph that has a copy or near copy, and passages.

    A row with null ``n_lines`` is a passage (``repeated_passages``), which may begin and end inside lines.

    ``line`` is the first of ``n_lines``: 1, or more for a run of short lines, whose lines are also paragraphs of
    their own. The class is named by its first paragraph (smallest doc_id, then line), of which one row
    stays; the others are removed, but not those that overlap it in its own document. Null and empty texts have no
    paragraphs, rows that repeat a doc_id count as separate documents. Only doc_id and text are read.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    units = _units_of(docs)
    place = F.struct("doc_id", "line", "tag", "nr", "n_lines")
    firsts = stored(units.groupBy("key").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("copies")))

    def texts_of(keys: DataFrame) -> DataFrame:
        need = keys.join(firsts, "key")
        need = stored(need.select(F.col("at.doc_id").alias("d"), F.col("at.tag").alias("t"), F.struct("at.line", "at.n_lines", "key").alias("x"))
                      .groupBy("d", "t").agg(F.collect_list("x").alias("xs")))
        found = texts.join(sized(need), texts.doc_id.eqNullSafe(F.col("d")) & (texts.tag == F.col("t")))
        found = found.select(F.split("text", "\n").alias("lines"), F.explode("xs").alias("x")).select(
            "x.key", F.array_join(F.slice("lines", F.col("x.line") + 1, F.col("x.n_lines")), "\n").alias("text"))
        return found.dropDuplicates(["key"])

    def sets_of(keys: DataFrame) -> DataFrame:
        return texts_of(keys).mapInArrow(shingle_sets(WORDS, weighted=False), SETS)

    _, comp = link_near(units.where(F.col("n_words") >= LEAST_WORDS).select("key", F.explode("bands").alias("band")), sets_of, SIMILARITY)
    known = firsts.join(comp, "key", "left").select("key", "at", "copies", F.coalesce("comp", "key").alias("comp"))
    classes = known.groupBy("comp").agg(F.min("at").alias("head"), F.sum("copies").alias("n")).where("n > 1")
    marked = known.join(classes, "comp").select("key", "comp", "head")
    rows = units.join(marked, "key")
    same = F.col("nr") == F.col("head.nr")
    first = same & (F.col("line") == F.col("head.line")) & (F.col("n_lines") == F.col("head.n_lines"))
    overlaps = (same & (F.col("line") < F.col("head.line") + F.col("head.n_lines")) & (F.col("head.line") < F.col("line") + F.col("n_lines")))
    rows = stored(rows.where(first | ~overlaps).select("doc_id", "nr", "line", "n_words", F.col("head.doc_id").alias("class_doc_id"),
                                                       F.col("head.line").alias("class_line"), (~first).alias("removed"), "n_lines", "comp"))
    # a short paragraph counts only beside one that repeats as well
    beside = rows.where(F.col("n_words") >= LEAST_WORDS).select(F.col("nr").alias("of"), F.explode(F.array(
        F.col("line") - 1, F.col("line") + F.col("n_lines"))).alias("by")).distinct()
    last = F.col("line") + F.col("n_lines") - 1
    kept = rows.where(F.col("n_words") < LEAST_WORDS).join(beside, (F.col("nr") == F.col("of")) & F.col("by").between(F.col("line"), last), "left_semi")
    rows = stored(rows.where(F.col("n_words") >= LEAST_WORDS).unionByName(kept).drop("nr"))
    removed = rows.where("removed")
    # a head whose class holds nothing else than what overlaps it has no copy
    heads = rows.where("not removed").join(removed.select("comp").distinct(), "comp", "left_semi")
    return removed.unionByName(heads).drop("comp").unionByName(repeated_passages(docs).withColumn("n_lines", F.lit(None).cast("int")))
