"""Suffix-array dedup: every byte covered by a 200-byte string that also starts elsewhere.

Candidates: every 200-byte window is represented by the least-hash 48-byte string in it (its
anchor), so equal windows share an anchor at the same place. An anchor's context is all that a
window around it can hold. Anchors that occur once, and contexts that are the same wherever the
anchor occurs, need no more work. Of the remaining contexts one of each content is shipped, once,
to the task of its anchor. There they are cut into pieces of 16 window starts; pieces that
share the 185 bytes all their windows hold form a group, over which an enhanced suffix array is built
and its common-prefix interval tree is scanned with a stack: every interval of 200 bytes or more
whose left neighbours differ is a maximal repeat group, with all its occurrences. An anchor of more
than GROUP different contexts is instead counted by digests: pieces of equal content are repeated as they are,
and one piece of each content that shares its 185 bytes with another content is split to single windows,
which are counted: exact as well, and no task holds them whole. Strings longer than a context come out as
overlapping spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import sized, stored
from claimscope.llm.textnum import U, mix, prefix_sums, range_hash, row_chunks, strings

LENGTH, ANCHOR, STARTS = 200, 48, 16
SPAN = LENGTH - ANCHOR          # window starts before an anchor
GROUP = 2_000
_LOW = U((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending places of the least-hash ANCHOR-byte strings (the first of equals) of all windows inside rows."""
    n, width = len(data), SPAN + 1
    if n < LENGTH:
        return np.zeros(0, np.int64)
    at = np.arange(n - ANCHOR + 1)
    v = (mix(range_hash(prefix_sums(data), at, at + ANCHOR)) & ~_LOW) | (at.astype(U) & _LOW)
    blocks = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, U)
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    p = np.arange(n - LENGTH + 1)
    row_end = offsets[1:][np.searchsorted(offsets, p, "right") - 1]
    p = p[p + LENGTH <= row_end]
    least = np.minimum(behind[p], ahead[p + width - 1]) & _LOW
    place = (p & ~int(_LOW)) + least.astype(np.int64)
    place += np.where(place < p, int(_LOW) + 1, 0)
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column(2))
        for i, j in row_chunks(offsets):
            part, rows = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
            a = anchors(part, rows)
            row = np.searchsorted(rows, a, "right") - 1
            lo, hi = np.minimum(a - rows[row], SPAN), np.minimum(rows[row + 1] - a, LENGTH)
            sums = prefix_sums(part)
            h = range_hash(sums, a, a + ANCHOR)
            c = mix(range_hash(sums, a - lo, a + hi) ^ mix(lo.astype(U) + U(1)))
            packed = ((a - rows[row]) << 16) | (lo << 8) | hi
            take = pa.array(row + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(packed)], ["h", "c", "doc_id", "tag", "packed"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, tag, text, xs: [h, c, big, s, e, a]) -> their contexts with the bytes of each."""
    for batch in batches:
        xs = batch.column(3)
        row = np.repeat(np.arange(len(xs)), pa.compute.list_value_length(xs).to_numpy(zero_copy_only=False))
        flat = xs.flatten()
        s, e = flat.field("s"), flat.field("e")
        raws = [t.encode() for t in batch.column(2).to_pylist()]
        whole = [raws[r][i:j] for r, i, j in zip(row.tolist(), s.to_pylist(), e.to_pylist())]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [flat.field("h"), flat.field("c"), flat.field("big"), batch.column(0).take(take), batch.column(1).take(take), s,
             pa.compute.subtract(flat.field("a"), s), pa.array(whole, pa.binary())], ["h", "c", "big", "doc_id", "tag", "s", "at", "whole"])


def pieces(whole: bytes, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(bytes that all its windows share, first, end) of the pieces of STARTS window starts of a context with its anchor at ``at``.

    Pieces lie at the same places before the anchor in every context, so equal windows are in pieces that share these bytes.
    """
    for grid in range(at - SPAN, at + 1, STARTS):
        first, last = max(grid, 0), min(grid + STARTS - 1, len(whole) - LENGTH)
        if first <= last:
            yield whole[grid + STARTS - 1: grid + LENGTH], first, last + LENGTH


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (h, c, doc_id, tag, s, at, whole) -> their pieces by digests: of the shared bytes (key) and of all bytes (p)."""
    def short(x: bytes) -> bytes:
        return hashlib.blake2b(x, digest_size=16).digest()

    for batch in batches:
        rows = [(short(core), short(whole[i:j]), h, c, doc, tag, s + i, i, j - i)
                for h, c, doc, tag, s, at, whole in zip(*(x.to_pylist() for x in batch.columns)) for core, i, j in pieces(whole, at)]
        cols = list(zip(*rows)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
            pa.binary(), pa.binary(), pa.int64(), pa.int64(), batch.schema.field(2).type, pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
            ["key", "p", "h", "c", "doc_id", "tag", "s", "i", "n"])


def interval_groups(parts: list[bytes], names: list[tuple] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups (length, [(part, offset)]) of LENGTH bytes or more among the parts.

    A part's edges count as different from anything, so repeats are maximal inside the parts.
    ``names`` (text, start) of the parts: a place that several parts hold is taken once.
    """
    once: dict = {}
    for i in sorted(range(len(parts)), key=lambda i: len(parts[i])):
        text, start = names[i] if names else (i, 0)
        for s in range(len(parts[i]) - LENGTH + 1):
            k = (text, start + s)
            if k not in once or len(parts[once[k][0]]) - once[k][1] < len(parts[i]) - s:
                once[k] = (i, s)
    places = list(once.values())
    if len(places) < 2:
        return []
    places.sort(key=lambda x: parts[x[0]][x[1]:])
    lcp = [0]
    for (i, s), (j, t) in zip(places, places[1:]):
        a, b = parts[i][s:], parts[j][t:]
        n = min(len(a), len(b))
        if a[:LENGTH] != b[:LENGTH]:
            lcp.append(0)
            continue
        while n > LENGTH and a[:n] != b[:n]:
            n -= 1
        lcp.append(n)
    left = [-1 - k if s == 0 else parts[i][s - 1] for k, (i, s) in enumerate(places)]
    out, stack = [], []  # open intervals: [length, first, least left, greatest left]
    for k in range(1, len(places) + 1):
        at = lcp[k] if k < len(places) else 0
        first, lows, highs = k - 1, left[k - 1], left[k - 1]
        while stack and stack[-1][0] > at:
            size, first, low, high = stack.pop()
            lows, highs = min(low, lows), max(high, highs)
            if lows != highs:
                out.append((size, [places[x] for x in range(first, k)]))
        if at >= LENGTH:
            if stack and stack[-1][0] == at:
                stack[-1][2], stack[-1][3] = min(stack[-1][2], lows), max(stack[-1][3], highs)
            else:
                stack.append([at, first, lows, highs])
    return out


def _trees(held: list) -> Iterator[tuple[bytes, list, list]]:
    """Contexts (doc_id, tag, start, anchor, bytes) of one anchor -> (shared bytes, pieces, their maximal repeat groups)."""
    by_core: dict = {}
    for doc, tag, s, at, whole in held:
        for core, i, j in pieces(whole, at):
            by_core.setdefault(core, []).append((whole[i:j], doc, tag, s + i))
    for core, parts in by_core.items():
        if len(parts) > 1 and (found := interval_groups([x[0] for x in parts], [((x[1], x[2]), x[3]) for x in parts])):
            yield core, parts, found


def _by_anchor(batches: Iterator[pa.RecordBatch], close) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor -> what ``close`` makes of the contexts of each; one anchor is held at a time."""
    now, held, kind = None, [], None
    for batch in batches:
        kind, out = batch.schema.field(1).type, []
        for h, *context in zip(*(c.to_pylist() for c in batch.columns)):
            if h != now:
                out += close(held)
                now, held = h, []
            held.append(context)
        if out:
            yield _occurrences(out, kind)
    if out := list(close(held)):
        yield _occurrences(out, kind)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor -> every occurrence (group, length, doc_id, tag, start) of their maximal repeats."""
    def close(held):
        for core, parts, found in _trees(held):
            name = hashlib.blake2b(core, digest_size=16).digest()
            for g, (size, at) in enumerate(found):
                group = name + g.to_bytes(4, "big")
                yield from ((group, size, parts[i][1], parts[i][2], parts[i][3] + s) for i, s in at)

    return _by_anchor(batches, close)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor -> the bytes that occurrences of their maximal repeats cover, as runs (null, length, doc_id, tag, start)."""
    def close(held):
        longest: dict = {}
        for _, parts, found in _trees(held):
            for size, at in found:
                for i, s in at:
                    place = (parts[i][1:3], parts[i][3] + s)
                    if longest.get(place, 0) < size:
                        longest[place] = size
        by_text: dict = {}
        for (text, s), size in longest.items():
            by_text.setdefault(text, []).append((s, s + size))
        for (doc, tag), spans in by_text.items():
            spans.sort()
            first, end = spans[0]
            for s, e in spans:
                if s > end:
                    yield None, end - first, doc, tag, first
                    first = s
                end = max(end, e)
            yield None, end - first, doc, tag, first

    return _by_anchor(batches, close)


def _occurrences(rows, kind):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), kind, pa.int64(), pa.int64()))],
                                      ["group", "length", "doc_id", "tag", "s"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, spans) of ``docs`` (doc_id, tag, text).

    groups: all occurrences (group, length, doc_id, tag, s) of the maximal repeats found by the
    interval trees, listed when read; spans (doc_id, tag, s, e): all repeated bytes, overlapping.
    Both sides of the joins grow with the documents, so they are merge joins at every size (AQE splits hot keys).
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    found = stored(docs.select("doc_id", "tag", "text").mapInArrow(_anchor_rows, f"h bigint, c bigint, doc_id {doc_type}, tag bigint, packed bigint"))
    twice = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1")
                   .select("h", (F.col("c1") != F.col("c2")).alias("mixed")))
    rows = stored(found.join(twice.hint("merge"), "h"))
    pos = F.shiftright("packed", 16)
    lo, hi = F.shiftright("packed", 8).bitwiseAND(255), F.col("packed").bitwiseAND(255)
    rows = rows.select("h", "c", "mixed", "doc_id", "tag", (pos - lo).alias("s"), (pos + hi).alias("e"), pos.alias("a"))
    mixed = rows.where("mixed")
    place = F.struct("doc_id", "tag", "s", "e", "a")
    contexts = stored(mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")))
    whole = rows.where("not mixed").select("doc_id", "tag", "s", "e").unionByName(
        mixed.join(contexts.where("n > 1").select("h", "c").hint("merge"), ["h", "c"]).select("doc_id", "tag", "s", "e"))

    hot = stored(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("h", F.lit(True).alias("hot")))
    need = contexts.join(sized(hot), "h", "left").select(
        "at.doc_id", "at.tag", F.struct("h", "c", F.col("hot").isNotNull().alias("big"), "at.s", "at.e", "at.a").alias("x"))
    need = need.groupBy("doc_id", "tag").agg(F.collect_set("x").alias("xs")).select(
        F.col("doc_id").alias("d"), F.col("tag").alias("t"), "xs")
    texts = docs.join(need.hint("merge"), docs.doc_id.eqNullSafe(F.col("d")) & (docs.tag == F.col("t"))).select("doc_id", "tag", "text", "xs")
    texts = stored(texts.mapInArrow(
        _contexts, f"h bigint, c bigint, big boolean, doc_id {doc_type}, tag bigint, s bigint, at bigint, whole binary"))
    # equal rows give equal contexts
    small = texts.where("not big").select("h", "doc_id", "tag", "s", "at", "whole")
    small = small.repartition("h").sortWithinPartitions("h")
    occurrences = f"group binary, length bigint, doc_id {doc_type}, tag bigint, s bigint"
    covered = stored(small.mapInArrow(_covered, occurrences))
    large = texts.where("big").select("h", "c", "doc_id", "tag", "s", "at", "whole")
    cut = stored(large.mapInArrow(
        _digests, f"key binary, p binary, h bigint, c bigint, doc_id {doc_type}, tag bigint, s bigint, i bigint, n bigint")
        .groupBy("key", "p", "doc_id", "tag", "s", "n").agg(F.min(F.struct("h", "c", "i")).alias("at")))
    contents = stored(cut.groupBy("key", "p").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("at", "doc_id", "tag", "s", "n")).alias("x")))
    alike = cut.join(contents.where("k > 1").select("key", "p"), ["key", "p"])
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    one = contents.join(several, "key").select("x.at.*", "x.doc_id", "x.tag", "x.s", "x.n")
    held = large.groupBy("h", "c").agg(F.min("whole").alias("whole"))
    starts = F.explode(F.sequence(F.lit(0), F.col("n") - LENGTH))
    single = stored(one.join(held, ["h", "c"]).select("doc_id", "tag", "s", "i", "whole", starts.alias("j")).select(
        F.unhex(F.md5(F.substring("whole", (F.col("i") + F.col("j") + 1).cast("int"), F.lit(LENGTH)))).alias("w"),
        "doc_id", "tag", (F.col("s") + F.col("j")).alias("s")).distinct())
    again = single.join(single.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "w")
    spans = (whole.unionByName(covered.select("doc_id", "tag", "s", (F.col("s") + F.col("length")).alias("e")))
             .unionByName(alike.select("doc_id", "tag", "s", (F.col("s") + F.col("n")).alias("e")))
             .unionByName(again.select("doc_id", "tag", "s", (F.col("s") + LENGTH).alias("e"))))
    return small.mapInArrow(_groups, occurrences), spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, text, xs: [s, e]) -> what is left of each without the bytes of its spans."""
    for batch in batches:
        data, offsets = strings(batch.column(1))
        xs, n = batch.column(2), batch.num_rows
        row = np.repeat(np.arange(n), pa.compute.fill_null(pa.compute.list_value_length(xs), 0).to_numpy(zero_copy_only=False))
        flat = xs.flatten()
        s, e = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[row] for c in ("s", "e"))
        order = np.lexsort((s, row))
        row, s, e = row[order], s[order], np.maximum.accumulate(e[order]) if len(order) else e
        new = np.append(True, (row[1:] != row[:-1]) | (s[1:] > e[:-1])) if len(s) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        row, s, e = row[at], s[at], e[np.append(at[1:], len(e)) - 1] if len(at) else e
        removed = np.bincount(row, e - s, n).astype(np.int64)
        raw, digests = memoryview(np.ascontiguousarray(data)), []
        bounds = np.searchsorted(row, np.arange(n + 1)).tolist()
        starts, ends, o = s.tolist(), e.tolist(), offsets.tolist()
        for i in range(n):
            kept, p = hashlib.sha256(), o[i]
            for k in range(bounds[i], bounds[i + 1]):
                kept.update(raw[p: starts[k]])
                p = ends[k]
            kept.update(raw[p: o[i + 1]])
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(removed), pa.array(np.diff(np.array(bounds))), pa.array(digests)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (remaining bytes).

    Null and empty texts have no bytes. Equal rows are copies of each other, so all their bytes
    go if they have 200 or more. Only doc_id and text are read.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    _, spans = repeats(texts)
    by_doc = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("s", "e")).alias("xs")).select(
        F.col("doc_id").alias("d"), F.col("tag").alias("t"), "xs")
    joined = texts.join(by_doc.hint("merge"), texts.doc_id.eqNullSafe(F.col("d")) & (texts.tag == F.col("t")), "left").select("doc_id", "text", "xs")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(_cut, schema)
