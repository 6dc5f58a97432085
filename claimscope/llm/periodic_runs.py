"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q, at least three periods and 24 words long, that no
neighbouring word extends. Its last two periods are a square that the next word does not continue, so
the two suffixes that start with its halves share exactly q words: they part at one place of
the LCP array, between two children of an interval of depth q. The intervals are found by one stack
scan of the LCP array (no tree nodes are built). At every parting place the suffixes i of its smaller side
are tested: is the rank ISA[i + q] or ISA[i - q] on the other side? Each suffix is on a smaller
side at most log n times. The squares found are rotated to the left while their period holds, and squares
that rotate into the same stretch are one run, of the least period.

A document none of whose 8-word windows occurs twice in it has no run (a run repeats its first 8
words one period on), so the suffix array is built over the others only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import bound_batches
from claimscope.llm.textnum import NONSPACE, U, mix, prefix_sums, range_hash, row_chunks, strings, words

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the window that a document must repeat; below 2 / 3 of LEAST_WORDS, so that every run repeats one.
WINDOW = 8
#: Suffixes tested at once.
BLOCK = 1 << 21

RUN = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))


def repeating_rows(value: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Which rows hold a WINDOW-word window twice (a hash collision may add one, none is left out)."""
    found = np.zeros(n_rows, bool)
    if len(value) < WINDOW:
        return found
    m = len(value) - WINDOW + 1
    with np.errstate(over="ignore"):
        window = row[:m].astype(U)
        for j in range(WINDOW):
            window = mix(window * U(0x9E3779B97F4A7C15) + value[j: j + m])
    at = np.flatnonzero(row[:m] == row[WINDOW - 1:])
    at = at[np.argsort(window[at])]
    twice = window[at][1:] == window[at][:-1]
    found[row[at[1:][twice]]] = True
    return found


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal words only."""
    size = end - start
    offsets = np.append(0, np.cumsum(size))
    joined = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_array(ids: np.ndarray, row: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, LCP of each suffix with the one before) of all rows, a row's suffixes side by side.

    ``end`` is the end of each word's row. Prefix doubling that sorts only suffixes still tied; the ranks of each
    round are kept, and from the last on they give the LCP by its binary digits.
    """
    n = len(ids)
    key = row * (int(ids.max(initial=0)) + 1) + ids
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    head = np.maximum.accumulate(np.where(np.append(True, sorted_key[1:] != sorted_key[:-1]), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    rounds, h = [rank.astype(np.int32)], 1
    same = np.append(False, sorted_key[1:] == sorted_key[:-1])
    tied = np.flatnonzero(same | np.append(same[1:], False))
    while len(tied):
        member = sa[tied]
        ahead = member + h
        second = np.where(ahead < end[member], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[member] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        sa[tied] = member[order]
        new = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[sa[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rounds.append(rank.astype(np.int32))
        tied = tied[~new | np.append(~new[1:], False)]
        h *= 2
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1], sa[1:]
    pair = np.flatnonzero(row[a] == row[b])
    a, b = a[pair], b[pair]
    shared = np.zeros(len(pair), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (x < end[a]) & (y < end[b])
        equal = inside & (rounds[k][np.minimum(x, n - 1)] == rounds[k][np.minimum(y, n - 1)])
        shared[equal] += 1 << k
    lcp[pair + 1] = shared
    return sa, isa, lcp


def partings(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place k, first, last) for every LCP value above 0: the suffixes first..k-1 and k..last part at this depth.

    One stack scan. Of equal values the later one takes the earlier one's suffixes as its left side, so two suffixes
    part at exactly one place.
    """
    first, last = np.zeros(len(lcp), np.int64), np.zeros(len(lcp), np.int64)
    stack, depth = [0], [-1]
    for k, value in enumerate(lcp.tolist()):
        if not k:
            continue
        while depth[-1] >= value and len(stack) > 1:
            last[stack.pop()] = k - 1
            depth.pop()
        first[k] = stack[-1]
        stack.append(k)
        depth.append(value)
    for k in stack[1:]:
        last[k] = len(lcp) - 1
    place = np.flatnonzero(lcp > 0)
    return place, first[place], last[place]


def squares(ids: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching squares: words [i, i + q) equal [i + q, i + 2q), and the next word breaks the period."""
    sa, isa, lcp = suffix_array(ids, row, end)
    place, first, last = partings(lcp)
    depth = lcp[place]
    fits = LEAST_PERIODS * depth <= (end - begin)[sa[place]]
    place, first, last, depth = place[fits], first[fits], last[fits], depth[fits]
    left = place - first <= last - place + 1
    lo, hi = np.where(left, first, place), np.where(left, place, last + 1)          # the smaller side
    other_lo, other_hi = np.where(left, place, first), np.where(left, last + 1, place)
    size = hi - lo
    total = np.append(0, np.cumsum(size))
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    x = 0
    while x < len(size):
        y = max(x + 1, int(np.searchsorted(total, total[x] + BLOCK, "right")) - 1)
        node = np.repeat(np.arange(x, y), size[x:y])
        i = sa[np.arange(total[x], total[y]) - total[node] + lo[node]]
        q = depth[node]
        for partner, at in ((i + q, i), (i - q, i - q)):
            near = (partner >= begin[i]) & (partner < end[i])
            r = isa[np.clip(partner, 0, len(isa) - 1)]
            hit = near & (r >= other_lo[node]) & (r < other_hi[node])
            starts.append(at[hit])
            periods.append(q[hit])
        x = y
    return np.concatenate(starts), np.concatenate(periods)


def rotate(ids: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How many words each square can be rotated to the left: the words before it that continue its period backwards."""
    moved = np.zeros(len(start), np.int64)
    open_, step = np.arange(len(start)), 8
    while len(open_):
        width = max(1, min(step, BLOCK // len(open_)))
        at = start[open_, None] - 1 - moved[open_, None] - np.arange(width)
        holds = at >= begin[start[open_], None]
        at = np.maximum(at, 0)
        holds &= ids[at] == ids[at + period[open_, None]]
        whole = holds.all(axis=1)
        moved[open_] += np.where(whole, width, holds.argmin(axis=1))
        open_, step = open_[whole], step * 2
    return moved


def runs(ids: np.ndarray, row: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, as places in ``ids``, by start, then period."""
    ends = np.cumsum(n_words)
    end, begin = ends[row], (ends - n_words)[row]
    start, period = squares(ids, row, begin, end)
    near = np.flatnonzero(start > begin[start]) if len(start) else np.zeros(0, np.int64)
    near = near[ids[start[near] - 1] == ids[start[near] + period[near] - 1]]      # a square alone is no run
    stop = start + 2 * period
    near = near[np.lexsort((period[near], stop[near]))]
    start, period, stop = start[near], period[near], stop[near]
    found = []
    while len(start):
        # of the squares that end at one place, the least period first: it takes those inside its stretch
        lead = np.append(True, stop[1:] != stop[:-1])
        which = np.cumsum(lead) - 1
        reach = start[lead] - rotate(ids, begin, start[lead], period[lead])
        long = stop[lead] - reach >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period[lead])
        found.append(np.stack([reach, stop[lead], period[lead]])[:, long])
        left = ~lead & (start < reach[which])
        start, period, stop = start[left], period[left], stop[left]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    out = np.concatenate(found, axis=1)
    return tuple(out[:, np.lexsort((out[2], out[0]))])


def planted(n: int, h: int) -> np.ndarray:
    """The word numbers of a text of n words whose end repeats p of its words, both chosen by h."""
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def chunk_runs(data: np.ndarray, offsets: np.ndarray, h: np.ndarray | None) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
    """(words per row, (row, start, length, period) of the runs, collapsed bytes, their offsets) of some rows."""
    start, end, n_words = words(data, offsets, NONSPACE)
    n_rows = len(n_words)
    row = np.repeat(np.arange(n_rows), n_words)
    first = np.cumsum(n_words) - n_words
    if h is not None:
        order = np.arange(len(start))
        for r in np.flatnonzero((h % 10 == 0) & (n_words > 0)):
            order[first[r]: first[r] + n_words[r]] = first[r] + planted(int(n_words[r]), int(h[r]))
        start, end = start[order], end[order]
    kept = np.ones(len(start), bool)
    open_ = repeating_rows(range_hash(prefix_sums(data), start, end), row, n_rows)
    at = np.flatnonzero(open_[row]) if len(row) else np.zeros(0, np.int64)
    found = (np.zeros(0, np.int64),) * 4
    if len(at):
        ids = word_ids(data, start[at], end[at])
        own = np.cumsum(open_)[row[at]] - 1
        s, e, q = runs(ids, own, n_words[open_])
        dropped = np.zeros(len(at) + 1, np.int64)
        np.add.at(dropped, s + q, 1)
        np.add.at(dropped, e, -1)
        kept[at] = np.cumsum(dropped[:-1]) == 0
        r = row[at[s]]
        found = (r, at[s] - first[r], e - s, q)
    start, end, row = start[kept], end[kept], row[kept]
    size = end - start + 1
    out_end = np.cumsum(size)
    source = np.arange(out_end[-1] if len(size) else 0) + np.repeat(start - (out_end - size), size)
    text = np.append(data, np.uint8(0x20))[np.minimum(source, len(data))]
    text[out_end - 1] = 0x20
    per_row = np.bincount(row, size, n_rows).astype(np.int64)
    last = np.cumsum(per_row)[per_row > 0] - 1                                     # the blank after a row's last word
    text = np.delete(text, last)
    return n_words, found, text, np.append(0, np.cumsum(np.maximum(per_row - 1, 0)))


def collapse_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words kept, one blank between).

    A word goes if a run holds it after that run's first period. ``plant`` first turns the end of the texts with
    crc32(doc_id) divisible by 10 into a repetition, to have runs of known shape. Words are what white space
    leaves; a null or empty text has none, no runs and an empty collapse. A null doc_id counts as the
    empty string. Only doc_id and text are read; repeated rows are rows of their own, an empty table gives an empty
    one. A text is one row of one task; it takes some 30 numbers a word, and only if it repeats a window.
    """
    bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            h = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in row_chunks(offsets):
                n_words, (row, start, length, period), text, at = chunk_runs(
                    data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], h[i:j] if plant else None)
                count = np.append(0, np.cumsum(np.bincount(row, minlength=j - i)))
                each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                collapsed = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), each), collapsed.cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUN),
                           T.StructField("collapsed", T.StringType())])
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h")
    return docs.select("doc_id", "text", h).mapInArrow(run, schema)


def report(collapsed: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest exponent (exact; ties by start, then period) and digests of ``collapse_runs``."""
    best = F.reduce("runs", F.lit(None).cast(RUN.elementType), lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("top"), F.sha2(listed, 256).alias("runs_sha256"),
                           F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "top.start", "top.length", "top.period",
                      F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
