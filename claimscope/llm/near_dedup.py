"""MinHash near-dedup by ProbMinHash: Poisson arrivals per weighted shingle, banding, exact verification.

The similarity is the probability Jaccard index of the five-word shingle counts (words are
runs of letters, digits and non-ASCII characters, A-Z lower-cased); for texts without repeated
shingles it equals the plain Jaccard index of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import digest, link_near, sized, stored
from claimscope.llm.similarity import SETS, shingle_sets
from claimscope.llm.textnum import U, mix, row_chunks, shingles, strings, weighted_sets

SIMILARITY = 0.8
WORDS = 5
#: 24 bands of 6 registers: a pair at exactly 0.8 shares a band with probability 0.9993.
BANDS, ROWS = 24, 6


def prob_minhash(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """(rows x registers) of the element that arrived first in each register.

    Every element is a Poisson process whose rate is its weight: each arrival falls in a random
    register, and the earliest arrival of a register names its element. All elements of a chunk
    take their next arrival together; an element stops once its arrival time exceeds the latest
    first arrival of its row, as no later one can matter. ``value`` must be distinct per row.
    """
    first = np.full(rows * registers, np.inf)
    sig = np.zeros(rows * registers, U)
    time = np.zeros(len(row))
    step = 0
    alive = np.arange(len(row))
    while len(alive):
        step += 1
        r = mix(value[alive] + U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        u = ((r >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time[alive] += -np.log(u) / weight[alive]
        slot = row[alive] * registers + (mix(r ^ U(0xD6E8FEB86659FD93)) % U(registers)).astype(np.int64)
        np.minimum.at(first, slot, time[alive])
        won = first[slot] == time[alive]
        sig[slot[won]] = value[alive[won]]
        latest = first.reshape(rows, registers).max(axis=1)
        alive = alive[time[alive] < latest[row[alive]]]
    return sig.reshape(rows, registers)


def band_keys(sig: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """(rows x bands) uint64 keys; the band's number is part of its key."""
    parts = sig.reshape(len(sig), bands, per_band)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]).copy()
    for j in range(per_band):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def _signatures(bands: int, per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in row_chunks(offsets):
                row, value, count = shingles(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], WORDS)
                row, value, weight = weighted_sets(row, value)
                has = np.flatnonzero(count > 0)
                sig = prob_minhash(row, value, weight.astype(float), j - i, bands * per_band)[has]
                keys = band_keys(sig, bands, per_band).view(np.int64)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(has) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(has)), flat], ["key", "bands"])
    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS,
                    per_band: int = ROWS) -> DataFrame:
    """One row per distinct text: (key, comp, rep, copies, class_id, n_links).

    key: 16-byte digest of the text; comp: the smallest key of its component, which alone tells classes
    apart; rep: the text's smallest doc_id; class_id: the smallest doc_id of its component, which
    unrelated classes share where doc_ids are null or repeated; n_links: links of the text to other texts that were verified to find the classes
    (they span each class; a class may hold more). Equal texts are one text
    (null counts as empty, which equals other empty texts); texts without words match only their
    equals. Rows that repeat a doc_id are copies like any other; null doc_ids leave rep null
    unless a copy has one. Only doc_id and text are read, so other columns can have any name.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest(F.col("text")).alias("key"))
    copies = stored(texts.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    signed = stored(texts.select("key", "text").mapInArrow(_signatures(bands, per_band), "key binary, bands array<bigint>"))
    exploded = signed.select("key", F.explode("bands").alias("band"))

    def sets_of(keys: DataFrame) -> DataFrame:
        need = stored(keys.join(copies, "key").select(F.col("key").alias("k"), "rep"))
        found = texts.join(sized(need), (texts.key == F.col("k")) & texts.doc_id.eqNullSafe(F.col("rep")))
        return found.select("key", "text").dropDuplicates(["key"]).mapInArrow(shingle_sets(WORDS), SETS)

    links, comp = link_near(exploded, sets_of, similarity)
    ends = links.select(F.col("a").alias("key")).unionAll(links.select(F.col("b").alias("key")))
    degree = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    known = comp.join(copies, "key")
    smallest = known.groupBy("comp").agg(F.min("rep").alias("class_id"))
    labelled = known.join(smallest, "comp").join(degree, "key", "left").select("key", "comp", F.col("class_id").alias("c"), "n_links")
    return copies.join(labelled, "key", "left").select(
        "key", F.coalesce("comp", "key").alias("comp"), "rep", "copies", F.coalesce("c", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, class_key (``comp`` in hex: equal for one class only; see near_duplicates)."""
    texts = stored(near_duplicates(docs))
    rows = docs.select("doc_id", digest(F.col("text")).alias("key"))
    return rows.join(texts.select("key", "class_id", "n_links", F.lower(F.hex("comp")).alias("class_key")), "key").select(
        "doc_id", "class_id", "n_links", "class_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of its smallest doc_id (of equal doc_ids, the least text digest).

    Classes are told apart by ``comp``; a class whose doc_ids are all null keeps the row of its least digest. All columns
    come back as they were, whatever their names; an empty table gives an empty one.
    """
    first = F.struct(F.col("rep").isNull().alias("none"), "rep", "key")  # a null doc_id only if the class has no other
    best = stored(near_duplicates(docs).groupBy("comp").agg(F.min(first).alias("at"))
                  .select(F.col("at.rep").alias("rep"), F.col("at.key").alias("key")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest(F.col("text")).alias("of"), F.col("doc_id").alias("id"))
    kept = rows.join(best, rows["of"].eqNullSafe(best["key"]) & rows["id"].eqNullSafe(best["rep"]))
    return kept.dropDuplicates(["of"]).select("row.*")
