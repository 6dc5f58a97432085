"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors.

Text likelihoods come from byte trigrams of a bounded sample of labelled documents (SAMPLE).
The declared language (html lang) and the address's language segment or suffix are evidence of
fixed reliability. Host priors are counts of the text's own verdict by grouped aggregation over
all pages, smoothed down the levels all pages > registered domain > host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import hash_sample, stored
from claimscope.llm.textnum import strings

LANGUAGES = ["de", "en", "es", "fr"]
SAMPLE, BUCKETS, STRENGTH = 1_000, 1 << 16, 20.0
DECLARED, SUFFIX = 0.9, 0.8           # reliability of the two declarations
MAX_EVIDENCE = 20.0                   # log-likelihood ratio that a text can give at most
DROP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every byte trigram inside a row."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    bucket = ((d[:-2] * 0x9E3779B1 + d[1:-1] * 0x85EBCA77 + d[2:] * 0xC2B2AE3D) >> 7) & (BUCKETS - 1)
    row = np.searchsorted(offsets, np.arange(len(bucket)), "right") - 1
    inside = np.arange(len(bucket)) + 3 <= offsets[1:][row]
    return row[inside], bucket[inside].astype(np.int64)


def _labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): trigrams of whole labelled texts."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, lang in enumerate(langs):
            data = np.frombuffer((batch.column(1)[i].as_py() or "").lower().encode(), np.uint8)
            bucket, n = np.unique(trigram_counts(data, np.array([0, len(data)]))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(bucket, pa.int64()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """(BUCKETS x languages) log-likelihoods, from ``sample`` labelled documents (least by hash of their text), read whole.

    Their trigrams are counted in the tasks; the driver gets one number per language and bucket.
    """
    rows = hash_sample(docs.where(F.col("lang").isin(LANGUAGES)).select("lang", "text"), sample, "text")
    found = rows.select("lang", "text").mapInArrow(_labelled_counts, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((BUCKETS, len(LANGUAGES)), 0.5)
    for r in found.collect():
        counts[r.bucket, LANGUAGES.index(r.lang)] += r.n
    return np.log(counts / counts.sum(0)).astype(np.float32)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Per page: page_id, lang, probability, text_lang, declared, suffix, host.

    Null html has no text (all text likelihoods equal), a null or odd url no host (''): such pages
    share one host. Equal scores go to the first language in alphabetical order. Languages outside
    the four are no evidence. Only page_id, url and html are read.
    """
    table = train(docs)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                text = pa.array([DROP.sub(" ", x.as_py() or "").lower() for x in part.column(3)], pa.string())
                data, offsets = strings(text)
                row, bucket = trigram_counts(data, offsets)
                scores = np.stack([np.bincount(row, table[bucket, k], part.num_rows) for k in range(len(LANGUAGES))], 1)
                scores = np.maximum(scores - scores.max(1, keepdims=True), -MAX_EVIDENCE)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(scores[:, k]) for k in range(len(LANGUAGES)))],
                                                 ["page_id", "host", "suffix", *(f"l_{x}" for x in LANGUAGES)])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))
    segment = F.coalesce(F.regexp_extract("url", r"^[^/]*//[^/]+/([a-z]{2})(?:[/?#]|$)", 1), F.lit(""))
    suffix = F.when(segment.isin(LANGUAGES), segment).otherwise(F.regexp_extract(host, r"\.([a-z]{2})$", 1))
    declared = F.lower(F.coalesce(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1), F.lit("")))
    rows = pages.select("page_id", host.alias("host"), F.concat(suffix, F.lit("|"), declared).alias("suffix"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = stored(rows.mapInArrow(likelihoods, f"page_id {kind}, host string, suffix string, " + ", ".join(f"l_{x} double" for x in LANGUAGES))
                    .withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    best = F.greatest(*[F.col(f"l_{x}") for x in LANGUAGES])
    verdict = F.coalesce(*[F.when(F.col(f"l_{x}") == best, F.lit(x)) for x in LANGUAGES])
    scored = scored.withColumn("text_lang", verdict)
    ones = [F.sum((F.col("text_lang") == x).cast("double")).alias(x) for x in LANGUAGES]
    hosts = stored(scored.groupBy("domain", "host").agg(*ones))
    level = lambda df, keys: df.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in LANGUAGES])
    everything, domains = level(hosts, []), level(hosts, ["domain"])
    total = lambda p: sum((F.col(f"{p}.{x}") for x in LANGUAGES), F.lit(0.0))
    smooth = lambda p, x, up: (F.col(f"{p}.{x}") + STRENGTH * up) / (total(p) + STRENGTH)
    priors = (hosts.alias("h").join(domains.alias("d"), "domain").crossJoin(F.broadcast(everything).alias("a"))  # one row
              .select("host", *[smooth("h", x, smooth("d", x, (F.col(f"a.{x}") + 1) / (total("a") + len(LANGUAGES)))).alias(f"p_{x}") for x in LANGUAGES]))
    evidence = lambda said, x, r: F.when(~said.isin(LANGUAGES), 0.0).when(said == x, float(np.log(r))).otherwise(float(np.log((1 - r) / 3)))
    said_suffix, said_declared = F.substring_index("suffix", "|", 1), F.substring_index("suffix", "|", -1)
    joined = scored.join(priors, "host")
    for x in LANGUAGES:
        joined = joined.withColumn(f"s_{x}", F.col(f"l_{x}") + F.log(f"p_{x}") + evidence(said_declared, x, DECLARED) + evidence(said_suffix, x, SUFFIX))
    top = F.greatest(*[F.col(f"s_{x}") for x in LANGUAGES])
    lang = F.coalesce(*[F.when(F.col(f"s_{x}") == top, F.lit(x)) for x in LANGUAGES])
    mass = sum((F.exp(F.col(f"s_{x}") - top) for x in LANGUAGES), F.lit(0.0))
    return joined.select("page_id", lang.alias("lang"), (1 / mass).alias("probability"), "text_lang",
                         said_declared.alias("declared"), said_suffix.alias("suffix"), "host")
