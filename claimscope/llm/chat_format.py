"""Chat formatting as a prefix tree: shared initial turns once, depth-first, with positions and attention intervals.

A node is a distinct sequence of initial turns; it holds its last turn, formatted. A turn is
``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts are broken by an
escape after their first character (and the escape character is doubled), so that none is left
and the original comes back exactly. Tokens are code points of the formatted turn.

Trees are laid out depth-first by the order of their node paths, over range partitions: a hot
tree is spread over partitions, whose totals give each its offset. A node's tokens take the
layout places [start, start + n); its position ids start at the summed length of its ancestors.
A node is visible to the places [start, subtree_end), which holds exactly its own tokens and
those of its descendants: so a token attends, causally, to all nodes whose interval holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"([<\[])(?=\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>|<SYS>>|</SYS>>)"


def escaped(column):
    return F.regexp_replace(F.replace(F.coalesce(column, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\-")


def unescaped(column):
    return F.regexp_replace(column, r"\\(?:(\\)|-)", "$1")


def special_conversation(conversations: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant turn that hold control strings."""
    spark = conversations.sparkSession
    rows = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    return rows.select(*[F.col(c).cast(conversations.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text")])


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths).

    nodes: node, parent, root, depth, role, formatted, text_start, text_end (code points of the
    escaped text inside ``formatted``: the loss mask of an assistant turn), n_tokens, position,
    start, subtree_end. paths: conv_id, place (0, 1, ..), node: each conversation's turns in order.
    Turns are ordered by turn, then role, then text (equal rows count separately); null roles and
    texts are empty; a null conv_id is a conversation of its own. Other columns are not read.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("place", F.row_number().over(order) - 1)
    # order-sensitive digest of the turns so far: running sums of 32-bit parts of each (place, turn) digest
    sha = F.sha2(F.concat_ws("\n", F.col("place").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    parts = [F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(5)]
    body = F.concat(F.lit(START), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END + "\n"))
    head = F.length(F.concat(F.lit(START), escaped(F.col("role")))) + 1
    shaped = placed.withColumn("formatted", body).withColumn("text_start", head).withColumn(
        "text_end", F.length("formatted") - len(END) - 1).withColumn("n_tokens", F.length("formatted").cast("bigint"))
    for i, part in enumerate(parts):
        shaped = shaped.withColumn(f"p{i}", part)
    sums = F.concat_ws("-", "place", *[F.sum(f"p{i}").over(upto).cast("string") for i in range(5)])
    chained = shaped.withColumn("node", F.substring(F.sha2(sums, 256), 1, 32))
    chained = (chained.withColumn("parent", F.lag("node").over(order)).withColumn("root", F.first("node").over(upto))
               .withColumn("position", F.sum("n_tokens").over(upto) - F.col("n_tokens"))
               # nodes sort depth-first by path: 12 hex digits of every ancestor, the node's own in full
               .withColumn("path", F.array_join(F.collect_list(F.substring("node", 1, 12)).over(upto), "")))
    paths = stored(chained.select("conv_id", "place", "node", "parent", "root", "path", "role", "formatted", "text_start", "text_end", "n_tokens", "position"))
    nodes = paths.select("node", "parent", "root", F.col("place").alias("depth"), "path", "role", "formatted",
                         "text_start", "text_end", "n_tokens", "position").dropDuplicates(["node"])
    ranged = stored(nodes.repartitionByRange("path", "node").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = totals.select("part", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("path", "node").rowsBetween(Window.unboundedPreceding, -1)
    laid = stored(ranged.join(F.broadcast(offsets), "part").withColumn(
        "start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("part", "ahead", "path"))
    # a subtree ends where the last conversation through its node ends
    steps = paths.select("conv_id", "place", "node").join(laid.select("node", (F.col("start") + F.col("n_tokens")).alias("end")), "node")
    ends = steps.withColumn("last", F.max("end").over(Window.partitionBy("conv_id"))).groupBy("node").agg(F.max("last").alias("subtree_end"))
    return laid.join(ends, "node"), paths.select("conv_id", "place", "node")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows sorted by conversation and place; hashes are fed turn by turn."""
    now, state, out = object(), None, []

    def close():
        if state:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for conv, role, text, size in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[4] += size
            if role == "assistant":
                state[2] += len(text)
                state[3].update(text.encode())
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], schema=_ARROW)
            out.clear()
    close()
    yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], schema=_ARROW)


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per conversation, what the tree's formatted turns and loss masks say (see _NAMES)."""
    head = F.substring("formatted", len(START) + 1, 1 << 30)
    role = unescaped(F.substring_index(head, "\n", 1))
    text = unescaped(F.col("formatted").substr(F.col("text_start") + 1, F.col("text_end") - F.col("text_start")))
    turns = nodes.select("node", role.alias("role"), text.alias("text"), "n_tokens")
    rows = paths.join(turns, "node").select(F.col("conv_id").cast("bigint").alias("conv_id"), "place", "role", "text", "n_tokens")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text", "n_tokens")
    return rows.mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
