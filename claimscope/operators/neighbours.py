"""Neighbour purity (X4): exact k nearest neighbours by cells and distance bounds.

Points are integer vectors, so squared distances are exact and ties are real. Equal vectors are
one point with a weight. A bounded sample of the points, halved again and again at medians, cuts the space into
cells of about CELL points each, and the task of a cell halves its points on into blocks. A query first meets
the block it lies in, whose k + 1 least distances bound how far its neighbours can be, then the blocks of its cell within that bound, and is
sent on only to the other cells within the bound left over. So a query meets a few blocks whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import ensure_checkpoint_dir, tasks_for

K = 5
CELL = 16_384         # points of a cell, about
CELLS = 4_096         # cells at most, beyond which they grow; any number gives the same result
SAMPLE = 32           # sampled points a cell, by hash
BLOCK = 256           # points of a block
QUERIES = 4_096       # queries from other cells that meet a cell in one task, about
HELD = 1 << 20        # met points held before they are merged to levels
FAR = np.iinfo(np.int64).max


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer matrices."""
    out = np.zeros((len(x), len(y)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return out


def _parts(n: int, width: int = 1_024) -> Iterator[slice]:
    return (slice(i, i + width) for i in range(0, n, width))


def _cut(x: np.ndarray, least: int) -> tuple[int, int] | None:
    """(column, value): rows up to the value and above it, halved well in as wide a column as does; None if no cut leaves ``least`` rows to both."""
    best = None
    for axis in np.argsort(-np.ptp(x, axis=0), kind="stable"):
        v = np.sort(x[:, axis])
        for n in (np.searchsorted(v, v[len(v) // 2], side) for side in ("left", "right")):
            few = min(n, len(v) - n)
            if few >= least and (best is None or few > best[0]):
                best = (few, axis, v[n - 1])
        if best is not None and best[0] * 4 >= len(v):
            break
    return best and best[1:]


def _halved(x: np.ndarray, most: int, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows cut until a part has ``most`` at most: the nodes (column, value, node up to it, node above it; a leaf: -1, its number) and each leaf's rows."""
    nodes, leaves, todo = [None], [], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        cut = _cut(x[rows], least) if len(rows) > most else None
        if cut is None:
            nodes[node] = (-1, len(leaves), 0, 0)
            leaves.append(rows)
            continue
        up = x[rows, cut[0]] > cut[1]
        nodes[node] = (*cut, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), rows[~up]), (len(nodes) + 1, rows[up])]
        nodes += [None, None]
    return np.array(nodes, np.int64), leaves


def _leaves(nodes: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, leaf): the leaves whose side of every cut is within squared distance ``bound`` of the row; for bound -1 the one it lies in."""
    rows, leaves = [], []
    row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(row):
        axis, value, low, high = nodes[at].T
        ends = axis < 0
        rows.append(row[ends])
        leaves.append(value[ends])
        row, axis, value, low, high = (a[~ends] for a in (row, axis, value, low, high))
        over = x[row, axis] - value
        down, up = (over <= 0) | (over ** 2 <= bound[row]), (over > 0) | ((1 - over) ** 2 <= bound[row])
        row, at = np.concatenate([row[down], row[up]]), np.concatenate([low[down], high[up]])
    return np.concatenate([*rows, row]), np.concatenate([*leaves, row])


def _within(nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, leaf): the leaves whose box, from ``lo`` to ``hi``, is within squared distance ``bound`` of the row."""
    row, leaf = _leaves(nodes, x, bound)
    gap = np.maximum(np.maximum(lo[leaf] - x[row], x[row] - hi[leaf]), 0)
    near = (gap ** 2).sum(axis=1) <= bound[row]
    return row[near], leaf[near]


def _levels(met: list[np.ndarray], k: int) -> pd.DataFrame:
    """(q, d, m, c): what queries met, by distance, each query's as far as it takes to reach k + 1 rows."""
    q, d, m, c = np.concatenate([np.zeros((4, 0), np.int64), *met], axis=1)
    levels = pd.DataFrame({"q": q, "d": d, "m": m, "c": c}).groupby(["q", "d"], as_index=False).sum()
    return levels[levels.groupby("q")["m"].cumsum() - levels["m"] <= k]


class _Cell:
    """The points of a cell, block by block."""

    def __init__(self, points: pa.Table, block: int, k: int):
        x = _matrix(points["vec"])
        self.nodes, leaves = _halved(x, block, k + 1)
        self.order = np.concatenate(leaves)
        self.x, self.m, self.c = x[self.order], points["m"].to_numpy()[self.order], points["c"].to_numpy()[self.order]
        ends = np.cumsum([len(rows) for rows in leaves])
        self.blocks = [slice(end - len(rows), end) for end, rows in zip(ends, leaves)]
        self.lo, self.hi = (np.array([f(self.x[b], axis=0) for b in self.blocks]) for f in (np.min, np.max))

    def bound(self, k: int) -> np.ndarray:
        """For each point with minority rows a squared distance within which its block has k + 1 rows; FAR if it has fewer."""
        out = []
        for b in self.blocks:
            d = _distances(self.x[b][self.c[b] > 0], self.x[b])
            near = np.argpartition(d, k, axis=1)[:, :k + 1] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
            full = np.cumsum(self.m[b][near], axis=1) > k
            at = np.take_along_axis(near, full.argmax(axis=1)[:, None], 1)
            out.append(np.where(full[:, -1], np.take_along_axis(d, at, 1)[:, 0], FAR))
        return np.concatenate(out)

    def meet(self, x: np.ndarray, bound: np.ndarray, k: int) -> pd.DataFrame:
        """(q, d, m, c): for queries, the rows of ``x``, the weights of the points at each squared distance up to ``bound``."""
        out = [_levels([], k)]
        for part in _parts(len(x)):
            met, held = [], 0
            row, block = _within(self.nodes, self.lo, self.hi, x[part], bound[part])
            for nr in np.unique(block):
                q, b = row[block == nr] + part.start, self.blocks[nr]
                d = _distances(x[q], self.x[b])
                i, j = np.nonzero(d <= bound[q, None])
                met.append(np.stack([q[i], d[i, j], self.m[b][j], self.c[b][j]]))
                held += len(i)
                if held > HELD:
                    met, held = [_levels(met, k).to_numpy().T], 0
            out.append(_levels(met, k))
        return pd.concat(out)


def _assign(nodes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = _leaves(nodes, _matrix(batch.column(0)), np.full(len(batch), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[np.argsort(row)])], ["vec", "m", "c", "cell"])

    return run


def _home(k: int, block: int):
    """Points of a cell -> its queries' levels there, with ``far``: the squared distance of the last of k + 1 rows, FAR if the cell has fewer."""
    def run(points: pa.Table) -> pa.Table:
        cell = _Cell(points, block, k)
        asks = np.flatnonzero(cell.c > 0)
        levels = cell.meet(cell.x[asks], cell.bound(k), k)
        seen = levels.groupby("q").agg({"m": "sum", "d": "max"})           # every query meets itself
        far = np.where(seen["m"] > k, seen["d"], FAR)
        q = levels["q"].to_numpy()
        at = pa.array(cell.order[asks][q])
        return pa.table({"vec": points["vec"].take(at), "own_c": cell.c[asks][q], "cell": points["cell"].take(at), "far": far[q],
                         **{n: levels[n].to_numpy() for n in ("d", "m", "c")}})

    return run


def _reach(nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Queries (vec, own_c, cell, far) -> the same with each other cell that can hold a point within ``far``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = batch.column(3).to_numpy()
            row, cell = _within(nodes, lo, hi, _matrix(batch.column(0)), far)
            other = cell != batch.column(2).to_numpy()[row]
            row = pa.array(row[other])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(cell[other]), batch.column(3).take(row)],
                                             ["vec", "own_c", "cell", "far"])

    return run


def _visit(k: int, block: int):
    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        x = _matrix(queries["vec"])
        levels = _Cell(points, block, k).meet(x, queries["far"].to_numpy(), k) if len(queries) and len(points) else _levels([], k)
        q = pa.array(levels["q"].to_numpy())
        return pa.table({"vec": queries["vec"].take(q), "own_c": queries["own_c"].take(q), **{n: levels[n].to_numpy() for n in ("d", "m", "c")}})

    return run


def _distinct(points: DataFrame) -> DataFrame:
    """(vec, m, c): the rows and minority rows of every vector without a null."""
    ensure_checkpoint_dir(points.sparkSession)
    points = points.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    return points.groupBy("vec").agg(F.count(F.lit(1)).alias("m"), F.sum(F.coalesce("minority", F.lit(0)).cast("long")).alias("c")).checkpoint()


def _nearest(merged: DataFrame, k: int, pivots: int | None) -> DataFrame:
    spark, n = merged.sparkSession, merged.count()
    if not n:
        return spark.createDataFrame([], "vec array<bigint>, own_c bigint, d bigint, m bigint, c bigint")
    wanted = pivots or min(CELLS, -(-n // CELL))
    sample = merged.where(F.pmod(F.xxhash64("vec"), F.lit(n)) < wanted * SAMPLE).select("vec").toArrow()   # bounded by the number of cells
    nodes, leaves = _halved(_matrix(sample["vec"]), -(-len(sample) // wanted), k + 1)
    tasks = tasks_for(spark, len(leaves), 1)
    placed = merged.mapInArrow(_assign(nodes), "vec array<bigint>, m bigint, c bigint, cell bigint").checkpoint()

    levels = home = placed.repartition(tasks, "cell").groupBy("cell").applyInArrow(
        _home(k, BLOCK), "vec array<bigint>, own_c bigint, cell bigint, far bigint, d bigint, m bigint, c bigint")
    if len(leaves) > 1:
        levels = home = home.checkpoint()
        side = [F.get("vec", F.lit(i)) for i in range(_matrix(sample["vec"]).shape[1])]
        boxes = placed.groupBy("cell").agg(F.array(*[F.min(s) for s in side]).alias("lo"), F.array(*[F.max(s) for s in side]).alias("hi")).orderBy("cell").toArrow()
        visits = home.where("d = 0").select("vec", "own_c", "cell", "far").mapInArrow(
            _reach(nodes, _matrix(boxes["lo"]), _matrix(boxes["hi"])), "vec array<bigint>, own_c bigint, cell bigint, far bigint").checkpoint()
        chunks = F.broadcast(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks")))   # a row per cell
        dealt = visits.join(chunks, "cell").select("cell", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int").alias("chunk"), "vec", "own_c", "far")
        copies = placed.join(chunks, "cell").select(
            F.col("cell").alias("of_cell"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("of_chunk"), "vec", "m", "c")
        met = (dealt.repartition(tasks, "cell", "chunk").groupBy("cell", "chunk")
               .cogroup(copies.repartition(tasks, "of_cell", "of_chunk").groupBy("of_cell", "of_chunk"))
               .applyInArrow(_visit(k, BLOCK), "vec array<bigint>, own_c bigint, d bigint, m bigint, c bigint"))
        levels = home.select("vec", "own_c", "d", "m", "c").union(met)

    levels = levels.groupBy("vec", "own_c", "d").agg(F.sum("m").alias("m"), F.sum("c").alias("c"))
    own = F.when(F.col("d") == 0, 1).otherwise(0)
    levels = levels.select("vec", "own_c", "d", (F.col("m") - own).alias("m"), (F.col("c") - own).alias("c"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("vec").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return levels.withColumn("before", before).where((F.col("before") < k) & (F.col("m") > 0)).drop("before")


def nearest_levels(points: DataFrame, k: int = K, pivots: int | None = None) -> DataFrame:
    """(vec, own_c, d, m, c): for every vector of a minority row the points at each of its least squared distances ``d``.

    ``points`` (vec array<bigint>, minority 0/1). m and c count the rows and minority rows at
    that distance, the row itself not among them; own_c is the number of minority rows of the vector. Levels
    go on until k rows are reached; a level is listed whole. Rows with a null vector, or a null in it, take no part.
    ``pivots`` is the number of cells wanted, by default one for each CELL vectors; the result is the same for any.
    """
    return _nearest(_distinct(points), k, pivots)


def neighbour_purity(points: DataFrame, k: int = K, pivots: int | None = None) -> DataFrame:
    """One row: n_rows, n_minority, base_rate, purity (mean share of minority among the k nearest rows of a minority row), lift.

    Where more rows tie at the last distance than places are left, they share the places. A row with
    fewer than k other rows is averaged over those there are; with none it takes no part. Empty input: zeros and nulls.
    """
    merged = _distinct(points)
    levels = _nearest(merged, k, pivots)
    before = F.coalesce(F.sum("m").over(Window.partitionBy("vec").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = levels.select("vec", "own_c", "m", "c", F.least(F.col("m"), F.lit(k) - before).alias("w"))
    rows = taken.groupBy("vec").agg(F.max("own_c").alias("own_c"), (F.sum(F.col("w") * F.col("c") / F.col("m")) / F.sum("w")).alias("share"))
    purity = rows.agg(F.try_divide(F.sum(F.col("share") * F.col("own_c")), F.sum("own_c")).alias("purity"))
    base = merged.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_minority"))
    return base.crossJoin(purity).select(
        "n_rows", "n_minority", F.try_divide("n_minority", "n_rows").alias("base_rate"), "purity",
        F.try_divide(F.col("purity"), F.try_divide("n_minority", "n_rows")).alias("lift"))
