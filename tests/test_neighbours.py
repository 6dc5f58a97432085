"""Exact nearest neighbours by pivots: against all distances, ties, repeated vectors, hot groups, nulls, empty input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimscope.operators import neighbours as N


def brute(x, y, k):
    """Purity over minority rows; rows that tie at the last distance share the places left."""
    shares = []
    for i in np.flatnonzero(y):
        d = ((x - x[i]) ** 2).sum(1).astype(float)
        d[i] = np.inf
        got = places = 0.0
        for level in np.unique(d[np.isfinite(d)]):
            at = d == level
            w = min(at.sum(), k - places)
            got, places = got + w * y[at].mean(), places + w
            if places == k:
                break
        if places:
            shares.append(got / places)
    return np.mean(shares)


def frame(spark, x, y):
    return spark.createDataFrame([([int(v) for v in r], int(t)) for r, t in zip(x, y)], "vec array<bigint>, minority int")


@pytest.mark.parametrize("pivots,block,queries", [(1, 2048, 4096), (9, 16, 8)])
def test_purity_equals_brute_force(spark, monkeypatch, pivots, block, queries):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "QUERIES", queries)
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-40, 40, (200, 3)), r.integers(900, 905, (60, 3)), np.tile([[7, 7, 7]], (80, 1))])
    y = r.integers(0, 4, len(x)) == 0
    row = N.neighbour_purity(frame(spark, x, y), k=5, pivots=pivots).first()
    assert (row.n_rows, row.n_minority) == (len(x), y.sum())
    assert row.purity == pytest.approx(brute(x, y, 5), abs=1e-9)


def test_purity_of_few_null_and_no_rows(spark):
    few = spark.createDataFrame([([0, 0], 1), ([3, 4], 0), (None, 1), ([1, None], 1)], "vec array<bigint>, minority int")
    assert tuple(N.neighbour_purity(few).first()) == (2, 1, 0.5, 0.0, 0.0)
    alone = N.neighbour_purity(few.limit(1)).first()
    assert (alone.n_rows, alone.purity) == (1, None)
    assert tuple(N.neighbour_purity(few.limit(0)).first()) == (0, 0, None, None, None)


def test_purity_over_many_cells_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-30, 30, (500, 2)), np.stack([np.arange(300) * 3, np.zeros(300, int)], 1), np.tile([[7, 7]], (40, 1)), [[10**6, -10**6]]])
    y = r.integers(0, 3, len(x)) == 0
    y[-1] = True
    assert N.neighbour_purity(frame(spark, x, y), k=5, pivots=40).first().purity == pytest.approx(brute(x, y, 5), abs=1e-9)


def test_met_points_are_merged_as_they_come(monkeypatch):
    monkeypatch.setattr(N, "HELD", 50)
    r = np.random.default_rng(2)
    x = np.unique(r.integers(0, 12, (400, 3)), axis=0)
    m, c = r.integers(1, 4, len(x)), r.integers(0, 2, len(x))
    points = pa.table({"vec": pa.array(x.tolist(), pa.list_(pa.int64())), "m": m, "c": c})
    got = N._Cell(points, 8, 5).meet(x[:20], np.full(20, N.FAR), 5)
    for q in range(20):
        d = ((x - x[q]) ** 2).sum(1)
        levels = [(v, m[d == v].sum(), c[d == v].sum()) for v in np.unique(d) if m[d < v].sum() <= 5]
        assert [tuple(row) for row in got.loc[got["q"] == q, ["d", "m", "c"]].to_numpy()] == levels


def test_a_query_is_sent_to_no_more_of_a_larger_table(spark, monkeypatch):
    """The rows sent from queries to the points they may be near to, on the same area with 8 times the points."""
    sent, kind = [], type(spark.range(1))
    checkpoint = kind.checkpoint

    def counted(self, *a, **b):
        out = checkpoint(self, *a, **b)
        if "vec" in out.columns and "m" not in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(kind, "checkpoint", counted)
    side = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_000)) for i in range(2)]
    for n in (4_000, 32_000):
        N.nearest_levels(spark.range(n).select(F.array(*side).alias("vec"), (F.col("id") % 4 == 0).cast("int").alias("minority")), pivots=2).count()
    assert len(sent) == 2 and sent[1] < 1.5 * 8 * sent[0], sent


def test_a_query_meets_no_more_blocks_of_a_larger_cell():
    r, met = np.random.default_rng(4), []
    for n in (1_000, 8_000):
        x = np.unique(r.integers(0, 100_000, (n, 2)), axis=0)
        cell = N._Cell(pa.table({"vec": pa.array(x.tolist(), pa.list_(pa.int64())), "m": np.ones(len(x), int), "c": np.ones(len(x), int)}), 16, 5)
        met.append(len(N._within(cell.nodes, cell.lo, cell.hi, cell.x, cell.bound(5))[0]) / len(x))
    assert met[1] < 1.3 * met[0] < 8, met
