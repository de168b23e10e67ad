"""Neighbour sums by tile pairs against all pairs of points."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import dual_tiles as T
from cellweave.plans.tables import SOURCE, Tables

SCHEMA = "key bigint, x double, y double, m int, n array<bigint>"


def tables(spark, xy, n_sources, seed=0):
    n = np.random.default_rng(seed).integers(0, 5, (len(xy), 2))
    points = spark.createDataFrame([(i, float(x), float(y), 1, [int(v) for v in w]) for i, ((x, y), w) in enumerate(zip(xy, n))], SCHEMA)
    return points.filter(F.col("key") < n_sources).drop("n"), points.select("x", "y", "n"), n


def expected(xy, n, n_sources, radii):
    out = {}
    for r in radii:
        d = xy[:n_sources, None] - xy[None]
        near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] <= r * r
        out |= {(i, r): tuple(n[near[i]].sum(axis=0)) for i in range(n_sources) if near[i].any()}
    return out


def points(kind):
    rng = np.random.default_rng(7)
    if kind == "grid":  # many distances equal to a radius
        return np.stack(np.meshgrid(np.arange(20.0), np.arange(20.0)), -1).reshape(-1, 2)[rng.permutation(400)]
    if kind == "crowded":  # a third of all rows in one spot far narrower than a radius
        return np.concatenate([rng.normal(5, 1e-3, (150, 2)), rng.uniform(-20, 20, (250, 2))])[rng.permutation(400)]
    if kind == "copies":
        return np.repeat(rng.uniform(-3, 3, (20, 2)), 20, axis=0)[rng.permutation(400)]
    return rng.uniform(-1e-7, 1e-7, (400, 2)) + 1e6  # below the finest tile


@pytest.mark.parametrize("kind", ["grid", "crowded", "copies", "tiny"])
@pytest.mark.parametrize("least", [0, T.LEAST])
def test_sums_equal_all_pairs(spark, kind, least):
    xy, radii = points(kind), [5.0, 2.0, 0.0]
    sources, nodes, n = tables(spark, xy, 120)
    rows = T.radius_sums(sources, nodes, radii, ["key"], ["m"], 2, depth=6, split=4, least=least).collect()
    assert {(r["key"], r["radius"]): tuple(r["n"]) for r in rows} == expected(xy, n, 120, radii)
    assert len(rows) == len({(r["key"], r["radius"]) for r in rows}) and {r["m"] for r in rows} == {1}


def test_positions_without_number_and_empty_tables(spark):
    rows = [(1, 0.0, 0.0, 1, [1, 1]), (2, None, 0.0, 1, [9, 9]), (3, float("nan"), 0.0, 1, [9, 9]), (4, float("inf"), 0.0, 1, [9, 9]), (5, 1.0, 0.0, 1, [2, 0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = T.radius_sums(df.drop("n"), df.select("x", "y", "n"), [1.0], ["key"], ["m"], 2, least=0).collect()
    assert {r["key"]: r["n"] for r in got} == {1: [3, 1], 5: [3, 1]}
    none = df.limit(0)
    assert T.radius_sums(none.drop("n"), df.select("x", "y", "n"), [1.0], ["key"], ["m"], 2).count() == 0
    assert T.radius_sums(df.drop("n"), none.select("x", "y", "n"), [1.0], ["key"], ["m"], 2).count() == 0


def test_few_pairs_are_expanded(spark):
    """Radius 120 over 15,000 cells: at most a quarter of the pairs that the tiles around the sources hold are expanded."""
    cells = Tables(spark, "/root/testdata/sf0.1").cells
    nodes = cells.filter("included").select("x", "y")
    sources = cells.filter((F.col("label") == SOURCE) & F.col("included")).select("x", "y")
    side = 120.0 * (1 + 1e-9)
    s, t = (T._gridded(d, side / 2 ** T.DEPTH, tag).cache() for d, tag in ((sources, "s"), (nodes, "t")))
    expanded = {level: n for level, _, _, _, n in T.tile_pairs(s, t, [120.0], least=0)}
    xy, every = sources.toPandas().to_numpy(), nodes.toPandas().to_numpy()
    tiles, counts = np.unique(np.floor(every / side).astype(int), axis=0, return_counts=True)
    held = dict(zip(map(tuple, tiles), counts))
    whole = sum(held.get((i + a, j + b), 0) for i, j in np.floor(xy / side).astype(int) for a in (-1, 0, 1) for b in (-1, 0, 1))
    assert 0 < sum(expanded.values()) <= 0.25 * whole


@pytest.mark.parametrize("kind", ["grid", "crowded", "copies"])
def test_pairs_of_points_are_dealt_over_tasks_in_blocks(spark, kind, monkeypatch):
    """The rows are one small table: as many tasks as the pairs need look at them, and no pair of points is a row."""
    monkeypatch.setattr(T, "BLOCK", 16)
    monkeypatch.setattr(T, "MEET", 64)
    monkeypatch.setattr(T, "TASK_PAIRS", 1000)
    xy, radii = points(kind), [5.0, 2.0]
    sources, nodes, n = tables(spark, xy, 120)
    out = T.radius_sums(sources, nodes, radii, ["key"], ["m"], 2)
    s, t = (T._gridded(d, radii[0] * (1 + 1e-9) / 2 ** T.DEPTH, tag) for d, tag in ((sources, "s"), (nodes, "t")))
    (_, _, _, _, pairs), = T.tile_pairs(s, t, radii, split=T.PACKED_SPLIT, least=T.PACKED_LEAST)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert pairs > 5000 and "FlatMapGroupsInArrow" in plan and f", {-(-pairs // 1000)}" in next(r for r in plan.splitlines() if "RepartitionByExpression" in r)
    assert {(r["key"], r["radius"]): tuple(r["n"]) for r in out.collect()} == expected(xy, n, 120, radii)
