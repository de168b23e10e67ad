"""Viewport sums from stored tiles against plain counting."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import atlas, quadtree

WINDOW = (0.0, 0.0, 100.0, 80.0)


def points(n, seed=3):
    """Spread points, a crowded spot of copies, points on bin edges and points beyond the window."""
    rng = np.random.default_rng(seed)
    spread = np.column_stack([rng.uniform(-5, 105, n), rng.uniform(-5, 85, n)])
    crowd = np.repeat([[40.0, 40.0]], n // 3, axis=0)
    edges = np.column_stack([np.repeat(np.arange(0, 101, 12.5), 9), np.tile(np.arange(0, 81, 10.0), 9)])
    return np.vstack([spread, crowd, edges])


def frame(spark, xy):
    rows = [(float(x), float(y), f"f{i % 3}") for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "x double, y double, feature string")


def counted(xy, bounds, grid):
    x0, y0, x1, y1 = bounds
    inside = xy[(xy[:, 0] >= x0) & (xy[:, 0] <= x1) & (xy[:, 1] >= y0) & (xy[:, 1] <= y1)]
    gx = np.minimum(grid - 1, ((inside[:, 0] - x0) / ((x1 - x0) / grid)).astype(int))
    gy = np.minimum(grid - 1, ((inside[:, 1] - y0) / ((y1 - y0) / grid)).astype(int))
    out = {}
    for k in zip(gx.tolist(), gy.tolist()):
        out[k] = out.get(k, 0) + 1
    return out


def bins(df):
    return {(r["gx"], r["gy"]): r["n"] for r in df.collect()}


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_density_and_totals_are_exact_for_any_depth(spark, tmp_path, depth):
    xy = points(1500)
    tree = quadtree.write_tree(str(tmp_path / "tree"), frame(spark, xy), WINDOW, depth)
    for bounds in (WINDOW, (12.5, 10.0, 62.5, 70.0), (-50.0, -50.0, 500.0, 500.0), (39.9, 39.9, 40.0, 40.0), (300.0, 300.0, 400.0, 400.0), (0.0, 33.3, 7.7, 33.4)):
        expected = counted(xy, bounds, 16)
        assert bins(quadtree.density(tree, bounds, 16)) == expected
        assert quadtree.total(tree, bounds).first()["n"] == sum(expected.values())


def test_a_tree_per_feature_and_rows_without_coordinates(spark, tmp_path):
    xy = points(900)
    layer = frame(spark, xy).unionByName(spark.createDataFrame(
        [(None, 1.0, "f0"), (1.0, None, "f0"), (float("nan"), 2.0, "f0"), (3.0, 3.0, None)], "x double, y double, feature string"))
    tree = quadtree.write_tree(str(tmp_path / "tree"), layer, WINDOW, 4, ["feature"])
    for i in range(3):
        assert bins(quadtree.density(tree.of(F.col("feature") == f"f{i}"), WINDOW, 16)) == counted(xy[i::3], WINDOW, 16)
    assert bins(quadtree.density(tree.of(F.col("feature").isNull()), WINDOW, 16)) == {(0, 0): 1}


def test_boxes_and_their_weights(spark, tmp_path):
    rng = np.random.default_rng(5)
    low = rng.uniform(0, 95, (800, 2))
    high = low + rng.exponential(2.0, (800, 2))
    vertices = rng.integers(3, 90, 800)
    layer = spark.createDataFrame([(*map(float, (a, c, b, d)), int(v)) for (a, b), (c, d), v in zip(low, high, vertices)],
                                  "minx double, maxx double, miny double, maxy double, vertex_count long")
    tree = quadtree.write_tree(str(tmp_path / "tree"), layer, WINDOW, 4, weights=["vertex_count"])
    for x0, y0, x1, y1 in (WINDOW, (10.0, 10.0, 30.0, 20.0), (50.0, 50.0, 50.5, 50.5), (1000.0, 0.0, 1001.0, 5.0)):
        hit = (high[:, 0] >= x0) & (low[:, 0] <= x1) & (high[:, 1] >= y0) & (low[:, 1] <= y1)
        row = quadtree.total(tree, (x0, y0, x1, y1)).first()
        assert (row["n"], row["vertex_count"]) == (hit.sum(), vertices[hit].sum())


def test_empty_layer(spark, tmp_path):
    tree = quadtree.write_tree(str(tmp_path / "tree"), spark.createDataFrame([], "x double, y double"), WINDOW, 3)
    assert quadtree.total(tree, WINDOW).first()["n"] == 0 and quadtree.density(tree, WINDOW, 16).count() == 0


def test_few_rows_are_looked_at(spark, tmp_path):
    n = 20_000
    rng = np.random.default_rng(9)
    xy = np.column_stack([rng.uniform(0, 100, n), rng.uniform(0, 80, n)])
    tree = quadtree.write_tree(str(tmp_path / "tree"), frame(spark, xy), WINDOW, quadtree.depth_for(n))
    bounds = (10.3, 10.3, 80.7, 70.7)
    inside = sum(counted(xy, bounds, 16).values())
    assert quadtree.rim_rows(tree, bounds).count() < 0.2 * inside


def test_stored_views(spark, tmp_path):
    xy = points(600)
    layer = frame(spark, xy)
    tree = quadtree.write_tree(str(tmp_path / "tree"), layer, WINDOW, 4)
    few = atlas.stored_view(layer, tree, (0.0, 0.0, 5.0, 5.0), limit=1000)
    assert few.mode == "exact_points" and few.records.count() == few.total
    many = atlas.stored_view(layer, tree, WINDOW, limit=10, grid=32)
    assert many.mode == "aggregate_density" and many.records.agg(F.sum("count")).first()[0] == many.total
    key = lambda r: (r["gx"], r["gy"], r["count"], r["x"], r["y"])
    assert sorted(map(key, many.records.collect())) == sorted(map(key, atlas.density_grid(layer, WINDOW, 32).collect()))
