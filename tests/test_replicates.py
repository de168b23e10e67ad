"""Permutation sums over packed pairs of row numbers against plain sums."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import ranking, replicates as R


@pytest.fixture(scope="module")
def moved(spark):
    """90 cells with 40 columns (two blocks), 4 replicates, and where each puts them."""
    rng = np.random.default_rng(2)
    n, y = 90, np.where(rng.random((90, 40)) < 0.4, rng.random((90, 40)), 0.0)
    index = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n) * 7, "idx": np.arange(n)}))
    placed = ranking.placements(index, 4, 3)
    table = np.zeros((5, n), int)
    for r in placed.collect():
        table[r["perm"], r["at"]] = r["frm"]
    return n, y, index, placed, table


def test_equal_first_words_are_ordered_by_the_second():
    h = np.array([[5, 9], [5, 2], [1, 7], [5, 1]], np.uint64)
    assert ranking._digest_order(np.array([1, 1, 1, 0], np.int32), h).tolist() == [3, 2, 1, 0]


def wide(spark, y, prefix):
    rows = [(i, b, *np.pad(y[i, b * 32:b * 32 + 32], (0, 32 - len(y[i, b * 32:b * 32 + 32]))).tolist()) for i in range(len(y)) for b in range(2) if y[i, b * 32:b * 32 + 32].any()]
    return spark.createDataFrame(rows, "idx long, block int, " + ", ".join(f"{prefix}{i} double" for i in range(32)))


def test_placements_are_the_permutations(spark, moved):
    n, _, index, _, table = moved
    want = np.zeros((5, n), int)
    for r in ranking.permutations(index.select("cell_id"), 4, 3).collect():
        want[r["perm"], r["cell_id"] // 7] = r["from_id"] // 7
    assert (table == want).all()


def test_sums_over_edges_move_row_numbers_only(spark, moved, monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 150)  # several chunks
    monkeypatch.setattr(R, "PACKED", 400)
    n, y, index, _, table = moved
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, n, 300), rng.integers(0, n, 300)
    i, j, w = i[i != j], j[i != j], rng.random(300)[i != j]
    edges = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "w": w}))
    size, chunks = R.chunking(n, len(i) * 5, ordered=False)
    mean = y.mean(axis=0)
    shift = {0: mean[:32], 1: np.pad(mean[32:], (0, 24))}
    cells = index.withColumns({"x": F.col("idx") % 9 * 1.0, "y": F.floor(F.col("idx") / 9) * 1.0})
    messages = R.edge_pairs(index, 4, 3, edges, R.position_blocks(cells, index, n, 4), size, chunks).cache()
    sent = messages.agg(F.sum(sum(F.length(c) for c in ("perm", "a", "b", "w"))).alias("b"), F.sum(F.length("perm") / 2).alias("n")).first()
    assert chunks > 2 and sent["n"] == len(i) * 5 and sent["b"] <= 14 * sent["n"]
    rows = R.row_chunks(wide(spark, y, "y"), "y", size, shift)
    got = {(r["perm"], r["block"]): np.array(r[2:]) for r in R.replicate_sums(messages, rows, rows, 2, 4, size, chunks, False, shift).collect()}
    z = y - mean
    for p in range(5):
        want = (w[:, None] * z[table[p, i]] * z[table[p, j]]).sum(axis=0)
        assert np.allclose(np.concatenate([got[p, 0], got[p, 1][:8]]), want, atol=1e-12)


def test_sums_over_positions(spark, moved, monkeypatch):
    """Where the moved row is zero the position's may be NaN, and chunks without rows are zeros."""
    monkeypatch.setattr(R, "PAIRS", 50)
    n, y, index, _, table = moved
    left, right = np.where(np.arange(n)[:, None] < 20, y, 0.0), y.copy()
    right[:, 3] = 0.0
    left[2, 3] = left[4, 5] = np.nan
    size, chunks = R.chunking(n, n * 5, ordered=True)
    a, b = R.row_chunks(wide(spark, left, "c"), "c", size), R.row_chunks(wide(spark, right, "r"), "r", size)
    got = {(r["perm"], r["block"]): np.array(r[2:]) for r in R.replicate_sums(R.placed_pairs(index, 4, 3, size, chunks), a, b, 2, 4, size, chunks, True).collect()}
    for p in range(5):
        want = np.where(right[table[p]] != 0, left * right[table[p]], 0.0).sum(axis=0)
        assert np.allclose(np.concatenate([got[p, 0], got[p, 1][:8]]), want, atol=1e-12, equal_nan=True)
