"""Radius joins: pairs decide how rows are dealt."""
import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import spatial


def test_a_crowded_tile_of_one_input_partition_is_joined_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_PAIRS", 20_000)
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.integers(0, 8, (500, 2)), rng.integers(0, 200, (60, 2)), [[3, 3], [3, 3], [10, 3]]]).astype(float)
    cells = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id long, x double, y double").coalesce(1)
    left, right = (cells.select(F.col("cell_id").alias(n), "x", "y") for n in ("src", "dst"))
    found = spatial.radius_join(left, right, 7.0, block=64)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    assert sorted((r.src, r.dst, r.d2) for r in rows) == sorted((int(i), int(j), d2[i, j]) for i, j in zip(*np.nonzero(d2 <= 49)))
    tasks = np.unique([r.task for r in rows], return_counts=True)[1]
    assert len(tasks) > 8 and tasks.max() < len(rows) / 4


def test_a_radius_join_without_pairs_is_empty(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0)], "src long, x double, y double")
    assert spatial.radius_join(cells, cells.withColumnRenamed("src", "dst").filter("false"), 5.0).count() == 0
