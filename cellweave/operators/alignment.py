"""Stored results against recomputed ones where equal results may differ by signs, a rotation or the names of clusters."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RELATIVE, FLOOR = 1e-7, 1e-9  # a component may differ by this share of the larger value, or by this much
MAX_NAMES = 1000  # cluster names of a side; the matching on the driver holds their square


def _both(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    a = stored.select("cell_id", F.col("embedding").cast("array<double>").alias("a"))
    return a.join(recomputed.select("cell_id", F.col("embedding").cast("array<double>").alias("b")), "cell_id", "full_outer")


def _comparable() -> Column:
    """Both rows exist, have the same length and hold numbers only."""
    finite = lambda c: F.forall(c, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.coalesce((F.size("a") == F.size("b")) & finite("a") & finite("b"), F.lit(False))


def _differs(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) > F.greatest(F.lit(FLOOR), RELATIVE * F.greatest(F.abs(F.col(a)), F.abs(F.col(b))))


def sign_mismatch(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Components that differ after each component's sign is chosen: (cell_id, component, stored, recomputed).

    The sign of a component is that of its summed product over all rows, + when that is 0. A row that one side lacks,
    or whose vectors have other lengths, nulls or non-finite values, is reported once with component null.
    """
    both = _both(stored, recomputed)
    pairs = both.filter(_comparable()).select("cell_id", F.posexplode(F.arrays_zip("a", "b")).alias("component", "v")).select("cell_id", "component", "v.a", "v.b")
    signs = pairs.groupBy("component").agg(F.when(F.sum(F.col("a") * F.col("b")) < 0, -1.0).otherwise(1.0).alias("sign"))  # one row per component
    off = pairs.join(F.broadcast(signs), "component").withColumn("b", F.col("b") * F.col("sign")).filter(_differs("a", "b"))
    whole = both.filter(~_comparable()).select("cell_id", F.lit(None).cast("int").alias("component"), F.lit(None).cast("double").alias("stored"), F.lit(None).cast("double").alias("recomputed"))
    return off.select("cell_id", "component", F.col("a").alias("stored"), F.col("b").alias("recomputed")).unionByName(whole)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cross products of a task's rows: one row per pair of components."""
    total = None
    for batch in batches:
        if len(batch):
            a, b = (np.array(batch[n].to_pylist(), dtype=np.float64) for n in "ab")
            total = a.T @ b if total is None else total + a.T @ b
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])


def rotation(stored: DataFrame, recomputed: DataFrame) -> np.ndarray:
    """The orthogonal matrix Q that brings the recomputed rows nearest to the stored ones, from d x d products summed in Spark."""
    pairs = _both(stored, recomputed).filter(_comparable()).select("a", "b")
    sums = pairs.mapInArrow(_products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # components squared
    d = 1 + max((r["i"] for r in sums), default=-1)
    cross = np.zeros((d, d))
    for r in sums:
        cross[r["j"], r["i"]] = r["v"]
    u, _, vt = np.linalg.svd(cross)
    return u @ vt


def rotation_mismatch(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows farther than ``tolerance`` of their length from the stored row after the best rotation: (cell_id, residual).

    A row without a comparable partner has a null residual.
    """
    q, both = rotation(stored, recomputed), _both(stored, recomputed)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.array(batch[n].to_pylist(), dtype=np.float64) for n in "ab")
                gap = np.linalg.norm(a - b @ q, axis=1)
                far = gap > np.maximum(FLOOR, tolerance * np.linalg.norm(a, axis=1))
                yield pa.RecordBatch.from_arrays([batch["cell_id"].filter(pa.array(far)), pa.array(gap[far])], names=["cell_id", "residual"])

    kind = dict(stored.dtypes)["cell_id"]
    return (both.filter(_comparable()).mapInArrow(residuals, f"cell_id {kind}, residual double")
            .unionByName(both.filter(~_comparable()).select("cell_id", F.lit(None).cast("double").alias("residual"))))


def best_matching(counts: np.ndarray) -> np.ndarray:
    """Column of each row in a matching of largest total, -1 without one: shortest augmenting paths on reduced costs."""
    rows, columns = counts.shape
    size = max(rows, columns)
    cost = np.zeros((size, size))
    cost[:rows, :columns] = -counts
    at_row, at_column = np.zeros(size), np.zeros(size)
    owner = np.full(size, -1)
    for start in range(size):
        path, reach, done, row, column = np.full(size, -1), np.full(size, np.inf), np.zeros(size, bool), start, -1
        shift = 0.0
        while row >= 0:
            step = shift + cost[row] - at_row[row] - at_column
            better = ~done & (step < reach)
            reach[better], path[better] = step[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            shift, done[column] = reach[column], True
            row = owner[column]
        held = done & (owner >= 0)
        at_row[owner[held]] += shift - reach[held]
        at_row[start] += shift
        at_column[done] -= shift - reach[done]
        while column >= 0:
            owner[column] = start if path[column] < 0 else owner[path[column]]
            column = int(path[column])
    out = np.full(rows, -1)
    for column in range(columns):
        if owner[column] < rows:
            out[owner[column]] = column
    return out


def match_names(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Clusters renamed to agree on most rows: (stored, recomputed, agreeing, disagreeing), one row per stored cluster.

    Both sides hold (cell_id, cluster); a stored cluster without a partner has recomputed null and agrees on nothing.
    Rows that one side lacks, or without a cluster, disagree; those without a stored cluster come under stored null.
    """
    both = stored.select("cell_id", F.col("cluster").cast("string").alias("s")).join(recomputed.select("cell_id", F.col("cluster").cast("string").alias("r")), "cell_id", "full_outer")
    table = both.groupBy("s", "r").agg(F.count("*").alias("n"))
    if max(table.agg(F.count_distinct("s"), F.count_distinct("r")).first()) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} cluster names")
    cells = table.collect()  # at most (names + 1) squared rows
    left, right = (sorted({c[n] for c in cells} - {None}) for n in "sr")
    counts = np.zeros((len(left), len(right)))
    for c in cells:
        if c["s"] is not None and c["r"] is not None:
            counts[left.index(c["s"]), right.index(c["r"])] = c["n"]
    partner = {left[i]: right[j] for i, j in enumerate(best_matching(counts)) if j >= 0 and counts[i, j]} if counts.size else {}
    seen = [(s, partner.get(s), sum(c["n"] for c in cells if c["s"] == s and s is not None and c["r"] == partner.get(s) and s in partner),
             sum(c["n"] for c in cells if c["s"] == s)) for s in [*left, *([None] if any(c["s"] is None for c in cells) else [])]]
    return stored.sparkSession.createDataFrame([(s, r, int(agree), int(total - agree)) for s, r, agree, total in seen],
                                               "stored string, recomputed string, agreeing bigint, disagreeing bigint")
