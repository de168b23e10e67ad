"""Comparing partitions and transports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import apply_affine, invert_affine
from .spatial import knn


def common_observations(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("cell_id").intersect(right.select("cell_id"))


def adjusted_rand(left: DataFrame, right: DataFrame) -> DataFrame:
    """Adjusted Rand index of two partitions (cell_id, domain) on their common cells; 1 when degenerate."""
    pairs = (left.select("cell_id", F.col("domain").alias("a")).join(right.select("cell_id", F.col("domain").alias("b")), "cell_id")
             .groupBy("a", "b").agg(F.count("*").cast("double").alias("n")))
    choose = lambda c: c * (c - 1) / 2
    fold = lambda df, name: df.agg(F.sum(choose(F.col("n"))).alias(name), F.sum("n").alias(f"_t_{name}")).withColumn("_k", F.lit(1))
    same = fold(pairs, "same")
    ca = fold(pairs.groupBy("a").agg(F.sum("n").alias("n")), "ca")
    cb = fold(pairs.groupBy("b").agg(F.sum("n").alias("n")), "cb")
    out = same.join(ca, "_k").join(cb, "_k")  # one row each
    expected = F.col("ca") * F.col("cb") / F.nullif(choose(F.col("_t_same")), F.lit(0.0))
    denominator = (F.col("ca") + F.col("cb")) / 2 - expected
    return out.select(F.col("_t_same").cast("bigint").alias("common_count"),
                      F.when(denominator == 0, 1.0).otherwise((F.col("same") - expected) / F.nullif(denominator, F.lit(0.0))).alias("adjusted_rand_index"))


def boundary_disagreement(cells: DataFrame, left: DataFrame, right: DataFrame, k: int = 6) -> DataFrame:
    """Per common cell, the share of its nearest common cells on which the partitions disagree about co-membership."""
    both = (left.select("cell_id", F.col("domain").alias("a")).join(right.select("cell_id", F.col("domain").alias("b")), "cell_id")
            .join(cells.select("cell_id", "x", "y"), "cell_id"))
    edges = knn(both.select("cell_id", "x", "y"), k)
    s = both.select(F.col("cell_id").alias("src"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    d = both.select(F.col("cell_id").alias("dst"), F.col("a").alias("da"), F.col("b").alias("db"))
    differs = ((F.col("sa") == F.col("da")) != (F.col("sb") == F.col("db"))).cast("double")
    return (edges.join(s, "src").join(d, "dst").groupBy(F.col("src").alias("cell_id"))
            .agg(F.avg(differs).alias("boundary_disagreement"), F.first("sa").alias("left_domain"), F.first("sb").alias("right_domain")))


def transport_rows(transport: DataFrame, target: DataFrame) -> DataFrame:
    """Per source i of a sparse transport (i, j, mass): row mass, entropy and barycentric target position."""
    joined = transport.join(target.select("j", "x", "y"), "j")
    mass = joined.groupBy("i").agg(F.sum("mass").alias("row_mass"), F.sum(F.col("mass") * F.col("x")).alias("_x"), F.sum(F.col("mass") * F.col("y")).alias("_y"),
                                   F.sum(F.when(F.col("mass") > 0, F.col("mass") * F.ln("mass"))).alias("_ml"))
    r = F.greatest(F.col("row_mass"), F.lit(1e-300))
    # -sum p ln p with p = mass / row_mass, folded into one pass
    return mass.select("i", "row_mass", (F.ln(r) - F.coalesce("_ml", F.lit(0.0)) / r).alias("row_entropy"), (F.col("_x") / r).alias("x"), (F.col("_y") / r).alias("y"))


def marginal_error(transport: DataFrame, n: int, m: int) -> DataFrame:
    """Largest deviation of any row or column mass from uniform marginals; empty rows count fully."""
    def side(key: str, size: int) -> DataFrame:
        sums = transport.groupBy(key).agg(F.sum("mass").alias("s"))
        worst = F.coalesce(F.max(F.abs(F.col("s") - 1.0 / size)), F.lit(0.0))
        return sums.agg(F.greatest(worst, F.when(F.count("*") < size, F.lit(1.0 / size)).otherwise(0.0)).alias("e"))
    return side("i", n).unionByName(side("j", m)).agg(F.max("e").alias("marginal_max_error"))


def centroid_pixels(cells: DataFrame, pixels: DataFrame, label_cells: DataFrame, affine: Sequence[Sequence[float]], width: int, height: int,
                    segmentation: bool = True) -> DataFrame:
    """Look every centroid up in a label plane: pixels(px, py, label), label_cells(label, mapped_cell_id)."""
    wx, wy = apply_affine(F.col("x"), F.col("y"), invert_affine(affine))
    located = cells.select("cell_id", F.floor(wx + 0.5).alias("px"), F.floor(wy + 0.5).alias("py"))
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    out = located.join(pixels, ["px", "py"], "left").withColumn("pixel_value", F.when(inside, F.coalesce("label", F.lit(0)))).drop("label")
    out = out.join(label_cells.withColumnRenamed("label", "pixel_value"), "pixel_value", "left")
    if not segmentation:
        return out.select("cell_id", "px", "py", "pixel_value", F.when(inside, "image_only").otherwise("outside_image").alias("correspondence"))
    return out.select("cell_id", "px", "py", "pixel_value", "mapped_cell_id", F.when(~inside, "outside_image")
                      .when(F.col("pixel_value") == 0, "background_at_centroid").when(F.col("mapped_cell_id").isNull(), "mapping_unknown")
                      .when(F.col("mapped_cell_id") == F.col("cell_id"), "same_declared_cell").otherwise("different_declared_cell").alias("correspondence"))
