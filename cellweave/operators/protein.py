"""Paired protein channels: null is missing, zero is measured."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import display_transform
from .expression import spearman
from .ranking import quantiles


def paired_values(cells: DataFrame, protein: DataFrame, features: Sequence[str]) -> DataFrame:
    """Included cells x requested features (a bounded list) with a NULL value where nothing was measured."""
    grid = cells.filter("included").withColumn("feature_id", F.explode(F.array(*[F.lit(f) for f in features])))
    return grid.join(protein.filter(F.col("feature_id").isin(*features)), ["cell_id", "feature_id"], "left")


def channel_summary(cells: DataFrame, protein: DataFrame, features: Sequence[str], scale: str = "raw", cofactor: float = 5.0,
                    by: Sequence[str] = ()) -> DataFrame:
    values = paired_values(cells, protein, features)
    keys = [*by, "feature_id"]
    base = values.groupBy(*keys).agg(
        F.count("*").alias("included_count"), F.count("value").alias("measured_count"), F.count_if(F.col("value") == 0).alias("zero_count"),
        F.avg("value").alias("mean_raw"), F.avg(display_transform(F.col("value"), scale, cofactor)).alias("mean_transformed"))
    medians = quantiles(values, keys, "value", {"median_raw": 0.5})
    return base.join(medians, keys, "left").withColumn("missing_count", F.col("included_count") - F.col("measured_count"))


def channel_labels(cells: DataFrame) -> DataFrame:
    return cells.filter("included").groupBy("label").agg(F.count("*").alias("count"))


def region_contrast(tagged: DataFrame, protein: DataFrame, features: Sequence[str], scale: str, cofactor: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Foreground minus background of the transformed mean, per feature."""
    values = paired_values(tagged, protein, features)
    shown = display_transform(F.col("value"), scale, cofactor)
    fg, bg = (F.avg(F.when(F.col("side") == s, shown)) for s in ("foreground", "background"))
    return values.groupBy(*by, "feature_id").agg(fg.alias("foreground"), bg.alias("background")).withColumn(
        "difference", F.col("foreground") - F.col("background"))


def rna_protein_pairs(cells: DataFrame, counts: DataFrame, protein: DataFrame, gene: str, features: Sequence[str]) -> DataFrame:
    """Included cells with a measured protein value, their zero-filled RNA count and per-10k value."""
    measured = protein.filter(F.col("feature_id").isin(*features) & F.col("value").isNotNull()).withColumnRenamed("value", "protein_value")
    active = cells.filter("included").select("cell_id")
    # Library and gene in one pass: counts may be the end of large joins.
    sums = counts.groupBy("cell_id").agg(F.sum("value").alias("_library"), F.sum(F.when(F.col("feature_id") == gene, F.col("value"))).alias("_c"))
    out = active.join(measured, "cell_id").join(sums, "cell_id", "left")
    raw, library = F.coalesce("_c", F.lit(0.0)), F.coalesce("_library", F.lit(0.0))
    return out.select("cell_id", "feature_id", "protein_value", raw.alias("rna_raw"), F.when(library > 0, raw / library * 10000).alias("rna_per_10k"))


def rna_protein_correlation(pairs: DataFrame) -> DataFrame:
    raw = spearman(pairs.select("feature_id", F.col("rna_raw").alias("rna"), "protein_value"), ["feature_id"], "rna", "protein_value")
    per = spearman(pairs.filter("rna_per_10k is not null").select("feature_id", F.col("rna_per_10k").alias("rna"), "protein_value"),
                   ["feature_id"], "rna", "protein_value")
    return raw.withColumn("measure", F.lit("raw")).unionByName(per.withColumn("measure", F.lit("per_10k")))


def pairing_residuals(protein_points: DataFrame, cells: DataFrame, affine, tolerance: float) -> DataFrame:
    """Transformed assay coordinates against the cells they name: foreign ids, residuals, violations."""
    from ..functions.geometry import apply_affine
    px, py = apply_affine(F.col("px"), F.col("py"), affine)
    both = protein_points.join(cells.select("cell_id", "x", "y"), "cell_id", "left")
    residual = F.greatest(F.abs(px - F.col("x")), F.abs(py - F.col("y")))
    return both.agg(F.count("*").alias("observation_count"), F.count_if(F.col("x").isNull()).alias("foreign_ids"),
                    F.max(residual).alias("max_residual"), F.count_if(residual > tolerance).alias("coordinate_violations"))
