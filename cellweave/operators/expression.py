"""Count matrices in long form: libraries, normalisation, panel and region summaries.

Only non-zero counts are stored. A panel gene without a row is a measured zero, so every mean divides
by an explicit observation count instead of averaging the rows that happen to exist.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import log_cp10k
from ..session import materialise
from .filters import select_ids
from .ranking import average_ranks, rank_table


def libraries(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Total count and number of detected features per observation; zero-library rows stay with 0."""
    sums = counts.groupBy("cell_id").agg(F.sum("value").alias("library"), F.count_if(F.col("value") > 0).alias("detected"))
    return cells.select("cell_id").join(sums, "cell_id", "left").select(
        "cell_id", F.coalesce("library", F.lit(0.0)).alias("library"), F.coalesce("detected", F.lit(0)).alias("detected"))


def normalise(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """log1p of counts per 10,000 of the full-panel library (restrict features only afterwards)."""
    chosen = counts if cells is None else select_ids(counts, cells)
    library = F.sum("value").over(W.partitionBy("cell_id"))
    return chosen.withColumn("_lib", library).filter("_lib > 0").select("cell_id", "feature_id", log_cp10k(F.col("value"), F.col("_lib")).alias("value"))


def zero_library(cells: DataFrame, counts: DataFrame) -> DataFrame:
    return libraries(cells, counts).filter("library = 0").select("cell_id")


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(1))


def panel_summary(cells: DataFrame, counts: DataFrame, features: DataFrame, genes: Sequence[str] | None = None) -> DataFrame:
    """Mean, sum, non-zero and zero counts per gene over all given cells, excluded ones included.

    A listed name is a feature id, or a symbol that exactly one feature carries; a symbol of several is ambiguous and
    a name of none unmeasured, and neither gets measures.
    """
    total = _one(cells.agg(F.count("*").alias("cell_count")))
    sums = select_ids(counts, cells).groupBy("feature_id").agg(F.sum("value").alias("_s"), F.count_if(F.col("value") > 0).alias("_nz"))
    if genes is None:
        asked = features.select("feature_id", F.col("feature_id").alias("name"), F.lit(1).alias("_found"))
    else:
        by_id = features.filter(F.col("feature_id").isin(*genes)).select(F.col("feature_id").alias("name"), "feature_id", F.lit(0).alias("_rank"))
        by_symbol = features.filter(F.col("symbol").isin(*genes)).select(F.col("symbol").alias("name"), "feature_id", F.lit(1).alias("_rank"))
        matches = by_id.unionByName(by_symbol).distinct().withColumn("_first", F.min("_rank").over(W.partitionBy("name"))).filter("_rank = _first")
        found = matches.groupBy("name").agg(F.count("*").alias("_found"), F.min("feature_id").alias("feature_id"))
        listed = cells.sparkSession.createDataFrame([(g,) for g in genes], "name string")
        asked = listed.join(found, "name", "left").withColumn("feature_id", F.when(F.col("_found") == 1, F.col("feature_id")))
    out = _one(asked.join(sums, "feature_id", "left")).join(F.broadcast(total), "_k")  # total: one row
    on = F.coalesce(F.col("_found") == 1, F.lit(False))
    filled = F.coalesce("_s", F.lit(0.0))
    nonzero = F.coalesce("_nz", F.lit(0))
    return out.select(
        F.col("name").alias("feature_id"), F.when(F.col("_found") > 1, "ambiguous").when(~on, "unmeasured").when(F.col("cell_count") == 0, "no_selected_cells").otherwise("measured").alias("status"),
        F.when(on & (F.col("cell_count") > 0), filled / F.col("cell_count")).alias("mean"), F.when(on, filled).alias("sum"),
        F.when(on, nonzero).alias("nonzero_cells"), F.when(on, F.col("cell_count") - nonzero).alias("zero_cells"), "cell_count")


def region_summary(cells: DataFrame, counts: DataFrame, features: DataFrame, genes: Sequence[str], by: Sequence[str] = ("region",)) -> DataFrame:
    """Per region and gene over included cells; the per-10k mean skips zero-library cells only.

    A gene that is not on the panel (``features``) is unmeasured: its row stays, without measures. The asked genes
    are a declared list, so the zero-filled grid is an explode.
    """
    by = list(by)
    active = cells.filter("included").select("cell_id", *by)
    libs = counts.groupBy("cell_id").agg(F.sum("value").alias("_lib"))
    with_lib = active.join(libs, "cell_id", "left")
    denominators = with_lib.groupBy(*by).agg(F.count("*").alias("included_count"), F.count_if(F.col("_lib") > 0).alias("normalized_denominator"))
    picked = counts.filter(F.col("feature_id").isin(*genes) & (F.col("value") > 0))
    sums = with_lib.join(picked, "cell_id").groupBy(*by, "feature_id").agg(
        F.sum("value").alias("_s"), F.count("*").alias("_nz"), F.sum(F.when(F.col("_lib") > 0, F.col("value") / F.col("_lib") * 10000)).alias("_n"))
    panel = features.filter(F.col("feature_id").isin(*genes)).select("feature_id", F.lit(True).alias("_on")).distinct()
    grid = denominators.withColumn("feature_id", F.explode(F.array(*[F.lit(g) for g in genes])))
    out = grid.join(panel, "feature_id", "left").join(sums, [*by, "feature_id"], "left")
    on = F.col("_on").isNotNull()
    n, m = F.col("included_count"), F.col("normalized_denominator")
    return out.select(
        *by, "feature_id", F.when(on, "measured").otherwise("unmeasured").alias("status"), n, m, (n - m).alias("zero_library_observations"),
        F.when(on, F.coalesce("_s", F.lit(0.0)) / n).alias("mean_raw_count"), F.when(on, F.coalesce("_nz", F.lit(0)) / n).alias("detection_fraction"),
        F.when(on & (m > 0), F.coalesce("_n", F.lit(0.0)) / m).alias("mean_panel_counts_per_10000"))


def tag_regions(cells: DataFrame, foreground: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """Keep foreground and background cells with a ``side`` column; the default background is the complement."""
    marks = foreground.select("cell_id", F.lit(1).alias("_f"))
    out = cells.join(marks, "cell_id", "left")
    if background is None:
        return out.withColumn("side", F.when(F.col("_f") == 1, "foreground").otherwise("background")).drop("_f")
    other = background.select("cell_id", F.lit(1).alias("_g"))
    return (out.join(other, "cell_id", "left").filter("_f = 1 or _g = 1")
            .withColumn("side", F.when(F.col("_f") == 1, "foreground").otherwise("background")).drop("_f", "_g"))


def overlap_count(foreground: DataFrame, background: DataFrame) -> DataFrame:
    return foreground.select("cell_id").intersect(background.select("cell_id")).agg(F.count("*").alias("overlap_count"))


def _contrast(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    fg, bg = (F.max(F.when(F.col("side") == s, F.col("v"))) for s in ("foreground", "background"))
    return long.groupBy(*keys).agg(fg.alias("foreground"), bg.alias("background")).withColumn("difference", F.col("foreground") - F.col("background"))


def label_contrast(tagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Foreground minus background label fraction over included cells; an absent label is a zero fraction."""
    active = tagged.filter("included")
    per = active.groupBy(*by, "side", "label").agg(F.count("*").alias("_n"))
    shares = per.withColumn("v", F.col("_n") / F.sum("_n").over(W.partitionBy(*by, "side")))
    sides = active.groupBy(*by).agg(F.count_distinct("side").alias("_sides"))
    out = _contrast(shares, [*by, "label"])
    out = out.join(sides, list(by)) if by else _one(out).join(F.broadcast(_one(sides)), "_k").drop("_k")
    ok = F.col("_sides") == 2
    return out.select(*by, "label", *[F.when(ok, F.coalesce(c, F.lit(0.0))).alias(c) for c in ("foreground", "background")]).withColumn(
        "difference", F.col("foreground") - F.col("background"))


def marker_contrast(tagged: DataFrame, counts: DataFrame, features: DataFrame, genes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Foreground minus background of the three region measures, long by measure."""
    summary = region_summary(tagged, counts, features, genes, [*by, "side"])
    measures = ["mean_raw_count", "detection_fraction", "mean_panel_counts_per_10000"]
    long = summary.unpivot([*by, "side", "feature_id"], measures, "measure", "v")
    return _contrast(long, [*by, "feature_id", "measure"])


def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    b = before.select(*keys, F.col("difference").alias("before_difference"))
    a = after.select(*keys, F.col("difference").alias("after_difference"))
    return b.join(a, list(keys), "full_outer").withColumn(
        "difference_delta", F.coalesce("after_difference", F.lit(0.0)) - F.coalesce("before_difference", F.lit(0.0)))


def feature_variance(values: DataFrame, n: int, out: str = "variance") -> DataFrame:
    """Population variance per feature with absent entries as zeros."""
    return values.groupBy("feature_id").agg((F.sum(F.col("value") * F.col("value")) / n - (F.sum("value") / n) * (F.sum("value") / n)).alias(out))


def top_features(scores: DataFrame, score: str, n: int) -> DataFrame:
    return scores.orderBy(F.col(score).desc(), F.col("feature_id").asc()).limit(n)


def shared_features(panels: Sequence[DataFrame]) -> DataFrame:
    out = panels[0].select("feature_id")
    for p in panels[1:]:
        out = out.intersect(p.select("feature_id"))
    return out


def spearman(pairs: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation per group; fewer than three pairs or a constant side is unknown, not zero."""
    pairs = materialise(pairs.select(*by, left, right))  # read by both rankings
    ranked = average_ranks(pairs, by, left, "_ra").join(
        rank_table(pairs, by, right, "_rb"), [*by, right])
    spread = F.stddev_pop("_ra") * F.stddev_pop("_rb")
    rho = F.covar_pop("_ra", "_rb") / F.nullif(spread, F.lit(0.0))  # constant sides give NULL instead of an error
    stats = ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("_rho"),
                                    F.min(left).alias("_a0"), F.max(left).alias("_a1"), F.min(right).alias("_b0"), F.max(right).alias("_b1"))
    ok = (F.col("n") >= 3) & (F.col("_a0") < F.col("_a1")) & (F.col("_b0") < F.col("_b1"))
    return stats.select(*by, "n", F.when(ok, F.col("_rho")).alias("rho"), F.when(ok, "descriptive").otherwise("unknown").alias("status"))
