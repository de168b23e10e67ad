"""Source-reported quality fields: descriptive, never a pass or fail."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .ranking import quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def numeric_fields(cells: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field: valid, absent, null, wrong-typed, negative and zero counts, range, mean and exact quartiles."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col("attributes")[f].alias("v"),
                                 F.coalesce(F.map_contains_key("attributes", f), F.lit(False)).alias("present")) for f in fields])
    long = cells.select(F.explode(entries).alias("e")).select("e.*")
    kind, num = F.col("v.kind"), F.col("v.num")
    valid = (kind == "num") & (num >= 0)
    long = long.select("field", "present", kind.alias("kind"), num.alias("num"), F.when(valid, num).alias("value"))
    base = long.groupBy("field").agg(
        F.count("*").alias("observation_count"), F.count("value").alias("valid_count"), F.count_if(~F.col("present")).alias("absent_count"),
        F.count_if(F.col("present") & (F.coalesce("kind", F.lit("null")) == "null")).alias("null_count"),
        F.count_if(F.col("kind").isin("str", "bool")).alias("invalid_type_count"),
        F.count_if((F.col("kind") == "num") & (F.col("num") < 0)).alias("invalid_range_count"),
        F.count_if(F.col("value") == 0).alias("_zeros"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    out = base.join(quantiles(long, ["field"], "value", QUARTILES), "field", "left")
    return out.withColumns({
        "zero_count": F.when(F.col("valid_count") > 0, F.col("_zeros")), "missing_count": F.col("absent_count") + F.col("null_count"),
        "status": F.when(F.col("valid_count") > 0, "available")
        .when(F.col("invalid_type_count") + F.col("invalid_range_count") > 0, "unavailable").otherwise("not_recorded")}).drop("_zeros")


def category_table(cells: DataFrame, field: str, top: int = 20) -> DataFrame:
    """Most frequent categories (count desc, value asc) with what the cut leaves out."""
    v = F.col("attributes")[field]
    counts = cells.filter((v["kind"] == "str") & (F.trim(v["str"]) != "")).groupBy(v["str"].alias("value")).agg(F.count("*").alias("count"))
    whole = counts.agg(F.count("*").alias("category_count"), F.sum("count").alias("_all")).withColumn("_k", F.lit(1))
    first = counts.orderBy(F.desc("count"), F.asc("value")).limit(top)
    ranked = first.withColumns({"rank": F.row_number().over(W.orderBy(F.desc("count"), F.asc("value"))), "_k": F.lit(1)})  # `top` rows at most
    shown = ranked.join(F.broadcast(whole), "_k").withColumn("_shown", F.sum("count").over(W.partitionBy("_k")))  # whole: one row
    return shown.select("value", "count", "rank", "category_count", F.greatest(F.lit(0), F.col("category_count") - top).alias("omitted_category_count"),
                        (F.col("_all") - F.col("_shown")).alias("omitted_observation_count"))


def expression_quality(libs: DataFrame) -> DataFrame:
    """Library and detected-feature distributions over all given observations (two rows)."""
    long = libs.unpivot(["cell_id"], [F.col("library"), F.col("detected").cast("double").alias("detected")], "field", "value")
    base = long.groupBy("field").agg(F.count("*").alias("observation_count"), F.count_if(F.col("value") == 0).alias("zero_count"),
                                     F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return base.join(quantiles(long, ["field"], "value", QUARTILES), "field")
