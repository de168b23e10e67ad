"""Exports: review bundles, matched inputs for outside fits, frozen analysis inputs."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import table_digest
from ..operators import validate as V


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: row count and an order-free content digest."""
    rows = [table_digest(df).select(F.lit(name).alias("table"), "row_count", "content_sha256") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def write_review(path: str, tables: Mapping[str, DataFrame], compact: bool = False) -> DataFrame:
    """Write every table as parquet plus the manifest; ``compact`` leaves out the materialised copies."""
    kept = {n: df for n, df in tables.items() if not (compact and n in ("base_cells", "target_cells"))}
    for name, df in kept.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(kept.values())).sparkSession
    written = manifest({n: spark.read.parquet(f"{path}/{n}") for n in kept})
    written.coalesce(1).write.json(f"{path}/manifest")  # one row per table
    return spark.read.schema("table string, row_count bigint, content_sha256 string").json(f"{path}/manifest")


def check_review(path: str, spark) -> DataFrame:
    """Tables whose current content no longer matches the manifest."""
    stated = spark.read.schema("table string, row_count bigint, content_sha256 string").json(f"{path}/manifest")
    names = [r[0] for r in stated.select("table").collect()]
    now = manifest({n: spark.read.parquet(f"{path}/{n}") for n in names}).withColumnsRenamed({"row_count": "rows_now", "content_sha256": "sha_now"})
    return stated.join(now, "table", "full_outer").filter(F.expr("not (row_count <=> rows_now) or not (content_sha256 <=> sha_now)"))


def wide(cells: DataFrame, values: DataFrame, features: Sequence[str], fill_zero: bool) -> DataFrame:
    """cell_id x listed features; RNA is zero-filled, missing protein stays empty."""
    table = values.filter(F.col("feature_id").isin(*features)).groupBy("cell_id").pivot("feature_id", list(features)).agg(F.first("value"))
    out = cells.select("cell_id").join(table, "cell_id", "left")
    return out.fillna(0.0, subset=list(features)) if fill_zero else out


def matched_inputs(cells: DataFrame, counts: DataFrame, protein: DataFrame, panel: DataFrame, rna_features: Sequence[str],
                   protein_features: Sequence[str], ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Observations, wide RNA and wide protein of the included cells (or the given included ids).

    Only RNA features of the panel can be exported: a zero is written for what was measured, never for what was not.
    """
    asked = cells.sparkSession.createDataFrame([(f,) for f in rna_features], "feature_id string")
    V.require_none(asked.join(panel, "feature_id", "left_anti"), "RNA features to export must be on the panel")
    active = cells.filter("included")
    if ids is not None:
        V.require_none(ids.join(active.select("cell_id"), "cell_id", "left_anti"), "export ids must be included observations")
        active = active.join(ids.select("cell_id"), "cell_id", "left_semi")
    return {"observations": active.select("cell_id", "x", "y", "label", "included"),
            "rna_counts": wide(active, counts, rna_features, True), "protein_counts": wide(active, protein, protein_features, False)}


def write_matched_inputs(path: str, tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{path}/{name}")


def ingest_result(output: DataFrame, fit_ids: DataFrame, cells: DataFrame, features: DataFrame, measured: DataFrame, whole_slice: bool,
                  method: Mapping[str, object]) -> DataFrame:
    """Accept an outside method's result as data after its contract holds; its code is never run."""
    if not method.get("environment") or not isinstance(method.get("uses_annotations"), bool):
        raise ValueError("declare the method's environment and whether it used annotations")
    active = cells.filter("included").select("cell_id")
    V.require_none(V.integration_result(fit_ids, active, output, features, measured, whole_slice), "external result")
    return output.withColumn("output_origin", F.lit("model_prediction"))


def freeze_input(cells: DataFrame, counts: DataFrame, revision: str, roi: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, counts, provenance): included rows at a revision, optionally inside an ROI without unknown ids."""
    active = cells.filter("included")
    if roi is not None:
        V.require_none(roi.join(cells.select("cell_id"), "cell_id", "left_anti"), "ROI names unknown cells")
        active = active.join(roi.select("cell_id"), "cell_id", "left_semi")
    kept = counts.filter("value > 0").join(active.select("cell_id"), "cell_id", "left_semi")
    one = lambda df, n: df.agg(F.count("*").alias(n)).withColumn("_k", F.lit(1))
    provenance = one(active, "observation_count").join(one(kept, "entry_count"), "_k").drop("_k").withColumn("revision_id", F.lit(revision))
    return active, kept, provenance
