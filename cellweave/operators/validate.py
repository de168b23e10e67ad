"""Contracts as jobs: each check returns violation rows (or one summary row), never a silent repair."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import polygon_problem_udf
from ..functions.ids import MAX_EXACT_COUNT, qualified_observation_id

# Columns that name the slice of a row, and the declared vocabularies.
SLICE_KEYS = ("slice_id", "slide_ID", "slide_id", "sample_id", "Run_Tissue_name")
ROI_ORIGINS = ("prespecified", "posthoc_exploratory", "independent_annotation")
CORRESPONDENCES = ("same_object", "known_mapping", "spatial_aggregation", "cross_slice_computed", "unpaired")
MOLECULAR_RELATIONS = ("same_gene_product", "complex_related", "marker_association", "researcher_defined")
LAYER_KINDS = ("measured_raw", "normalized_corrected", "model_inferred", "unmeasured")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _rule(df: DataFrame, rule: str, item: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), item.cast("string").alias("item"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def _bad_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def observation_contract(cells: DataFrame, counts: DataFrame, features: DataFrame) -> DataFrame:
    item = F.col("cell_id")
    parts = [
        _rule(duplicates(cells, "cell_id"), "duplicate_cell_id", item),
        _rule(cells.filter(_blank(item) | (F.length(item.cast("string")) > 512)), "invalid_cell_id", item),
        _rule(cells.filter(_bad_number(F.col("x")) | _bad_number(F.col("y"))), "nonfinite_coordinate", item),
        _rule(cells.filter(_blank(F.col("label"))), "blank_label", item),
        _rule(cells.filter(F.col("included").isNull()), "missing_inclusion_flag", item),
        _rule(counts.join(features.select("feature_id"), "feature_id", "left_anti").select("feature_id").distinct(), "count_outside_panel", F.col("feature_id")),
        _rule(counts.filter(_bad_number(F.col("value")) | (F.col("value") < 0)), "invalid_count", item)]
    if {"sample_id", "source_cell_id"} <= set(cells.columns):
        wrong = F.col("sample_id").isNotNull() & (qualified_observation_id(F.col("sample_id"), F.col("source_cell_id")) != item)
        parts.append(_rule(cells.filter(wrong), "qualified_id_mismatch", item))
    return _union(parts)


def raw_count_contract(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Exact integers before and after duplicate summing; optionally no zero-library rows."""
    v = F.col("value")
    bad = _bad_number(v) | (v < 0) | (v != F.floor(v)) | (v > MAX_EXACT_COUNT)
    item = F.concat_ws("|", "cell_id", "feature_id")
    summed = counts.groupBy("cell_id", "feature_id").agg(F.sum("value").alias("value"))
    parts = [_rule(counts.filter(bad), "not_an_exact_count", item), _rule(summed.filter(F.col("value") > MAX_EXACT_COUNT), "sum_not_exact", item)]
    if cells is not None:
        alive = counts.filter("value > 0").select("cell_id")
        parts.append(_rule(cells.join(alive, "cell_id", "left_anti"), "zero_library", F.col("cell_id")))
    return _union(parts)


def foreign_keys(cells: DataFrame, features: DataFrame, counts: DataFrame, boundaries: DataFrame | None = None,
                 transcripts: DataFrame | None = None) -> DataFrame:
    pair = F.concat_ws("|", "cell_id", "feature_id")
    parts = [
        _rule(counts.join(cells.select("cell_id"), "cell_id", "left_anti"), "count_unknown_cell", pair),
        _rule(counts.join(features.select("feature_id"), "feature_id", "left_anti"), "count_unknown_feature", pair),
        _rule(duplicates(counts, "cell_id", "feature_id"), "duplicate_count", pair)]
    if boundaries is not None:
        parts.append(_rule(boundaries.join(cells.select("cell_id"), "cell_id", "left_anti"), "boundary_unknown_cell", F.col("boundary_id")))
    if transcripts is not None:
        parts.append(_rule(duplicates(transcripts, "id"), "duplicate_transcript", F.col("id")))
    return _union(parts)


def feature_axis(features: DataFrame, panel: DataFrame) -> DataFrame:
    """Every panel feature described exactly once; ids unique, symbols may repeat or be null."""
    f = F.col("feature_id")
    return _union([
        _rule(duplicates(features, "feature_id"), "duplicate_feature_id", f),
        _rule(panel.join(features.select("feature_id"), "feature_id", "left_anti"), "panel_feature_not_described", f),
        _rule(features.join(panel.select("feature_id"), "feature_id", "left_anti"), "described_feature_not_on_panel", f),
        _rule(features.filter(_blank(f)), "blank_feature_id", f)])


def id_sets(left: DataFrame, right: DataFrame, key: str = "cell_id") -> DataFrame:
    """Both-direction comparison of two id sets: shared, left-only and right-only counts."""
    l = left.select(key).distinct().withColumn("_l", F.lit(1))
    r = right.select(key).distinct().withColumn("_r", F.lit(1))
    both = l.join(r, key, "full_outer")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("shared"),
                    F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def require_equal_ids(left: DataFrame, right: DataFrame, what: str, key: str = "cell_id") -> None:
    row = id_sets(left, right, key).first()
    if row["left_only"] or row["right_only"]:
        raise ValueError(f"{what}: ids must match exactly ({row['left_only']} only left, {row['right_only']} only right)")


def require_none(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def single_slice(rows: DataFrame) -> DataFrame:
    """Each slice-naming column present must be constant and non-null."""
    present = [k for k in SLICE_KEYS if k in rows.columns]
    if not present:
        return rows.sparkSession.createDataFrame([], "column string, distinct_values bigint, missing bigint, ok boolean")
    wide = rows.agg(*[c for k in present for c in (F.count_distinct(k).alias(f"d_{k}"), F.count_if(_blank(F.col(k))).alias(f"m_{k}"))])
    entries = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"d_{k}").alias("distinct_values"), F.col(f"m_{k}").alias("missing")) for k in present])
    return wide.select(F.explode(entries).alias("e")).select("e.*").withColumn("ok", (F.col("distinct_values") == 1) & (F.col("missing") == 0))


def polygons(table: DataFrame) -> DataFrame:
    """Polygon rows (id, xs, ys; at most 1000 vertices each) that are not simple, with the reason."""
    return table.withColumn("problem", polygon_problem_udf("xs", "ys")).filter("problem is not null")


def integration_result(fit_ids: DataFrame, active: DataFrame, output: DataFrame, features: DataFrame, measured: DataFrame,
                       whole_slice: bool, parent: DataFrame | None = None) -> DataFrame:
    """``output``: cell_id, vec array<double>, domain. With ``parent`` the output must be its filtered rows."""
    item = F.col("cell_id")
    parts = [
        _rule(fit_ids.join(active.select("cell_id"), "cell_id", "left_anti"), "fit_id_not_included", item),
        _rule(duplicates(output, "cell_id"), "duplicate_output_id", item),
        _rule(features.join(measured.select("feature_id"), "feature_id", "left_anti"), "feature_not_measured", F.col("feature_id")),
        _rule(output.filter(~F.size("vec").between(1, 64) | F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))),
              "invalid_representation", item),
        _rule(output.groupBy().agg(F.count_distinct(F.size("vec")).alias("k")).filter("k > 1"), "ragged_representation", F.lit("vec")),
        _rule(output.filter(_blank(F.col("domain"))), "blank_domain", item)]
    if whole_slice:
        parts.append(_rule(active.join(fit_ids.select("cell_id"), "cell_id", "left_anti"), "included_cell_not_fit", item))
    if parent is None:
        parts += [_rule(output.join(fit_ids.select("cell_id"), "cell_id", "left_anti"), "output_not_in_fit", item),
                  _rule(fit_ids.join(output.select("cell_id"), "cell_id", "left_anti"), "fit_without_output", item)]
    else:
        kept = parent.join(active.select("cell_id"), "cell_id", "left_semi")
        p = kept.select("cell_id", F.col("vec").alias("_v"), F.col("domain").alias("_d"), F.lit(1).alias("_p"))
        both = output.withColumn("_o", F.lit(1)).join(p, "cell_id", "full_outer")
        parts.append(_rule(both.filter("_o is null or _p is null or not (vec <=> _v) or not (domain <=> _d)"), "differs_from_parent_rows", item))
    return _union(parts)


def result_axes(compositions: DataFrame | None = None, probabilities: DataFrame | None = None, intervals: DataFrame | None = None,
                transport: DataFrame | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """Row simplexes, p/q ranges, interval order and transport mass, whichever tables are given."""
    parts = []
    if compositions is not None:
        total = F.aggregate("fractions", F.lit(0.0), lambda a, v: a + v)
        parts.append(_rule(compositions.filter((F.abs(total - 1) > 1e-5) | F.exists("fractions", lambda v: v < 0)), "not_a_composition", F.col("cell_id")))
    if probabilities is not None:
        parts.append(_rule(probabilities.filter("p_value not between 0 and 1 or q_value not between 0 and 1"), "probability_out_of_range", F.col("item")))
    if intervals is not None:
        parts.append(_rule(intervals.filter("q05 > q95"), "interval_reversed", F.col("item")))
    if transport is not None:
        n, m = shape
        where = F.concat_ws("|", "i", "j")
        parts.append(_rule(transport.filter(~F.col("i").between(0, n - 1) | ~F.col("j").between(0, m - 1)), "index_out_of_range", where))
        parts.append(_rule(transport.filter(_bad_number(F.col("mass")) | (F.col("mass") < 0)), "invalid_mass", where))
        parts.append(_rule(transport.groupBy().agg(F.sum("mass").alias("t")).filter("t is null or abs(t - 1) > 1.001e-5"), "mass_not_preserved", F.col("t")))
    return _union(parts)


def matrix_axes(values: DataFrame, cells: DataFrame, axis: DataFrame, column: str = "feature_id") -> DataFrame:
    """A stored result matrix (cell_id, column, value) against its axes: each cell has one finite value per axis item, and nothing else.

    Only the axis's size reaches the driver. Null keys are foreign; null values are not finite. No cells and no values: no violations.
    """
    size = axis.select(column).distinct().count()
    entry = F.concat_ws("|", F.coalesce(F.col("cell_id").cast("string"), F.lit("null")), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    own = values.join(axis.select(column), column, "left_semi").select("cell_id", column).distinct().groupBy("cell_id").agg(F.count("*").alias("n"))
    short = cells.select("cell_id").join(own, "cell_id", "left").filter(F.coalesce("n", F.lit(0)) != size)
    return _union([
        _rule(values.join(cells.select("cell_id"), "cell_id", "left_anti"), "row_not_observed", entry),
        _rule(values.join(axis.select(column), column, "left_anti"), "column_not_on_axis", entry),
        _rule(duplicates(values, "cell_id", column), "duplicate_entry", entry),
        _rule(values.filter(_bad_number(F.col("value"))), "nonfinite_value", entry),
        _rule(short, "incomplete_row", F.col("cell_id"))])


def domain_axis(domains: DataFrame, cells: DataFrame) -> DataFrame:
    """Domains (cell_id, domain) against the observations: one non-null name per cell, and no other cells."""
    named = domains.filter("domain is not null")
    return _union([
        _rule(domains.join(cells.select("cell_id"), "cell_id", "left_anti"), "row_not_observed", F.coalesce(F.col("cell_id").cast("string"), F.lit("null"))),
        _rule(duplicates(domains, "cell_id"), "duplicate_row", F.col("cell_id")),
        _rule(cells.join(named.select("cell_id"), "cell_id", "left_anti"), "cell_without_domain", F.col("cell_id"))])


def correspondence(edges: DataFrame, left: DataFrame, right: DataFrame, relation: str, same_sample: bool = True) -> DataFrame:
    """Rule violations of a mapping (left_id, right_id, weight) between two id tables."""
    if relation not in CORRESPONDENCES:
        raise ValueError("unknown correspondence relation")
    pair = F.concat_ws("|", "left_id", "right_id")
    w = F.col("weight")
    parts = [
        _rule(edges.join(left.select(F.col("cell_id").alias("left_id")), "left_id", "left_anti"), "unknown_left_id", pair),
        _rule(edges.join(right.select(F.col("cell_id").alias("right_id")), "right_id", "left_anti"), "unknown_right_id", pair),
        _rule(duplicates(edges, "left_id", "right_id"), "duplicate_pair", pair),
        _rule(edges.filter(_bad_number(w) | (w <= 0) | (w > 1)), "weight_out_of_range", pair)]
    if relation == "unpaired":
        parts.append(_rule(edges, "unpaired_has_edges", pair))
    else:
        parts.append(_rule(edges.groupBy().agg(F.count("*").alias("n")).filter("n = 0"), "no_edges", F.lit(relation)))
    if relation in ("same_object", "known_mapping"):
        parts += [_rule(duplicates(edges, "left_id"), "left_not_one_to_one", F.col("left_id")),
                  _rule(duplicates(edges, "right_id"), "right_not_one_to_one", F.col("right_id")),
                  _rule(edges.filter(w != 1), "weight_not_one", pair)]
    if relation == "same_object":
        parts.append(_rule(edges.filter((F.col("left_id") != F.col("right_id")) | F.lit(not same_sample)), "not_the_same_object", pair))
    if relation == "spatial_aggregation":
        sums = edges.groupBy("left_id").agg(F.sum("weight").alias("t"))
        parts.append(_rule(sums.filter(F.abs(F.col("t") - 1) > 1.001e-5), "left_weights_do_not_sum_to_one", F.col("left_id")))
    return _union(parts)


def unmapped(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """How many objects of each side carry no edge."""
    l = left.join(edges.select(F.col("left_id").alias("cell_id")), "cell_id", "left_anti").agg(F.count("*").alias("n")).withColumn("side", F.lit("left"))
    r = right.join(edges.select(F.col("right_id").alias("cell_id")), "cell_id", "left_anti").agg(F.count("*").alias("n")).withColumn("side", F.lit("right"))
    return l.unionByName(r).select("side", F.col("n").alias("unmapped_count"))


def measurement_layer(values: DataFrame, kind: str, assay_features: DataFrame, assay_ids: DataFrame) -> DataFrame:
    """Long layer (cell_id, feature_id, value) against its source assay; null stays missing."""
    if kind not in LAYER_KINDS:
        raise ValueError("unknown layer kind")
    pair = F.concat_ws("|", "cell_id", "feature_id")
    parts = [
        _rule(values.join(assay_features.select("feature_id"), "feature_id", "left_anti"), "feature_not_in_assay", pair),
        _rule(values.join(assay_ids.select("cell_id"), "cell_id", "left_anti"), "foreign_observation", pair),
        _rule(values.filter(F.abs("value") == float("inf")), "infinite_value", pair)]
    if kind == "unmeasured":
        parts.append(_rule(values.filter("value is not null"), "unmeasured_layer_has_values", pair))
    if kind == "measured_raw":
        parts.append(_rule(values.limit(1), "raw_layers_enter_through_sources_only", F.lit(kind)))
    return _union(parts)


def molecular_relations(relations: DataFrame, left_features: DataFrame, right_features: DataFrame) -> DataFrame:
    pair = F.concat_ws("|", "left_feature", "right_feature")
    return _union([
        _rule(relations.filter(~F.col("relation").isin(*MOLECULAR_RELATIONS)), "unknown_relation", pair),
        _rule(relations.join(left_features.select(F.col("feature_id").alias("left_feature")), "left_feature", "left_anti"), "left_feature_unmeasured", pair),
        _rule(relations.join(right_features.select(F.col("feature_id").alias("right_feature")), "right_feature", "left_anti"), "right_feature_unmeasured", pair)])


def protein_pairing(protein: DataFrame, cells: DataFrame, measurement_type: str, allow_partial: bool = False) -> DataFrame:
    """Value and id rules of a paired assay: no foreign ids, non-negative or missing, integers for counts."""
    pair = F.concat_ws("|", "cell_id", "feature_id")
    v = F.col("value")
    parts = [
        _rule(protein.join(cells.select("cell_id"), "cell_id", "left_anti"), "foreign_observation", pair),
        _rule(duplicates(protein, "cell_id", "feature_id"), "duplicate_measurement", pair),
        _rule(protein.filter((v < 0) | (v == float("inf"))), "invalid_value", pair)]
    if measurement_type == "antibody_count":
        parts.append(_rule(protein.filter(v != F.floor(v)), "antibody_count_not_integer", pair))
    if not allow_partial:
        parts.append(_rule(cells.join(protein.select("cell_id"), "cell_id", "left_anti"), "observation_without_protein", F.col("cell_id")))
    return _union(parts)


def study_design(sections: DataFrame) -> DataFrame:
    owners = sections.select("sample_id", "subject_id", "condition").distinct()
    return _union([
        _rule(duplicates(sections, "section_id"), "duplicate_section", F.col("section_id")),
        _rule(duplicates(owners, "sample_id"), "sample_has_several_owners", F.col("sample_id")),
        _rule(sections.filter(~F.col("roi_origin").isin(*ROI_ORIGINS) | F.col("roi_origin").isNull()), "unknown_roi_origin", F.col("section_id"))])


def study_records(records: DataFrame, sections: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Records must name a declared section and metric once, carry its source and run, and be finite."""
    pair = F.concat_ws("|", "section_id", "metric")
    owned = records.join(sections.select("section_id", F.col("source_sha256").alias("_src"), "run_ids"), "section_id")
    per_metric = records.groupBy("metric").agg(F.count_distinct("units").alias("u"), F.count_distinct("method_version").alias("v"))
    parts = [
        _rule(records.join(sections.select("section_id"), "section_id", "left_anti"), "section_out_of_scope", pair),
        _rule(duplicates(records, "section_id", "metric"), "duplicate_record", pair),
        _rule(owned.filter((F.col("source_sha256") != F.col("_src")) | ~F.array_contains("run_ids", F.col("run_id"))), "source_or_run_mismatch", pair),
        _rule(records.filter(_bad_number(F.col("value"))), "nonfinite_value", pair),
        _rule(per_metric.filter("u != 1 or v != 1"), "mixed_units_or_versions", F.col("metric"))]
    if metrics is not None:
        parts.append(_rule(records.filter(~F.col("metric").isin(*metrics)), "metric_out_of_scope", pair))
    return _union(parts)


def digests_match(before: DataFrame, after: DataFrame) -> DataFrame:
    """Source files whose digest changed between two audits (path, sha256)."""
    a = after.select("path", F.col("sha256").alias("_after"))
    return before.join(a, "path", "full_outer").filter(F.expr("not (sha256 <=> _after)")).select("path", "sha256", F.col("_after").alias("sha256_after"))
