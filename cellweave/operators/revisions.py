"""Versioned annotation overlays over immutable source cells."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ("label", "included", "region")


def materialise(source: DataFrame, overlays: DataFrame, revision: str | None) -> DataFrame:
    """Cells at a revision: the overlay wins field by field, the source row supplies the rest."""
    if revision is None:
        return source
    present = [f for f in FIELDS if f in overlays.columns]
    over = overlays.filter(F.col("revision_id") == revision).select("cell_id", *[F.col(f).alias(f"_o_{f}") for f in present])
    return (source.join(over, "cell_id", "left")
            .withColumns({f: F.coalesce(f"_o_{f}", f) for f in present}).drop(*[f"_o_{f}" for f in present]))


def propose(cells: DataFrame, selected: DataFrame, changes: Mapping[str, object]) -> DataFrame:
    """Before/after of the fields that really differ, for selected cells; rows without a change drop out."""
    if not changes or set(changes) - set(FIELDS):
        raise ValueError("changes may contain label, included and region only")
    out = cells.join(selected.select("cell_id"), "cell_id", "left_semi")
    differs = {f: ~F.col(f).eqNullSafe(F.lit(v)) for f, v in changes.items()}
    any_change: Column = F.lit(False)
    for d in differs.values():
        any_change = any_change | d
    return out.filter(any_change).select("cell_id", *[
        c for f, v in changes.items() for c in
        (F.when(differs[f], F.col(f)).alias(f"{f}_before"), F.when(differs[f], F.lit(v)).alias(f"{f}_after"))])


def apply_delta(overlays: DataFrame, parent: str, delta: DataFrame, revision: str) -> DataFrame:
    """The next cumulative overlay: the parent's rows with the delta's fields on top."""
    types = dict(overlays.dtypes)
    fields = [f for f in FIELDS if f in types]
    old = overlays.filter(F.col("revision_id") == parent).select("cell_id", F.lit(0).alias("_seq"), *fields)
    new = delta.select("cell_id", F.lit(1).alias("_seq"), *[
        (F.col(f"{f}_after") if f"{f}_after" in delta.columns else F.lit(None)).cast(types[f]).alias(f) for f in fields])
    return (old.unionByName(new).groupBy("cell_id")
            .agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_seq"))).alias(f) for f in fields])
            .select(F.lit(revision).alias("revision_id"), "cell_id", *fields))


def revert(overlays: DataFrame, target: str, revision: str) -> DataFrame:
    return overlays.filter(F.col("revision_id") == target).withColumn("revision_id", F.lit(revision))


def _paired(before: DataFrame, after: DataFrame, roi: DataFrame | None) -> DataFrame:
    b = before.select("cell_id", *[F.col(f).alias(f"{f}_before") for f in FIELDS])
    a = after.select("cell_id", *[F.col(f).alias(f"{f}_after") for f in FIELDS])
    both = b.join(a, "cell_id").withColumns({f"{f}_changed": ~F.col(f"{f}_before").eqNullSafe(F.col(f"{f}_after")) for f in FIELDS})
    if roi is None:
        return both.withColumn("in_selection", F.lit(True))
    marks = roi.select("cell_id").distinct().withColumn("in_selection", F.lit(True))
    return both.join(marks, "cell_id", "left").withColumn("in_selection", F.coalesce("in_selection", F.lit(False)))


def diff_counts(before: DataFrame, after: DataFrame, roi: DataFrame | None = None) -> DataFrame:
    both = _paired(before, after, roi)
    changed = F.col("label_changed") | F.col("included_changed") | F.col("region_changed")
    names = {"label": "label_changes", "included": "exclusion_changes", "region": "region_changes"}
    return both.agg(
        *[F.count_if(F.col(f"{f}_changed")).alias(n) for f, n in names.items()],
        *[F.count_if(F.col(f"{f}_changed") & F.col("in_selection")).alias(f"selected_{n}") for f, n in names.items()],
        F.count_if(changed).alias("changed_cell_count"))


def diff_preview(before: DataFrame, after: DataFrame, roi: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """The first changed cells by id, with before and after; ``diff_counts`` holds the full count."""
    both = _paired(before, after, roi)
    changed = F.col("label_changed") | F.col("included_changed") | F.col("region_changed")
    out = both.filter(changed).orderBy("cell_id").limit(limit)
    return out.select("cell_id", "in_selection", *[
        F.when(F.col(f"{f}_changed"), F.col(f"{f}_{side}").cast("string")).alias(f"{f}_{side}") for f in FIELDS for side in ("before", "after")])


def stale_runs(runs: DataFrame, head: str) -> DataFrame:
    return runs.withColumn("stale", F.col("target_revision") != head)


def applicability(cells_at_head: DataFrame, fit_ids: DataFrame, whole_slice: bool, uses_annotations: bool,
                  fit_revision: str, head: str) -> DataFrame:
    """Does a fitted result still describe the head revision? One row of flags."""
    active = cells_at_head.filter("included").select("cell_id", F.lit(1).alias("_a"))
    fit = fit_ids.select("cell_id", F.lit(1).alias("_f"))
    both = active.join(fit, "cell_id", "full_outer").agg(
        F.count_if(F.col("_a").isNull()).alias("fit_not_active"), F.count_if(F.col("_f").isNull()).alias("active_not_fit"))
    moved = head != fit_revision
    changed = (F.col("fit_not_active") > 0) | (F.lit(whole_slice) & (F.col("active_not_fit") > 0))
    return both.select("fit_not_active", "active_not_fit", F.lit(moved).alias("annotation_changed_since_fit"),
                       changed.alias("fit_population_changed"), (changed | F.lit(uses_annotations and moved)).alias("refit_required"))


def fixed_model_filter(result_rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Parent result rows whose cell is still included; values stay untouched."""
    return result_rows.join(cells.filter("included").select("cell_id"), "cell_id", "left_semi")


def overlay_violations(source: DataFrame, overlays: DataFrame, parents: Mapping[str, str | None],
                       deltas: Mapping[str, DataFrame], reverts: Mapping[str, str] | None = None) -> DataFrame:
    """Replay audit: unknown cells, duplicate overlay rows, and overlays that are not parent + delta."""
    fields = [f for f in FIELDS if f in overlays.columns]
    unknown = overlays.join(source.select("cell_id"), "cell_id", "left_anti").select("revision_id", "cell_id", F.lit("unknown_cell").alias("rule"))
    twice = overlays.groupBy("revision_id", "cell_id").count().filter("count > 1").select("revision_id", "cell_id", F.lit("duplicate_overlay_row").alias("rule"))
    out = unknown.unionByName(twice)
    for revision, parent in parents.items():
        if revision in (reverts or {}):
            expected = revert(overlays, reverts[revision], revision)
        elif revision in deltas:
            expected = apply_delta(overlays, parent or "", deltas[revision], revision)
        else:
            continue
        out = out.unionByName(table_mismatch(
            overlays.filter(F.col("revision_id") == revision).select("cell_id", *fields), expected.select("cell_id", *fields), ["cell_id"])
            .groupBy("cell_id").agg(F.lit(revision).alias("revision_id"), F.lit("overlay_is_not_parent_plus_delta").alias("rule"))
            .select("revision_id", "cell_id", "rule"))
    return out


def table_mismatch(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Field-by-field comparison of a stored result with its recomputation: (keys, field, stored, recomputed)."""
    types = dict(stored.dtypes)
    fields = [c for c in stored.columns if c not in keys]
    s = stored.select(*keys, F.lit(True).alias("_s"), *[F.col(c).alias(f"_s_{c}") for c in fields])
    r = recomputed.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in fields])
    both = s.join(r, list(keys), "full_outer")
    entries = []
    for c in fields:
        a, b = F.col(f"_s_{c}"), F.col(f"_r_{c}")
        equal = a.eqNullSafe(b)
        if types[c] in ("double", "float"):
            close = F.abs(a - b) <= F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)))
            equal = equal | F.coalesce(close, F.lit(False))
        entries.append(F.struct(F.lit(c).alias("field"), a.cast("string").alias("stored"), b.cast("string").alias("recomputed"),
                                (equal & F.col("_s").isNotNull() & F.col("_r").isNotNull()).alias("ok")))
    return both.select(*keys, F.explode(F.array(*entries)).alias("e")).filter("not e.ok").select(*keys, "e.field", "e.stored", "e.recomputed")
