"""Neighbour enrichment of a target label around a source label, over grids of states, radii and scopes.

A *state* is one assignment of labels and inclusion flags to the same fixed positions: a revision or a
what-if variant. All states, radii and scopes share one count of neighbours, because positions never change:
cells are first folded to distinct positions carrying per-state counts, so coincident copies cost one row,
and tiles wholly within a radius add their totals, so pairs of points are met along the rim only.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .dual_tiles import radius_sums

SCOPES = ("whole_slice", "roi_induced")
BACKGROUNDS = ("neighbor_universe", "imported_universe", "selection")


def with_membership(cells: DataFrame, members: DataFrame | None, flag: str, default: bool = True) -> DataFrame:
    if members is None:
        return cells.withColumn(flag, F.lit(default))
    marks = members.select("cell_id").distinct().withColumn(flag, F.lit(True))
    return cells.join(marks, "cell_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def revision_states(source: DataFrame, overlays: DataFrame, revisions: Sequence[str | None]) -> DataFrame:
    """Cells with ``labels``/``incl`` arrays, one entry per revision (None is the import itself)."""
    wanted = [r for r in revisions if r is not None]
    if wanted:
        picked = overlays.filter(F.col("revision_id").isin(*wanted)).groupBy("cell_id").agg(*[
            F.max(F.when(F.col("revision_id") == r, F.col(c))).alias(f"_{c}{i}")
            for i, r in enumerate(wanted) for c in ("label", "included")])
        cells = source.join(picked, "cell_id", "left")
    else:
        cells = source

    def at(column: str) -> list[Column]:
        return [F.col(column) if r is None else F.coalesce(F.col(f"_{column}{wanted.index(r)}"), F.col(column)) for r in revisions]

    return cells.select("cell_id", "x", "y", "region", F.array(*at("label")).alias("labels"), F.array(*at("included")).alias("incl"))


def variant_states(cells: DataFrame, members: DataFrame, variants: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """State 0 is the baseline; every variant restarts from it and changes its own members only.

    ``members`` holds (variant, cell_id); ``variants`` maps a name to its label/included changes.
    """
    sets = members.groupBy("cell_id").agg(F.collect_set("variant").alias("_in"))  # at most one entry per variant
    joined = cells.join(sets, "cell_id", "left")

    def state(column: str) -> list[Column]:
        out = [F.col(column)]
        for name, changes in variants.items():
            hit = F.coalesce(F.array_contains("_in", name), F.lit(False))
            out.append(F.when(hit, F.lit(changes[column])).otherwise(F.col(column)) if column in changes else F.col(column))
        return out

    return joined.select("cell_id", "x", "y", "region", F.array(*state("label")).alias("labels"), F.array(*state("included")).alias("incl"))


def neighbour_grid(states: DataFrame, n_states: int, radii: Sequence[float], source: str, target: str,
                   scopes: Sequence[str] = ("whole_slice",), roi: DataFrame | None = None,
                   background: str = "neighbor_universe", background_members: DataFrame | None = None) -> DataFrame:
    """Raw neighbour sums, one row per (state, scope, radius), split by whether sources sit in the background."""
    if not set(scopes) <= set(SCOPES) or background not in BACKGROUNDS or not radii:
        raise ValueError("unknown scope or background, or no radius")
    if (background == "selection") != (background_members is not None):
        raise ValueError("a selection background needs its members, other kinds take none")
    frame = with_membership(with_membership(states, roi, "in_roi"), background_members, "in_bg")
    s_range, same = range(n_states), source == target
    columns: list[Column] = []
    for s in s_range:
        inc, lab = F.col("incl")[s], F.col("labels")[s]
        is_target = lab == target
        nodes = {"whole_slice": inc, "roi_induced": inc & F.col("in_roi")}
        for scope in scopes:
            columns += [nodes[scope], nodes[scope] & is_target]
        base = {"neighbor_universe": None, "imported_universe": inc, "selection": inc & F.col("in_bg")}[background]
        for scope in scopes:
            members = nodes[scope] if base is None else base
            columns += [members, members & is_target]
        columns.append(inc & F.col("in_roi") & (lab == source))
    width = 4 * len(scopes) + 1
    sums = [F.sum(c.cast("bigint")).alias(f"_v{i}") for i, c in enumerate(columns)]
    positions = materialise(frame.groupBy("x", "y", "in_bg").agg(*sums)
                            .select("x", "y", "in_bg", F.array(*[F.col(f"_v{i}") for i in range(len(columns))]).alias("v")))

    def slot(s: int, j: int) -> int:
        return s * width + j

    total = positions.agg(*[F.sum(F.col("v")[i]).alias(f"_g{i}") for i in range(len(columns))])
    cells = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(scope).alias("scope"),
                 F.coalesce(F.col(f"_g{slot(s, 2 * q)}"), F.lit(0)).alias("node_count"),
                 F.coalesce(F.col(f"_g{slot(s, 2 * q + 1)}"), F.lit(0)).alias("target_count"),
                 F.coalesce(F.col(f"_g{slot(s, 2 * len(scopes) + 2 * q)}"), F.lit(0)).alias("background_count"),
                 F.coalesce(F.col(f"_g{slot(s, 2 * len(scopes) + 2 * q + 1)}"), F.lit(0)).alias("background_target_count"),
                 F.coalesce(F.col(f"_g{slot(s, 4 * len(scopes))}"), F.lit(0)).alias("source_count"))
        for s in s_range for q, scope in enumerate(scopes)])
    radius_list = F.array(*[F.lit(float(r)) for r in radii])
    grid = total.select(F.explode(cells).alias("c")).select("c.*").withColumn("radius", F.explode(radius_list))

    is_source = F.lit(False)
    for s in s_range:
        is_source = is_source | (F.col("v")[slot(s, 4 * len(scopes))] > 0)
    sources = positions.filter(is_source).select(
        "x", "y", F.col("x").alias("px"), F.col("y").alias("py"), F.col("in_bg").alias("src_bg"),
        F.array(*[F.col("v")[slot(s, 4 * len(scopes))] for s in s_range]).alias("m"))
    nodes = positions.select("x", "y", F.array(*[F.col("v")[slot(s, 2 * q + t)] for s in s_range for q in range(len(scopes)) for t in (0, 1)]).alias("n"))
    flat = [(s, q) for s in s_range for q in range(len(scopes))]
    around = radius_sums(sources, nodes, radii, ["px", "py", "src_bg"], ["m"], 2 * len(flat))
    entries = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(scopes[q]).alias("scope"), F.col("m")[s].alias("m"),
                 (F.col("n")[2 * i] - 1).alias("deg"), (F.col("n")[2 * i + 1] - int(same)).alias("hit"))
        for i, (s, q) in enumerate(flat)])
    per_position = around.select("src_bg", "radius", F.explode(entries).alias("e")).select("src_bg", "radius", "e.*").filter("m > 0")
    linked = F.col("deg") > 0
    by_side = [(F.col("src_bg") == flag, tag) for flag, tag in ((True, "in"), (False, "out"))]
    m = F.col("m")
    stats = per_position.groupBy("state", "scope", "radius").agg(
        F.sum(m * F.col("deg")).alias("directed_source_edges"), F.sum(m * F.col("hit")).alias("target_edges"),
        F.sum(F.when(linked, 0).otherwise(m)).alias("isolated_sources"), F.max("deg").alias("max_source_degree"),
        *[F.sum(F.when(side & linked, m).otherwise(0)).alias(f"_linked_{tag}") for side, tag in by_side],
        *[F.sum(F.when(side, m * F.col("deg")).otherwise(0)).alias(f"_edges_{tag}") for side, tag in by_side],
        F.sum(F.when(linked, m * F.col("hit") / F.col("deg"))).alias("_ratio"))
    out = grid.join(stats, ["state", "scope", "radius"], "left")
    zero = ["directed_source_edges", "target_edges", "max_source_degree", "_linked_in", "_linked_out", "_edges_in", "_edges_out"]
    return (out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
            .withColumns({"isolated_sources": F.coalesce("isolated_sources", "source_count"),
                          "_same": F.lit(int(same)), "sources_with_neighbors": F.col("_linked_in") + F.col("_linked_out")}))


def _verdict(out: DataFrame, reason: Column, observed: Column, null: Column, threshold: float) -> DataFrame:
    out = out.withColumn("_why", reason)
    ok = F.col("_why").isNull()
    out = out.withColumns({"observed_fraction": F.when(ok, observed), "null_fraction": F.when(ok, null)})
    excess = F.col("observed_fraction") - F.col("null_fraction")
    meets = excess >= F.lit(float(threshold))
    return out.withColumns({
        "excess_over_abundance": excess,
        "classification": F.when(~ok, "inconclusive").when(meets, "descriptive_supported").otherwise("descriptive_not_supported"),
        "reason": F.coalesce("_why", F.when(meets, "excess_meets_declared_threshold").otherwise("excess_below_declared_threshold")),
    }).drop("_why")


def edge_weighted(grid: DataFrame, threshold: float) -> DataFrame:
    """Target fraction over all source edges minus the non-self target abundance among nodes."""
    targets, others = F.col("target_count") - F.col("_same"), F.col("node_count") - 1
    reason = (F.when(F.col("source_count") == 0, "source_label_absent_from_included_selection")
              .when(F.col("target_count") == 0, "target_label_absent_from_neighbor_universe")
              .when(F.col("directed_source_edges") == 0, "no_eligible_source_neighbor_edges")
              .when((others <= 0) | (targets <= 0), "nonself_target_abundance_null_unavailable"))
    out = _verdict(grid, reason, F.col("target_edges") / F.col("directed_source_edges"), targets / others, threshold)
    return out.withColumn("expected_target_edges", F.col("directed_source_edges") * F.col("null_fraction"))


def dual_weighted(grid: DataFrame, threshold: float) -> DataFrame:
    """Two estimands per grid row, method = edge_weighted | source_equal_weighted, with per-source nulls."""
    same, count, hits = F.col("_same"), F.col("background_count"), F.col("background_target_count")
    null_in, null_out = (hits - same) / F.nullif(count - 1, F.lit(0)), hits / F.nullif(count, F.lit(0))
    undefined = (F.when(count - 1 <= 0, F.col("_linked_in")).otherwise(0) + F.when(count <= 0, F.col("_linked_out")).otherwise(0))
    reason = (F.when(F.col("source_count") == 0, "source_label_absent_from_included_selection")
              .when(F.col("target_count") == 0, "target_label_absent_from_neighbor_universe")
              .when(F.col("directed_source_edges") == 0, "no_eligible_source_neighbor_edges")
              .when((same == 1) & (F.col("target_count") <= 1), "nonself_target_label_absent_from_neighbor_universe")
              .when((undefined > 0) | (count == 0), "nonself_target_abundance_background_unavailable"))
    use_in, use_out = F.col("_linked_in") > 0, F.col("_linked_out") > 0
    share = F.coalesce(F.when(use_in, F.col("_linked_in") * null_in), F.lit(0.0)) + F.coalesce(F.when(use_out, F.col("_linked_out") * null_out), F.lit(0.0))
    edge_share = F.coalesce(F.when(use_in, F.col("_edges_in") * null_in), F.lit(0.0)) + F.coalesce(F.when(use_out, F.col("_edges_out") * null_out), F.lit(0.0))
    marked = grid.withColumns({
        "null_low": F.least(F.when(use_in, null_in), F.when(use_out, null_out)),
        "null_high": F.greatest(F.when(use_in, null_in), F.when(use_out, null_out)),
        "sources_with_unavailable_background": undefined,
        "_m": F.explode(F.array(F.lit("edge_weighted"), F.lit("source_equal_weighted")))}).withColumnRenamed("_m", "method")
    edge = F.col("method") == "edge_weighted"
    observed = F.when(edge, F.col("target_edges") / F.col("directed_source_edges")).otherwise(F.col("_ratio") / F.col("sources_with_neighbors"))
    null = F.when(edge, edge_share / F.col("directed_source_edges")).otherwise(share / F.col("sources_with_neighbors"))
    out = _verdict(marked, reason, observed, null, threshold)
    return out.withColumns({
        "status": F.when(F.col("observed_fraction").isNull(), "unknown").otherwise("computed"),
        "classification": F.when(F.col("observed_fraction").isNull(), "unknown").otherwise(F.col("classification")),
        "reason": F.when(F.col("observed_fraction").isNull(), F.col("reason"))})


def compare_states(evaluated: DataFrame, unavailable: str = "inconclusive", keys: Sequence[str] = ("scope", "radius")) -> DataFrame:
    """Every non-baseline state against state 0 on the same grid keys."""
    kept = ["observed_fraction", "null_fraction", "excess_over_abundance", "classification", "reason",
            "directed_source_edges", "target_edges", "node_count", "source_count"]
    before = evaluated.filter("state = 0").select(*keys, *[F.col(c).alias(f"before_{c}") for c in kept])
    after = evaluated.filter("state > 0").select("state", *keys, *[F.col(c).alias(f"after_{c}") for c in kept])
    complete = (F.col("before_classification") != unavailable) & (F.col("after_classification") != unavailable)

    def delta(name: str) -> Column:
        return F.when(complete, F.col(f"after_{name}") - F.col(f"before_{name}"))

    return after.join(F.broadcast(before), list(keys)).withColumns({  # before: one row per scope and radius
        "status": F.when(~complete, "indeterminate").when(F.col("before_classification") == F.col("after_classification"), "stable").otherwise("changed"),
        "effect_delta": delta("excess_over_abundance"), "observed_fraction_delta": delta("observed_fraction"),
        "null_fraction_delta": delta("null_fraction"),
        "edge_delta": F.col("after_directed_source_edges") - F.col("before_directed_source_edges"),
        "target_edge_delta": F.col("after_target_edges") - F.col("before_target_edges"),
        "node_delta": F.col("after_node_count") - F.col("before_node_count"),
        "source_delta": F.col("after_source_count") - F.col("before_source_count")})


def variant_changes(states: DataFrame, names: Sequence[str], roi: DataFrame | None) -> DataFrame:
    """How many cells each variant really changes, overall and inside the ROI."""
    frame = with_membership(states, roi, "in_roi")
    entries = F.array(*[
        F.struct(F.lit(name).alias("variant"), F.lit(i).alias("state"),
                 ((F.col("labels")[i] != F.col("labels")[0]) | (F.col("incl")[i] != F.col("incl")[0])).alias("changed"))
        for i, name in enumerate(names, 1)])
    return (frame.select("in_roi", F.explode(entries).alias("e")).groupBy("e.variant", "e.state")
            .agg(F.count_if("e.changed").alias("actual_changed_count"),
                 F.count_if(F.col("e.changed") & F.col("in_roi")).alias("changed_in_analysis_roi")))


def coverage(states: DataFrame, n_states: int, radii: Sequence[float], source: str, bounds: Sequence[float],
             roi: DataFrame | None = None) -> DataFrame:
    """Smallest distance of any baseline or variant source to the window edge, against each radius."""
    x0, y0, x1, y1 = map(float, bounds)
    frame = with_membership(states, roi, "in_roi").filter("in_roi")
    edge = F.least(F.col("x") - x0, x1 - F.col("x"), F.col("y") - y0, y1 - F.col("y"))
    hit = [F.col("incl")[s] & (F.col("labels")[s] == source) for s in range(n_states)]
    margins = frame.agg(*[F.min(F.when(hit[0] | hit[s], edge)).alias(f"_m{s}") for s in range(1, n_states)])
    rows = F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"_m{s}").alias("margin")) for s in range(1, n_states)])
    return (margins.select(F.explode(rows).alias("r")).select("r.*")
            .withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
            .withColumn("neighbor_coverage", F.when(F.col("margin").isNull(), "not_established")
                        .when(F.col("margin") >= F.col("radius"), "complete_for_radius_within_declared_window")
                        .otherwise("window_boundary_may_truncate_neighbors")))


def difference_order(rows: DataFrame, delta: str = "max_abs_delta", key: str = "row_id") -> DataFrame:
    """Rank of all declared grid rows by descending largest change; unknown rows last. The grid is bounded (<= 96 rows)."""
    from pyspark.sql import Window as W
    order = W.orderBy(F.col(delta).desc_nulls_last(), F.col(key).asc())
    return rows.withColumn("difference_rank", F.row_number().over(order))
