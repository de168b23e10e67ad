"""Selections, predicates, revisions and neighbourhood comparisons."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P
from ..operators import filters, neighbourhood as N, polygons, revisions as R, spatial
from .registry import query
from .tables import FIELDS, PROGRAM_A, PROGRAM_B, ROI, SOURCE, TARGET, VIEW, WINDOW, Tables

D = 8  # digits kept when doubles are compared


def rounded(df: DataFrame, *columns: str, digits: int = D) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- neighbourhoods ---------------------------------------------------------------------------

def enrich_sql(tag: str, cells: str, scope: str, radius: float) -> str:
    """Table expression ``tag``: the raw neighbour sums of one state, scope and radius."""
    node = f"{cells} where included" + ("" if scope == "whole_slice" else " and cell_id in (select cell_id from roi)")
    return f"""{tag}_node as (select * from {node}),
    {tag}_src as (select * from {cells} where included and label='{SOURCE}' and cell_id in (select cell_id from roi)),
    {tag}_deg as (select s.cell_id, count(n.cell_id) as deg, count(case when n.label='{TARGET}' then 1 end) as hit
        from {tag}_src s left join {tag}_node n on n.cell_id<>s.cell_id and (s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y) <= {radius}*{radius} group by s.cell_id),
    {tag} as (select *, edges>0 and targets>0 as ok, case when edges>0 and targets>0 then hits/edges::double end as obs, case when edges>0 and targets>0 then targets/(nodes-1)::double end as nul from
        (select (select count(*) from {tag}_node) as nodes, (select count(*) from {tag}_node where label='{TARGET}') as targets,
        count(*) as sources, coalesce(sum(deg),0)::bigint as edges, coalesce(sum(hit),0)::bigint as hits, count(case when deg=0 then 1 end) as isolated,
        coalesce(max(deg),0) as maxdeg, count(case when deg>0 then 1 end) as linked, avg(case when deg>0 then hit/deg::double end) as mean_ratio from {tag}_deg))"""


_CLASS = "case when not ok then 'inconclusive' when obs-nul >= {t} then 'descriptive_supported' else 'descriptive_not_supported' end"
_REASON = """case when sources=0 then 'source_label_absent_from_included_selection' when targets=0 then 'target_label_absent_from_neighbor_universe'
    when edges=0 then 'no_eligible_source_neighbor_edges' when obs-nul >= {t} then 'excess_meets_declared_threshold' else 'excess_below_declared_threshold' end"""


def neighbourhood_comparison(t: Tables, radius: float = 35.0, threshold: float = 0.05) -> DataFrame:
    """Flagship: the same frozen ROI before and after revision r2, with the change summary."""
    filters.require_physical_units(t.slices)
    states = N.revision_states(t.cells, t.overlays, [None, "r2"])
    grid = N.neighbour_grid(states, 2, [radius], SOURCE, TARGET, roi=t.roi)
    compared = N.compare_states(N.edge_weighted(grid, threshold)).withColumn("_k", F.lit(1))
    changes = R.diff_counts(t.cells, t.at("r2"), t.roi).withColumn("_k", F.lit(1))
    doubles = ["before_observed_fraction", "before_null_fraction", "before_excess_over_abundance", "after_observed_fraction", "after_null_fraction",
               "after_excess_over_abundance", "effect_delta", "observed_fraction_delta", "null_fraction_delta"]
    return rounded(compared.join(changes, "_k").drop("_k", "state", "scope", "radius"), *doubles)  # one row each


_COMPARE = "with " + enrich_sql("b", "cells_r0", "whole_slice", 35) + "," + enrich_sql("a", "cells_r2", "whole_slice", 35) + f""",
bb as (select *, {_CLASS.format(t=0.05)} as cls, {_REASON.format(t=0.05)} as why from b), aa as (select *, {_CLASS.format(t=0.05)} as cls, {_REASON.format(t=0.05)} as why from a),
ch as (select count(case when o.label<>n.label then 1 end) as label_changes, count(case when o.included<>n.included then 1 end) as exclusion_changes,
    count(case when o.region<>n.region then 1 end) as region_changes,
    count(case when o.label<>n.label and r.cell_id is not null then 1 end) as selected_label_changes, count(case when o.included<>n.included and r.cell_id is not null then 1 end) as selected_exclusion_changes,
    count(case when o.region<>n.region and r.cell_id is not null then 1 end) as selected_region_changes,
    count(case when o.label<>n.label or o.included<>n.included or o.region<>n.region then 1 end) as changed_cell_count
    from cells_r0 o join cells_r2 n on o.cell_id=n.cell_id left join roi r on r.cell_id=o.cell_id)
select round(bb.obs,8) as before_observed_fraction, round(bb.nul,8) as before_null_fraction, round(bb.obs-bb.nul,8) as before_excess_over_abundance, bb.cls as before_classification, bb.why as before_reason,
    bb.edges as before_directed_source_edges, bb.hits as before_target_edges, bb.nodes as before_node_count, bb.sources as before_source_count,
    round(aa.obs,8) as after_observed_fraction, round(aa.nul,8) as after_null_fraction, round(aa.obs-aa.nul,8) as after_excess_over_abundance, aa.cls as after_classification, aa.why as after_reason,
    aa.edges as after_directed_source_edges, aa.hits as after_target_edges, aa.nodes as after_node_count, aa.sources as after_source_count,
    case when not aa.ok or not bb.ok then 'indeterminate' when aa.cls=bb.cls then 'stable' else 'changed' end as status,
    round((aa.obs-aa.nul)-(bb.obs-bb.nul),8) as effect_delta, round(aa.obs-bb.obs,8) as observed_fraction_delta, round(aa.nul-bb.nul,8) as null_fraction_delta,
    aa.edges-bb.edges as edge_delta, aa.hits-bb.hits as target_edge_delta, aa.nodes-bb.nodes as node_delta, aa.sources-bb.sources as source_delta, ch.*
from bb, aa, ch"""


@query("ML_20_neighbourhood_comparison", ["cells_r0", "cells_r2", "roi"], _COMPARE)
def ml_20(t: Tables) -> DataFrame:
    return neighbourhood_comparison(t)


@query("JOIN_01_radius_neighbours", ["cells_r0"], f"""select s.cell_id as src, n.cell_id as dst, round(sqrt((s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y)),8) as dist
    from cells_r0 s join cells_r0 n on s.cell_id<>n.cell_id and (s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y) <= 35*35 where s.included and n.included and s.label='{SOURCE}'""")
def join_01(t: Tables) -> DataFrame:
    sources, nodes = spatial.scoped_nodes(t.cells, None, "whole_slice")
    return rounded(spatial.radius_edges(sources.filter(F.col("label") == SOURCE), nodes, 35.0), "dist")


def _enrichment_columns(df: DataFrame) -> DataFrame:
    return rounded(df.select("scope", "node_count", "target_count", "source_count", "directed_source_edges", "target_edges", "isolated_sources", "max_source_degree",
                             "observed_fraction", "null_fraction", "expected_target_edges", "excess_over_abundance", "classification", "reason"),
                   "observed_fraction", "null_fraction", "expected_target_edges", "excess_over_abundance")


def _enrich_select(tag: str, scope: str) -> str:
    return f"""select '{scope}' as scope, nodes as node_count, targets as target_count, sources as source_count, edges as directed_source_edges, hits as target_edges,
    isolated as isolated_sources, maxdeg as max_source_degree, round(obs,8) as observed_fraction, round(nul,8) as null_fraction, round(edges*nul,8) as expected_target_edges,
    round(obs-nul,8) as excess_over_abundance, {_CLASS.format(t=0.05)} as classification, {_REASON.format(t=0.05)} as reason from {tag}"""


@query("AGG_02_neighbour_enrichment", ["cells_r0", "roi"], "with " + enrich_sql("w", "cells_r0", "whole_slice", 35) + "," + enrich_sql("i", "cells_r0", "roi_induced", 35)
       + _enrich_select("w", "whole_slice").join(["\n", " union all "]) + _enrich_select("i", "roi_induced"))
def agg_02(t: Tables) -> DataFrame:
    states = N.revision_states(t.cells, t.overlays, [None])
    grid = N.neighbour_grid(states, 1, [35.0], SOURCE, TARGET, scopes=N.SCOPES, roi=t.roi)
    return _enrichment_columns(N.edge_weighted(grid, 0.05))


@query("AGG_03_source_equal_enrichment", ["cells_r0", "roi"], "with " + enrich_sql("w", "cells_r0", "whole_slice", 35) + """
    select 'edge_weighted' as method, round(obs,8) as observed_fraction, round(nul,8) as null_fraction, round(obs-nul,8) as excess_over_abundance, linked as sources_with_neighbors, isolated as isolated_sources from w
    union all select 'source_equal_weighted', round(mean_ratio,8), round(nul,8), round(mean_ratio-nul,8), linked, isolated from w""")
def agg_03(t: Tables) -> DataFrame:
    states = N.revision_states(t.cells, t.overlays, [None])
    out = N.dual_weighted(N.neighbour_grid(states, 1, [35.0], SOURCE, TARGET, roi=t.roi), 0.05)
    return rounded(out.select("method", "observed_fraction", "null_fraction", "excess_over_abundance", "sources_with_neighbors", "isolated_sources"),
                   "observed_fraction", "null_fraction", "excess_over_abundance")


_BG = "with " + enrich_sql("w", "cells_r0", "whole_slice", 35) + """, bg as (select * from cells_r0 where included and region in ('n1','n2','n3','n4','n5','n6')),
    n as (select (select count(*) from bg) as c, (select count(*) from bg where label='MACHINERY') as h),
    s as (select d.deg, d.hit, n.h/(n.c - case when b.cell_id is null then 0 else 1 end)::double as nul from w_deg d left join bg b on b.cell_id=d.cell_id, n where d.deg>0)
    select 'edge_weighted' as method, round(sum(hit)/sum(deg)::double,8) as observed_fraction, round(sum(nul*deg)/sum(deg),8) as null_fraction, round(min(nul),8) as null_low, round(max(nul),8) as null_high from s
    union all select 'source_equal_weighted', round(avg(hit/deg::double),8), round(avg(nul),8), round(min(nul),8), round(max(nul),8) from s"""


@query("AGG_04_selected_background", ["cells_r0", "roi"], _BG)
def agg_04(t: Tables) -> DataFrame:
    states = N.revision_states(t.cells, t.overlays, [None])
    members = t.cells.filter(F.col("region").isin("n1", "n2", "n3", "n4", "n5", "n6")).select("cell_id")
    out = N.dual_weighted(N.neighbour_grid(states, 1, [35.0], SOURCE, TARGET, roi=t.roi, background="selection", background_members=members), 0.05)
    return rounded(out.select("method", "observed_fraction", "null_fraction", "null_low", "null_high"), "observed_fraction", "null_fraction", "null_low", "null_high")


@query("AGG_05_before_after", ["cells_r0", "cells_r1", "cells_r2", "roi"], "with " + ",".join(enrich_sql(a, c, "whole_slice", 35) for a, c in (("b", "cells_r0"), ("p", "cells_r1"), ("q", "cells_r2")))
       + f""", x as (select 1 as state, p.* from p union all select 2, q.* from q), y as (select x.*, {_CLASS.format(t=0.05)} as cls from x), z as (select b.*, {_CLASS.format(t=0.05)} as cls from b)
    select y.state, case when not y.ok or not z.ok then 'indeterminate' when y.cls=z.cls then 'stable' else 'changed' end as status, round((y.obs-y.nul)-(z.obs-z.nul),8) as effect_delta,
    y.edges-z.edges as edge_delta, y.sources-z.sources as source_delta from y, z""")
def agg_05(t: Tables) -> DataFrame:
    states = N.revision_states(t.cells, t.overlays, [None, "r1", "r2"])
    out = N.compare_states(N.edge_weighted(N.neighbour_grid(states, 3, [35.0], SOURCE, TARGET, roi=t.roi), 0.05))
    return rounded(out.select("state", "status", "effect_delta", "edge_delta", "source_delta"), "effect_delta")


VARIANTS = {"relabel": {"label": TARGET}, "drop_negative": {"included": False}, "swap": {"label": SOURCE, "included": True}}
_MEMBERS_SQL = """members as (select 'relabel' as variant, cell_id from cells where label='BUILDING' and region in ('n3','n4')
    union all select 'drop_negative', cell_id from cells where qc_balance<1000 union all select 'swap', cell_id from cells where region='n9')"""
_VARIANT_SQL = ",".join(f"""v_{n} as (select c.cell_id, c.x, c.y, {lab} as label, {inc} as included, c.region from cells c left join members m on m.cell_id=c.cell_id and m.variant='{n}')""" for n, lab, inc in (
    ("relabel", "case when m.cell_id is null then c.label else 'MACHINERY' end", "c.included"),
    ("drop_negative", "c.label", "case when m.cell_id is null then c.included else false end"),
    ("swap", "case when m.cell_id is null then c.label else 'BUILDING' end", "case when m.cell_id is null then c.included else true end")))


def _members(t: Tables) -> DataFrame:
    pick = lambda name, where: t.cells.filter(where).select(F.lit(name).alias("variant"), "cell_id")
    return (pick("relabel", (F.col("label") == SOURCE) & F.col("region").isin("n3", "n4"))
            .unionByName(pick("drop_negative", F.col("qc_balance") < 1000)).unionByName(pick("swap", F.col("region") == "n9")))


def _grid_sql(radii=(20, 35), scopes=("whole_slice", "roi_induced")) -> str:
    out, rows = [], []
    for state, name in enumerate(("baseline", *VARIANTS)):
        cells = "cells_r0" if state == 0 else f"v_{name}"
        for scope in scopes:
            for r in radii:
                tag = f"g{state}_{scope[0]}_{r}"
                out.append(enrich_sql(tag, cells, scope, r))
                rows.append(f"select {state} as state, '{name}' as variant, '{scope}' as scope, {r}.0::double as radius, * from {tag}")
    return ",".join(out) + ", g as (" + " union all ".join(rows) + ")"


@query("ML_17_sensitivity_grid", ["cells_r0", "roi"], f"with {_MEMBERS_SQL},{_VARIANT_SQL},{_grid_sql()}, e as (select *, {_CLASS.format(t=0.05)} as cls from g)" + """,
    ch as (select v, count(*) as actual_changed_count, count(r.cell_id) as changed_in_analysis_roi from (
        select 'relabel' as v, c.cell_id from cells c join v_relabel n using (cell_id) where c.label<>n.label or c.included<>n.included
        union all select 'drop_negative', c.cell_id from cells c join v_drop_negative n using (cell_id) where c.label<>n.label or c.included<>n.included
        union all select 'swap', c.cell_id from cells c join v_swap n using (cell_id) where c.label<>n.label or c.included<>n.included) z left join roi r using (cell_id) group by v)
    select a.variant, a.scope, a.radius, round(b.obs-b.nul,8) as before_excess_over_abundance, round(a.obs-a.nul,8) as after_excess_over_abundance, a.edges as after_directed_source_edges,
        case when not a.ok or not b.ok then 'indeterminate' when a.cls=b.cls then 'stable' else 'changed' end as status, round((a.obs-a.nul)-(b.obs-b.nul),8) as effect_delta,
        ch.actual_changed_count, ch.changed_in_analysis_roi
    from e a join e b on b.state=0 and a.scope=b.scope and a.radius=b.radius join ch on ch.v=a.variant where a.state>0""")
def ml_17(t: Tables) -> DataFrame:
    states = N.variant_states(t.cells, _members(t), VARIANTS)
    out = N.compare_states(N.edge_weighted(N.neighbour_grid(states, 4, [20.0, 35.0], SOURCE, TARGET, scopes=N.SCOPES, roi=t.roi), 0.05))
    out = out.join(N.variant_changes(states, list(VARIANTS), t.roi), "state")
    return rounded(out.select("variant", "scope", "radius", "before_excess_over_abundance", "after_excess_over_abundance", "after_directed_source_edges", "status",
                              "effect_delta", "actual_changed_count", "changed_in_analysis_roi"),
                   "before_excess_over_abundance", "after_excess_over_abundance", "effect_delta")


@query("AGG_06_coverage_margin", ["cells_r0", "roi"], f"with {_MEMBERS_SQL},{_VARIANT_SQL}, s as (" + " union all ".join(
    f"select {i} as state, x, y from {c} join roi using (cell_id) where included and label='BUILDING'" for i, n in enumerate(VARIANTS, 1) for c in ("cells_r0", f"v_{n}"))
    + """), m as (select state, min(least(x-0.0, 1008.0-x, y-0.0, 996.0-y))::double as margin from s group by state)
    select state, margin, r::double as radius, case when margin is null then 'not_established' when margin>=r then 'complete_for_radius_within_declared_window' else 'window_boundary_may_truncate_neighbors' end as neighbor_coverage
    from m, (values (20.0),(35.0),(120.0)) v(r)""")
def agg_06(t: Tables) -> DataFrame:
    states = N.variant_states(t.cells, _members(t), VARIANTS)
    return N.coverage(states, 4, [20.0, 35.0, 120.0], SOURCE, WINDOW, t.roi)


@query("REV_07_what_if_changes", ["cells_r0", "roi"], f"with {_MEMBERS_SQL},{_VARIANT_SQL}" + """ select state, variant, count(case when changed then 1 end) as actual_changed_count, count(case when changed and r.cell_id is not null then 1 end) as changed_in_analysis_roi from (
    select 1 as state, 'relabel' as variant, c.cell_id, c.label<>n.label or c.included<>n.included as changed from cells c join v_relabel n using (cell_id)
    union all select 2, 'drop_negative', c.cell_id, c.label<>n.label or c.included<>n.included from cells c join v_drop_negative n using (cell_id)
    union all select 3, 'swap', c.cell_id, c.label<>n.label or c.included<>n.included from cells c join v_swap n using (cell_id)) z left join roi r using (cell_id) group by 1, 2""")
def rev_07(t: Tables) -> DataFrame:
    return N.variant_changes(N.variant_states(t.cells, _members(t), VARIANTS), list(VARIANTS), t.roi)


def plan_run(t: Tables) -> DataFrame:
    """A frozen plan: three variants x two radii x two scopes, both weightings, every declared row kept."""
    states = N.variant_states(t.cells, _members(t), VARIANTS)
    evaluated = N.dual_weighted(N.neighbour_grid(states, 4, [20.0, 35.0], SOURCE, TARGET, scopes=N.SCOPES, roi=t.roi), 0.05)
    pairs = N.compare_states(evaluated, "unknown", ("scope", "radius", "method"))
    names = F.array(*[F.lit(v) for v in VARIANTS])
    edge, equal = (F.max(F.when(F.col("method") == m, F.col("effect_delta"))) for m in ("edge_weighted", "source_equal_weighted"))
    rows = pairs.withColumn("variant", names[F.col("state") - 1]).groupBy("variant", "scope", "radius").agg(
        F.when(F.count_if(F.col("status") == "indeterminate") == 0, "computed").otherwise("unknown").alias("status"),
        edge.alias("edge_weighted_delta"), equal.alias("source_equal_delta"), F.max(F.abs("effect_delta")).alias("max_abs_delta"))
    return rows.withColumns({"row_id": F.concat_ws("|", "variant", "scope", F.col("radius").cast("int").cast("string")), "max_abs_delta": F.round("max_abs_delta", D)})


_PLAN = f"with {_MEMBERS_SQL},{_VARIANT_SQL},{_grid_sql()}" + """, d as (select a.variant, a.scope, a.radius, a.ok and b.ok as fine, (a.obs-a.nul)-(b.obs-b.nul) as d1, (a.mean_ratio-a.nul)-(b.mean_ratio-b.nul) as d2
    from g a join g b on b.state=0 and a.scope=b.scope and a.radius=b.radius where a.state>0),
    p as (select variant, scope, radius, case when fine then 'computed' else 'unknown' end as status, round(d1,8) as edge_weighted_delta, round(d2,8) as source_equal_delta,
        round(greatest(abs(d1),abs(d2)),8) as max_abs_delta, concat_ws('|',variant,scope,cast(cast(radius as int) as varchar)) as row_id from d)"""


@query("ML_18_frozen_plan", ["cells_r0", "roi"], _PLAN + " select * from p")
def ml_18(t: Tables) -> DataFrame:
    return rounded(plan_run(t), "edge_weighted_delta", "source_equal_delta")


@query("WIN_08_difference_order", ["cells_r0", "roi"], _PLAN + " select row_id, max_abs_delta, row_number() over (order by max_abs_delta desc nulls last, row_id) as difference_rank from p")
def win_08(t: Tables) -> DataFrame:
    return N.difference_order(plan_run(t)).select("row_id", "max_abs_delta", "difference_rank")


@query("AGG_33_status_summary", ["cells_r0", "roi"], _PLAN + " select status, count(*) as row_count from p group by status")
def agg_33(t: Tables) -> DataFrame:
    return plan_run(t).groupBy("status").agg(F.count("*").alias("row_count"))


@query("JOIN_08_before_after_effects", ["cells_r0", "roi"], f"with {_MEMBERS_SQL},{_VARIANT_SQL},{_grid_sql()} select a.variant, a.scope, a.radius, b.edges as before_edges, a.edges as after_edges from g a join g b on b.state=0 and a.scope=b.scope and a.radius=b.radius where a.state>0")
def join_08(t: Tables) -> DataFrame:
    states = N.variant_states(t.cells, _members(t), VARIANTS)
    out = N.compare_states(N.edge_weighted(N.neighbour_grid(states, 4, [20.0, 35.0], SOURCE, TARGET, scopes=N.SCOPES, roi=t.roi), 0.05))
    names = F.array(*[F.lit(v) for v in VARIANTS])
    return out.select(names[F.col("state") - 1].alias("variant"), "scope", "radius", F.col("before_directed_source_edges").alias("before_edges"), F.col("after_directed_source_edges").alias("after_edges"))


@query("JOIN_09_parameter_grid", ["cells_r0", "roi"], f"with {_MEMBERS_SQL},{_VARIANT_SQL},{_grid_sql()} select state, scope, radius, nodes as node_count, targets as target_count, sources as source_count from g")
def join_09(t: Tables) -> DataFrame:
    states = N.variant_states(t.cells, _members(t), VARIANTS)
    return N.neighbour_grid(states, 4, [20.0, 35.0], SOURCE, TARGET, scopes=N.SCOPES, roi=t.roi).select("state", "scope", "radius", "node_count", "target_count", "source_count")


# --- filters and predicates ---------------------------------------------------------------------

_QUERY = """select c.cell_id, c.x, c.y, c.label, c.included, c.region, coalesce(k.value,0) as marker_count from cells_r2 c left join counts k on k.cell_id=c.cell_id and k.feature_id='Brand#23'
    where c.label in ('MACHINERY','BUILDING') and c.included and c.x between 200 and 520 and c.y between 200 and 480 and coalesce(k.value,0)>=20"""


def _observed(t: Tables) -> DataFrame:
    found = filters.query_observations(t.at("r2"), t.counts, t.features, labels=[TARGET, SOURCE], included=True, bounds=VIEW, gene="Brand#23", min_count=20)
    return found.select("cell_id", "x", "y", "label", "included", "region", "marker_count")


@query("FLT_01_observation_query", ["cells_r2", "counts"], _QUERY)
def flt_01(t: Tables) -> DataFrame:
    return _observed(t)


@query("FLT_02_unmeasured_genes", ["features"], "select g as feature_id, case when f.feature_id is null then 'unmeasured' else 'measured' end as status from (values ('Brand#11'),('Brand#99'),('KDR')) v(g) left join features f on f.feature_id=g")
def flt_02(t: Tables) -> DataFrame:
    wanted = t.features.filter(F.col("feature_id") == "Brand#11").select("feature_id").unionByName(
        t.features.select(F.explode(F.array(F.lit("Brand#99"), F.lit("KDR"))).alias("feature_id"))).distinct()
    on = t.features.select("feature_id", F.lit(True).alias("_on"))
    return wanted.join(on, "feature_id", "left").select("feature_id", F.when(F.col("_on"), "measured").otherwise("unmeasured").alias("status"))


_ATTR = "from cells c join attrs a on a.cell_id=c.cell_id and a.field='qc' where c.included"


@query("FLT_03_attribute_compare", ["cells", "attrs"], f"""select 'ge 3' as test, count(case when kind='num' and num>=3 then 1 end) as matching_count, count(case when kind<>'num' then 1 end) as attribute_unavailable_count {_ATTR}
    union all select 'ne 2', count(case when kind='num' and num<>2 then 1 end), count(case when kind<>'num' then 1 end) {_ATTR}
    union all select 'eq text 2', count(case when kind='str' and str='2' then 1 end), count(case when kind<>'str' then 1 end) {_ATTR}""")
def flt_03(t: Tables) -> DataFrame:
    tests = {"ge 3": ("qc", "ge", 3), "ne 2": ("qc", "ne", 2), "eq text 2": ("qc", "eq", "2")}
    out = None
    for name, attribute in tests.items():
        found = filters.query_observations(t.with_attributes, included=True, attribute=attribute)
        row = filters.unavailable_count(found).withColumn("test", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


CLAUSES = [{"field": "attributes.qc", "op": "in", "value": [0, 1, 2, 3, 4, 5]}, {"field": "counts.Brand#23", "op": "ge", "value": 10},
           {"field": "label", "op": "ne", "value": "FURNITURE"}]
_TRUTH = """t as (select c.cell_id, (case when a.kind='num' then a.num in (0,1,2,3,4,5) end) as t1, coalesce(k.value,0)>=10 as t2, c.label<>'FURNITURE' as t3
    from cells c join attrs a on a.cell_id=c.cell_id and a.field='qc' left join counts k on k.cell_id=c.cell_id and k.feature_id='Brand#23')"""


@query("FLT_04_three_valued_clauses", ["cells", "attrs", "counts"], f"with {_TRUTH} select cell_id, t1, t2, t3 from t")
def flt_04(t: Tables) -> DataFrame:
    cells, columns = filters.attach_counts(t.with_attributes, t.counts, t.features, ["Brand#23"])
    return cells.select("cell_id", *[P.clause(c["field"], c["op"], c["value"], columns).alias(f"t{i}") for i, c in enumerate(CLAUSES, 1)])


@query("FLT_05_selector_resolution", ["cells", "attrs", "counts"], f"with {_TRUTH} select cell_id, case when t1 and t2 and t3 then 'chosen' else 'unknown' end as resolution from t where (t1 and t2 and t3) or (t1 and t2 and t3) is null")
def flt_05(t: Tables) -> DataFrame:
    return filters.resolve_selector(t.with_attributes, CLAUSES, t.counts, t.features)


@query("FLT_06_viewport", ["cells"], "select count(*) as total, case when count(*)<=100000 then 'points' else 'counts_only' end as mode from cells where x between 200 and 520 and y between 200 and 480")
def flt_06(t: Tables) -> DataFrame:
    points, total = filters.viewport(t.atlas.cells, VIEW, 100_000)
    return points.agg(F.lit(total).cast("bigint").alias("total"), F.when(F.count("*") == total, "points").otherwise("counts_only").alias("mode"))


_ASK = ["Brand#11", "feature_id:Brand#12", "symbol:Brand#13", "symbol:Brand#99", "KDR"]


@query("FLT_07_feature_resolution", ["features"], "with q as (select * from (values ('Brand#11','Brand#11'),('feature_id:Brand#12','Brand#12'),('symbol:Brand#13','Brand#13'),('symbol:Brand#99','Brand#99'),('KDR','KDR')) v(query,val))"
       " select q.query, case when f.feature_id is null then 'unmeasured' else 'resolved' end as status, f.feature_id from q left join features f on f.feature_id=q.val")
def flt_07(t: Tables) -> DataFrame:
    asked = t.features.select(F.explode(F.array(*[F.lit(q) for q in _ASK])).alias("query")).distinct()
    return filters.resolve_features(t.features, asked).drop("candidates")


# Part names repeat across parts, so they serve as ambiguous symbols of the part-key features.
def _named_features(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").cast("string").alias("feature_id"), F.concat_ws("/", "p_brand", "p_type").alias("symbol"))


_NAMED = "nf as (select cast(p_partkey as varchar) as feature_id, concat_ws('/',p_brand,p_type) as symbol from part)"


@query("FLT_08_feature_search", (), f"with {_NAMED} select feature_id, symbol, symbol_ambiguous from (select *, count(*) over (partition by symbol) > 1 as symbol_ambiguous from nf) where contains(lower(feature_id),'brand#1') or contains(lower(symbol),'brand#1')")
def flt_08(t: Tables) -> DataFrame:
    return filters.search_features(_named_features(t), "BRAND#1")


@query("AGG_36_duplicate_symbols", (), f"with {_NAMED} select symbol, count(*) as feature_count from nf group by symbol having count(*)>1")
def agg_36(t: Tables) -> DataFrame:
    return filters.ambiguous_symbols(_named_features(t))


@query("WIN_10_symbol_ambiguity", (), f"with {_NAMED} select feature_id, symbol_ambiguous from (select *, count(*) over (partition by symbol) > 1 as symbol_ambiguous from nf)")
def win_10(t: Tables) -> DataFrame:
    return filters.search_features(_named_features(t), "").select("feature_id", "symbol_ambiguous")


@query("FLT_09_polygon_selection", ["roi"], "select cell_id from roi")
def flt_09(t: Tables) -> DataFrame:
    return t.roi


@query("FLT_09_polygon_set", ["cells", "arrow_edges"], """select polygon_id, count(*) as selected, sum(cell_id)::bigint as id_sum from (select polygon_id, cell_id from cells, arrow_edges group by polygon_id, cell_id
    having bool_or(abs((ex-ax)*(y-ay)-(ey-ay)*(x-ax)) <= 1e-10*greatest(1,abs(ex-ax),abs(ey-ay)) and x between least(ax,ex)-1e-7 and greatest(ax,ex)+1e-7 and y between least(ay,ey)-1e-7 and greatest(ay,ey)+1e-7)
    or sum(case when (ay>y)<>(ey>y) and x < (ex-ax)*(y-ay)/(ey-ay)+ax then 1 else 0 end)%2=1) group by 1""")
def flt_09_set(t: Tables) -> DataFrame:
    return polygons.total_many(t.cells, t.arrows, "cell_id").withColumnsRenamed({"n": "selected", "total": "id_sum"})


@query("FLT_10_explicit_ids", ["cells"], """with w as (select distinct o_custkey as cell_id from orders where o_totalprice>200000 union all select o_orderkey+100000000 from orders where o_totalprice>450000)
    select (select count(*) from cells where cell_id in (select cell_id from w)) as selected, (select count(*) from w where cell_id not in (select cell_id from cells)) as unknown_ids""")
def flt_10(t: Tables) -> DataFrame:
    o = t.raw("orders")
    wanted = o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("cell_id")).distinct().unionByName(
        o.filter("o_totalprice > 450000").select((F.col("o_orderkey") + 100000000).alias("cell_id")))
    picked = filters.select_ids(t.cells, wanted).agg(F.count("*").alias("selected")).withColumn("_k", F.lit(1))
    problems = filters.unknown_or_duplicate_ids(t.cells, wanted).agg(F.count_if(F.col("problem") == "unknown").alias("unknown_ids")).withColumn("_k", F.lit(1))
    return picked.join(problems, "_k").drop("_k")


@query("FLT_15_threshold_classes", ["cells_r0", "roi"], f"with {_MEMBERS_SQL},{_VARIANT_SQL},{_grid_sql()} select state, scope, radius, {_CLASS.format(t=0.02)} as classification from g")
def flt_15(t: Tables) -> DataFrame:
    states = N.variant_states(t.cells, _members(t), VARIANTS)
    out = N.edge_weighted(N.neighbour_grid(states, 4, [20.0, 35.0], SOURCE, TARGET, scopes=N.SCOPES, roi=t.roi), 0.02)
    return out.select("state", "scope", "radius", filters.classify_excess(F.col("excess_over_abundance"), 0.02).alias("classification"))


_A, _B = (",".join(f"'{g}'" for g in p) for p in (PROGRAM_A, PROGRAM_B))


@query("FLT_16_marker_programs", ["cells", "counts"], f"""with s as (select c.cell_id, count(case when k.feature_id in ({_A}) and k.value>=30 then 1 end) as support_a, count(case when k.feature_id in ({_B}) and k.value>=30 then 1 end) as support_b
    from cells c left join counts k on k.cell_id=c.cell_id group by c.cell_id)
    select cell_id, support_a, support_b, case when support_a>=3 and support_b>=3 then 'both' when support_a>=3 then 'program_a' when support_b>=3 then 'program_b' else 'neither' end as label from s""")
def flt_16(t: Tables) -> DataFrame:
    return filters.marker_programs(t.cells, t.counts, {"program_a": PROGRAM_A, "program_b": PROGRAM_B}, 30, 3, "both", "neither")


@query("FLT_17_label_status", ["cells"], "select count(case when label='FURNITURE' then 1 end) as unannotated_count, case when count(case when label='FURNITURE' then 1 end)=count(*) then 'unannotated' when count(case when label='FURNITURE' then 1 end)>0 then 'partially_unannotated' else 'provided_working_labels' end as annotation_status from cells")
def flt_17(t: Tables) -> DataFrame:
    return filters.label_status(t.cells.withColumn("label", F.when(F.col("label") == "FURNITURE", "Unannotated").otherwise(F.col("label"))))


@query("FLT_18_semantics", (), """select cast(n_nationkey as varchar) as slice_id, u as observation_unit, case when u='cell' then 'cell_type' else concat(u,'_annotation') end as label_semantics
    from (select n_nationkey, case when n_regionkey=0 then 'spot' when n_regionkey=1 then 'bin' else 'cell' end as u from nation)""")
def flt_18(t: Tables) -> DataFrame:
    unit = F.when(F.col("n_regionkey") == 0, "spot").when(F.col("n_regionkey") == 1, "bin")
    return filters.semantics(t.raw("nation").select(F.col("n_nationkey").cast("string").alias("slice_id"), unit.alias("observation_unit"))).drop("interpretation")


@query("AGG_01_composition", ["cells_r2", "roi"], """with s as (select * from cells_r2 where cell_id in (select cell_id from roi)), n as (select count(*) as total, count(case when included then 1 end) as inc from s)
    select label, count(*) as count, round(count(*)/any_value(inc)::double,8) as fraction, any_value(inc) as selected_included, any_value(total-inc) as selected_excluded, any_value(total) as selected_total from s, n where included group by label""")
def agg_01(t: Tables) -> DataFrame:
    return rounded(filters.compose(t.at("r2"), t.roi), "fraction")


# --- revisions ------------------------------------------------------------------------------------

@query("REV_01_materialise", ["cells_r2"], "select cell_id, x, y, label, included, region from cells_r2")
def rev_01(t: Tables) -> DataFrame:
    return t.at("r2").select("cell_id", "x", "y", "label", "included", "region")


@query("JOIN_05_overlay_join", ["cells_r1"], "select cell_id, label, included from cells_r1")
def join_05(t: Tables) -> DataFrame:
    return t.at("r1").select("cell_id", "label", "included")


def _proposal(t: Tables) -> DataFrame:
    return R.propose(t.at("r1"), t.roi, {"label": "HOUSEHOLD", "included": True})


_PROPOSE = """p as (select cell_id, case when label<>'HOUSEHOLD' then label end as label_before, case when label<>'HOUSEHOLD' then 'HOUSEHOLD' end as label_after,
    case when not included then included end as included_before, case when not included then true end as included_after
    from cells_r1 where cell_id in (select cell_id from roi) and (label<>'HOUSEHOLD' or not included))"""


@query("REV_02_propose_delta", ["cells_r1", "roi"], f"with {_PROPOSE} select * from p")
def rev_02(t: Tables) -> DataFrame:
    return _proposal(t)


@query("REV_03_apply_delta", ["cells_r1", "roi", "overlays"], f"with {_PROPOSE}, o as (select * from overlays where revision_id='r1') select coalesce(o.cell_id,p.cell_id) as cell_id, 'r3' as revision_id, coalesce(p.label_after,o.label) as label, coalesce(p.included_after,o.included) as included from o full join p on o.cell_id=p.cell_id")
def rev_03(t: Tables) -> DataFrame:
    return R.apply_delta(t.overlays, "r1", _proposal(t), "r3")


@query("REV_04_revert", ["overlays"], "select 'r4' as revision_id, cell_id, label, included from overlays where revision_id='r1'")
def rev_04(t: Tables) -> DataFrame:
    return R.revert(t.overlays, "r1", "r4")


@query("REV_05_revision_diff", ["cells_r0", "cells_r2", "roi"], "with " + _COMPARE[_COMPARE.index("ch as ("):_COMPARE.index("\nselect round(bb.obs")] + " select * from ch")
def rev_05(t: Tables) -> DataFrame:
    return R.diff_counts(t.cells, t.at("r2"), t.roi)


@query("ORD_04_changed_examples", ["cells_r0", "cells_r2", "roi"], """select o.cell_id, r.cell_id is not null as in_selection, case when o.label<>n.label then o.label end as label_before, case when o.label<>n.label then n.label end as label_after,
    case when o.included<>n.included then cast(o.included as varchar) end as included_before, case when o.included<>n.included then cast(n.included as varchar) end as included_after, cast(null as varchar) as region_before, cast(null as varchar) as region_after
    from cells_r0 o join cells_r2 n on n.cell_id=o.cell_id left join roi r on r.cell_id=o.cell_id where o.label<>n.label or o.included<>n.included order by o.cell_id limit 100""")
def ord_04(t: Tables) -> DataFrame:
    return R.diff_preview(t.cells, t.at("r2"), t.roi, 100)


@query("REV_06_stale_results", (), "select o_orderkey as run_id, o_orderpriority as target_revision, o_orderpriority<>'1-URGENT' as stale from orders")
def rev_06(t: Tables) -> DataFrame:
    runs = t.raw("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("target_revision"))
    return R.stale_runs(runs, "1-URGENT")


@query("REV_08_fixed_model_filter", ["cells_r2", "cells_r0"], "select c.cell_id, c.label as domain from cells_r0 c where c.included and c.cell_id in (select cell_id from cells_r2 where included)")
def rev_08(t: Tables) -> DataFrame:
    parent = t.cells.filter("included").select("cell_id", F.col("label").alias("domain"))
    return R.fixed_model_filter(parent, t.at("r2"))


@query("REV_09_applicability", ["cells_r2", "cells_r0"], """select (select count(*) from cells_r0 where included and cell_id not in (select cell_id from cells_r2 where included)) as fit_not_active,
    (select count(*) from cells_r2 where included and cell_id not in (select cell_id from cells_r0 where included)) as active_not_fit, true as annotation_changed_since_fit,
    (select count(*) from cells_r0 o join cells_r2 n using (cell_id) where o.included<>n.included)>0 as fit_population_changed, (select count(*) from cells_r0 o join cells_r2 n using (cell_id) where o.included<>n.included)>0 as refit_required""")
def rev_09(t: Tables) -> DataFrame:
    return R.applicability(t.at("r2"), t.cells.filter("included").select("cell_id"), True, False, "r0", "r2")


# --- sets, membership, order ------------------------------------------------------------------------

@query("JOIN_06_roi_membership", ["cells", "roi"], "select label, count(case when r.cell_id is not null then 1 end) as inside, count(case when r.cell_id is null then 1 end) as outside from cells c left join roi r on r.cell_id=c.cell_id group by label")
def join_06(t: Tables) -> DataFrame:
    return N.with_membership(t.cells, t.roi, "in_roi").groupBy("label").agg(F.count_if("in_roi").alias("inside"), F.count_if(~F.col("in_roi")).alias("outside"))


@query("SET_01_complement", ["cells", "roi"], "select cell_id from cells except select cell_id from roi")
def set_01(t: Tables) -> DataFrame:
    return t.cells.select("cell_id").join(t.roi, "cell_id", "left_anti")


@query("SET_02_disjointness", ["cells", "roi"], "select count(*) as overlap_count from (select cell_id from roi intersect select cell_id from cells where region='n7')")
def set_02(t: Tables) -> DataFrame:
    from ..operators.expression import overlap_count
    return overlap_count(t.roi, t.cells.filter("region = 'n7'"))


@query("SET_05_unknown_ids", ["cells"], "select distinct o_custkey*2 as cell_id from orders except select cell_id from cells")
def set_05(t: Tables) -> DataFrame:
    wanted = t.raw("orders").select((F.col("o_custkey") * 2).alias("cell_id"))
    return filters.unknown_or_duplicate_ids(t.cells, wanted.distinct()).select("cell_id")


@query("ORD_01_keyset_page", ["cells_r2", "counts"], f"""select *, sha256('{{"filters":"observed","revision":"r2","source":"cells"}}') as binding from ({_QUERY}) q where cell_id>200 order by cell_id limit 50""")
def ord_01(t: Tables) -> DataFrame:
    bound = {"revision": "r2", "source": "cells", "filters": "observed"}
    return filters.bound_page(_observed(t), {"after": 200, "binding": filters.page_binding(**bound)}, 50, **bound)


@query("ORD_02_offset_page", ["cells"], "select cell_id, label, qc_balance from cells order by qc_balance desc, cell_id limit 40 offset 60")
def ord_02(t: Tables) -> DataFrame:
    return filters.offset_page(t.cells.select("cell_id", "label", "qc_balance"), [F.desc("qc_balance"), F.asc("cell_id")], 60, 40)


@query("AGG_34_overview", ["cells", "features", "overlays"], "select (select count(*) from cells) as cell_count, (select count(*) from features) as feature_count, (select count(distinct revision_id) from overlays) as revision_count, (select count(*) from overlays) as overlay_rows")
def agg_34(t: Tables) -> DataFrame:
    one = lambda df: df.withColumn("_k", F.lit(1))
    return (one(t.cells.agg(F.count("*").alias("cell_count"))).join(one(t.features.agg(F.count("*").alias("feature_count"))), "_k")
            .join(one(t.overlays.agg(F.count_distinct("revision_id").alias("revision_count"), F.count("*").alias("overlay_rows"))), "_k").drop("_k"))


@query("UDF_02_predicates_as_data", ["cells", "attrs", "counts"], f"with {_TRUTH} select count(case when t1 and t2 and t3 then 1 end) as chosen, count(case when (t1 and t2 and t3) is null then 1 end) as unknown from t")
def udf_02(t: Tables) -> DataFrame:
    resolved = filters.resolve_selector(t.with_attributes, CLAUSES, t.counts, t.features)
    return resolved.agg(F.count_if(F.col("resolution") == "chosen").alias("chosen"), F.count_if(F.col("resolution") == "unknown").alias("unknown"))
