"""Counts, quality, proteins and molecules."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import ids, numeric
from ..operators import atlas, expression as E, filters, protein as PR, quadtree, quality, ranking, spatial, validate
from ..session import materialise
from .annotation import rounded
from .registry import query
from .tables import FIELDS, GENES, VIEW, WINDOW, Tables, scratch

_G = ",".join(f"'{g}'" for g in GENES)



def channels(t: Tables) -> list[str]:
    """All protein channels by name (the declared panel)."""
    return [r[0] for r in t.raw("part").select("p_type").distinct().orderBy("p_type").collect()]


_CH = "(select distinct p_type from part)"


@query("FLT_11_display_transform", ["protein"], f"""select cell_id, feature_id, round(ln(1+value),8) as log1p_value, round(asinh(value/5.0::double),8) as asinh_value from protein where feature_id in {_CH}""")
def flt_11(t: Tables) -> DataFrame:
    v = F.col("value")
    out = t.protein.filter(F.col("feature_id").isin(*channels(t))).select(
        "cell_id", "feature_id", numeric.display_transform(v, "log1p").alias("log1p_value"), numeric.display_transform(v, "asinh", 5.0).alias("asinh_value"))
    return rounded(out, "log1p_value", "asinh_value")


@query("FLT_12_library_normalisation", ["norm"], "select cell_id, feature_id, round(value,8) as value from norm")
def flt_12(t: Tables) -> DataFrame:
    return rounded(E.normalise(t.counts, t.cells.filter("included")), "value")


@query("FN_03_elementary_functions", ["counts"], "select cell_id, feature_id, round(ln(1+value),8) as l, round(asinh(value),8) as a, round(exp(-value/100),8) as e, round(sqrt(value),8) as s, floor(value/7)::bigint as f, least(value,50)::double as lo, greatest(value,50)::double as hi from counts")
def fn_03(t: Tables) -> DataFrame:
    v = F.col("value")
    return rounded(t.counts.select("cell_id", "feature_id", F.log1p(v).alias("l"), F.asinh(v).alias("a"), F.exp(-v / 100).alias("e"), F.sqrt(v).alias("s"),
                                   F.floor(v / 7).alias("f"), F.least(v, F.lit(50.0)).alias("lo"), F.greatest(v, F.lit(50.0)).alias("hi")), "l", "a", "e", "s")


@query("FN_01_qualified_ids", (), "select o_orderkey as k, concat('sample:', replace(replace(replace(replace(o_orderstatus,'%','%25'),' ','%20'),'#','%23'),'*','%2A'), '::cell:', replace(replace(replace(replace(o_orderpriority,'%','%25'),' ','%20'),'#','%23'),'*','%2A')) as qualified from orders")
def fn_01(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), ids.qualified_observation_id(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("qualified"))


@query("FN_02_field_cell_ids", (), "select p_partkey as k, concat('fov=', replace(replace(p_brand,'#','%23'),' ','%20'), ';cell=', replace(replace(p_type,'#','%23'),' ','%20')) as composite from part")
def fn_02(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("k"), ids.fov_cell_id(F.col("p_brand"), F.col("p_type")).alias("composite"))


@query("FN_11_content_digest", ["cells"], "select cell_id, sha256(concat('{\"cell_id\":',cast(cell_id as varchar),',\"label\":\"',label,'\",\"region\":\"',region,'\"}')) as digest from cells")
def fn_11(t: Tables) -> DataFrame:
    return t.cells.select("cell_id", ids.row_digest("region", "label", "cell_id").alias("digest"))


@query("FN_12_missing_text", (), "select doc_id, case when lower(trim(source)) in ('','nan','na','null','none') then null else source end as source from (select doc_id, case when doc_id%7=0 then 'NaN' when doc_id%7=1 then ' none ' when doc_id%7=2 then '' else source end as source from documents)")
def fn_12(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 7
    text = F.when(k == 0, "NaN").when(k == 1, " none ").when(k == 2, "").otherwise(F.col("source"))
    return t.raw("documents").select("doc_id", ids.missing_text_to_null(text).alias("source"))


@query("FN_13_exact_counts", (), """select l_orderkey, l_linenumber, l_partkey, case when k=0 then null when k=1 then null when k=2 then null else l_quantity end as value
    from (select *, l_partkey%5 as k from lineitem)""")
def fn_13(t: Tables) -> DataFrame:
    k, q = F.col("l_partkey") % 5, F.col("l_quantity")
    whole = q.cast("bigint").cast("string")
    text = F.when(k == 0, F.concat(whole, F.lit(".5"))).when(k == 1, F.concat(F.lit("-"), whole)).when(k == 2, F.concat(whole, F.lit("x"))).when(k == 3, F.concat(whole, F.lit(".000"))).otherwise(whole)
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ids.exact_count(text).alias("value"))


@query("FN_14_contains_ignore_case", (), "select part.p_partkey from part where contains(lower(p_type),'small')")
def fn_14(t: Tables) -> DataFrame:
    return t.raw("part").filter(F.contains(F.lower("p_type"), F.lower(F.lit("SMALL")))).select("p_partkey")


@query("FN_04_distances", ["knn6"], "select src, dst, round(dist,8) as dist from knn6")
def fn_04(t: Tables) -> DataFrame:
    from ..operators.spatial import knn
    return rounded(knn(live_cells(t), 6).drop("rank"), "dist")


def live_cells(t: Tables) -> DataFrame:
    """Included cells with a non-zero library: the input contract of the statistics.

    Statistics read these cells and the counts many times, so both are written once per query. Cells may share a position.
    """
    if t.live is not None:
        return t.live
    t.counts = materialise(t.counts)
    libs = t.counts.groupBy("cell_id").agg(F.sum("value").alias("library")).filter("library > 0").select("cell_id")
    t.live = materialise(t.cells.filter("included").join(libs, "cell_id", "left_semi"))
    validate.require_none(t.live.groupBy("cell_id").count().filter("count > 1"), "statistics need distinct cells")
    return t.live


# --- expression -------------------------------------------------------------------------------------

@query("AGG_07_selection_expression", ["cells", "roi", "counts", "features"], f"""with n as (select count(*) as n from roi), k as (select feature_id, sum(value) as s, count(case when value>0 then 1 end) as nz from counts where cell_id in (select cell_id from roi) group by 1)
    select g as feature_id, case when f.feature_id is null then 'unmeasured' else 'measured' end as status, case when f.feature_id is not null then round(coalesce(s,0)/n,8) end as mean, case when f.feature_id is not null then coalesce(s,0) end as sum,
    case when f.feature_id is not null then coalesce(nz,0) end as nonzero_cells, case when f.feature_id is not null then n-coalesce(nz,0) end as zero_cells, n as cell_count
    from (values ('Brand#11'),('Brand#23'),('Brand#99')) v(g) left join features f on f.feature_id=g left join k on k.feature_id=g, n
    union all select 'Double', 'ambiguous', null, null, null, null, n from n""")
def agg_07(t: Tables) -> DataFrame:
    chosen = t.cells.join(t.roi, "cell_id", "left_semi")
    doubled = t.features.filter("feature_id in ('Brand#12', 'Brand#13')").withColumn("symbol", F.lit("Double"))
    panel = t.features.filter("feature_id not in ('Brand#12', 'Brand#13')").unionByName(doubled)
    return rounded(E.panel_summary(chosen, t.counts, panel, ["Brand#11", "Brand#23", "Brand#99", "Double"]), "mean")




@query("AGG_08_region_summary", ["cells_r2", "counts", "libs", "features"], f"""with a as (select c.cell_id, c.region, l.library from cells_r2 c join libs l using (cell_id) where c.included),
    d as (select region, count(*) as n, count(case when library>0 then 1 end) as m from a group by region),
    s as (select a.region, k.feature_id, sum(k.value) as s, count(*) as nz, sum(k.value/a.library*10000) as p from a join counts k using (cell_id) where k.feature_id in ({_G}) and k.value>0 group by 1,2)
    select d.region, g as feature_id, case when f.feature_id is null then 'unmeasured' else 'measured' end as status, n as included_count, m as normalized_denominator, n-m as zero_library_observations,
    case when f.feature_id is not null then round(coalesce(s,0)/n,8) end as mean_raw_count, case when f.feature_id is not null then round(coalesce(nz,0)/n::double,8) end as detection_fraction,
    case when f.feature_id is not null and m>0 then round(coalesce(p,0)/m,6) end as mean_panel_counts_per_10000 from d cross join (select unnest([{_G}]) as g) left join features f on f.feature_id=g left join s on s.region=d.region and s.feature_id=g""")
def agg_08(t: Tables) -> DataFrame:
    out = E.region_summary(t.at("r2"), t.counts, t.features, GENES)
    return rounded(rounded(out, "mean_raw_count", "detection_fraction"), "mean_panel_counts_per_10000", digits=6)


def _label_contrasts(t: Tables) -> DataFrame:
    before, after = (E.label_contrast(E.tag_regions(t.at(r), t.roi)) for r in (None, "r2"))
    return E.before_after(before, after, ["label"])


def _lc_sql(cells: str) -> str:
    return f"""select label, sum(case when r.cell_id is not null then 1 else 0 end)/any_value(nf)::double - sum(case when r.cell_id is null then 1 else 0 end)/any_value(nb)::double as d
    from {cells} c left join roi r on r.cell_id=c.cell_id, (select count(case when r.cell_id is not null then 1 end) as nf, count(case when r.cell_id is null then 1 end) as nb from {cells} c left join roi r on r.cell_id=c.cell_id where included) n where included group by label"""


@query("AGG_09_region_contrast", ["cells_r0", "cells_r2", "roi"], f"with b as ({_lc_sql('cells_r0')}), a as ({_lc_sql('cells_r2')}) select coalesce(a.label,b.label) as label, round(b.d,8) as before_difference, round(a.d,8) as after_difference, round(coalesce(a.d,0)-coalesce(b.d,0),8) as difference_delta from b full join a on a.label=b.label")
def agg_09(t: Tables) -> DataFrame:
    return rounded(_label_contrasts(t), "before_difference", "after_difference", "difference_delta")


@query("AGG_09_marker_contrast", ["cells_r2", "roi", "counts", "libs", "features"], f"""with a as (select c.cell_id, case when r.cell_id is null then 'background' else 'foreground' end as side, l.library from cells_r2 c join libs l using (cell_id) left join roi r on r.cell_id=c.cell_id where c.included),
    d as (select side, count(*) as n, count(case when library>0 then 1 end) as m from a group by side),
    s as (select a.side, k.feature_id, sum(k.value) as s, count(*) as nz, sum(k.value/a.library*10000) as p from a join counts k using (cell_id) where k.feature_id in ({_G}) and k.value>0 group by 1,2),
    f as (select d.side, g as feature_id, case when t.feature_id is not null then coalesce(s,0)/n end as v1, case when t.feature_id is not null then coalesce(nz,0)/n::double end as v2, case when t.feature_id is not null then coalesce(p,0)/m end as v3
        from d cross join (select unnest([{_G}]) as g) left join features t on t.feature_id=g left join s on s.side=d.side and s.feature_id=g),
    u as (select side, feature_id, 'mean_raw_count' as measure, v1 as v from f union all select side, feature_id, 'detection_fraction', v2 from f union all select side, feature_id, 'mean_panel_counts_per_10000', v3 from f)
    select feature_id, measure, round(max(case when side='foreground' then v end),6) as foreground, round(max(case when side='background' then v end),6) as background,
    round(max(case when side='foreground' then v end)-max(case when side='background' then v end),6) as difference from u group by 1,2""")
def agg_09_markers(t: Tables) -> DataFrame:
    return rounded(E.marker_contrast(E.tag_regions(t.at("r2"), t.roi), t.counts, t.features, GENES), "foreground", "background", "difference", digits=6)


@query("AGG_10_quality_fields", ["attrs"], """select field, count(*) as observation_count, count(case when kind='num' and num>=0 then 1 end) as valid_count, count(case when kind='absent' then 1 end) as absent_count, count(case when kind='null' then 1 end) as null_count,
    count(case when kind in ('str','bool') then 1 end) as invalid_type_count, count(case when kind='num' and num<0 then 1 end) as invalid_range_count, count(case when kind in ('absent','null') then 1 end) as missing_count,
    case when count(case when kind='num' and num>=0 then 1 end)>0 then count(case when kind='num' and num=0 then 1 end) end as zero_count,
    min(case when kind='num' and num>=0 then num end) as min, max(case when kind='num' and num>=0 then num end) as max, round(avg(case when kind='num' and num>=0 then num end),6) as mean,
    round(quantile_cont(case when kind='num' and num>=0 then num end,0.25),6) as q25, round(quantile_cont(case when kind='num' and num>=0 then num end,0.5),6) as median, round(quantile_cont(case when kind='num' and num>=0 then num end,0.75),6) as q75,
    case when count(case when kind='num' and num>=0 then 1 end)>0 then 'available' when count(case when kind in ('str','bool') or num<0 then 1 end)>0 then 'unavailable' else 'not_recorded' end as status
    from attrs where field<>'segmentation_method' group by field""")
def agg_10(t: Tables) -> DataFrame:
    return rounded(quality.numeric_fields(t.with_attributes, FIELDS), "mean", "q25", "median", "q75", digits=6)


@query("AGG_11_category_top20", ["attrs"], """with c as (select str as value, count(*) as count from attrs where field='segmentation_method' and kind='str' and trim(str)<>'' group by 1),
    r as (select *, row_number() over (order by count desc, value) as rank, count(*) over () as category_count, sum(count) over () as total from c)
    select value, count, rank, category_count, greatest(0,category_count-20) as omitted_category_count, total-sum(count) over () as omitted_observation_count from r where rank<=20""")
def agg_11(t: Tables) -> DataFrame:
    return quality.category_table(t.with_attributes, "segmentation_method", 20)


@query("AGG_12_library_quality", ["libs"], """select field, count(*) as observation_count, count(case when value=0 then 1 end) as zero_count, min(value) as min, max(value) as max, round(avg(value),6) as mean,
    quantile_cont(value,0.25) as q25, quantile_cont(value,0.5) as median, quantile_cont(value,0.75) as q75 from (select 'library' as field, library as value from libs union all select 'detected', detected::double from libs) group by field""")
def agg_12(t: Tables) -> DataFrame:
    return rounded(quality.expression_quality(E.libraries(t.cells, t.counts)), "mean", digits=6)


@query("AGG_12_zero_library", ["libs"], "select cell_id from libs where library=0")
def agg_12_zero(t: Tables) -> DataFrame:
    return E.zero_library(t.cells, t.counts)


@query("AGG_12_zero_examples", ["libs"], "select coalesce((select list(cell_id order by cell_id) from (select cell_id from libs where library=0 order by cell_id limit 100)), []) as examples, greatest(0, count(*)-100) as omitted from libs where library=0")
def agg_12_examples(t: Tables) -> DataFrame:
    return filters.examples(E.zero_library(t.cells, t.counts), "cell_id", 100)


# --- proteins -----------------------------------------------------------------------------------------

_PV = f"pv as (select c.cell_id, c.label, c.region, f.p_type as feature_id, p.value from cells_r2 c cross join {_CH} f left join protein p on p.cell_id=c.cell_id and p.feature_id=f.p_type where c.included)"


@query("AGG_13_protein_channels", ["cells_r2", "protein"], f"""with {_PV} select feature_id, count(*) as included_count, count(value) as measured_count, count(case when value=0 then 1 end) as zero_count, round(avg(value),4) as mean_raw,
    round(avg(asinh(value/5.0::double)),8) as mean_transformed, round(median(value),4) as median_raw, count(*)-count(value) as missing_count from pv group by feature_id""")
def agg_13(t: Tables) -> DataFrame:
    return rounded(rounded(PR.channel_summary(t.at("r2"), t.protein, channels(t), "asinh"), "mean_transformed"), "mean_raw", "median_raw", digits=4)


@query("AGG_13_channel_labels", ["cells_r2"], "select label, count(*) as count from cells_r2 where included group by 1")
def agg_13_labels(t: Tables) -> DataFrame:
    return PR.channel_labels(t.at("r2"))


def _protein_contrast(t: Tables, revision: str | None) -> DataFrame:
    return PR.region_contrast(E.tag_regions(t.at(revision), t.roi), t.protein, channels(t), "log1p")


def _pc_sql(cells: str) -> str:
    return f"""select f.p_type as feature_id, avg(case when r.cell_id is not null then ln(1+p.value) end) as fg, avg(case when r.cell_id is null then ln(1+p.value) end) as bg
    from {cells} c cross join {_CH} f left join protein p on p.cell_id=c.cell_id and p.feature_id=f.p_type left join roi r on r.cell_id=c.cell_id where c.included group by 1"""


@query("AGG_14_protein_contrast", ["cells_r0", "cells_r2", "roi", "protein"], f"with b as ({_pc_sql('cells_r0')}), a as ({_pc_sql('cells_r2')}) select feature_id, round(b.fg-b.bg,8) as before_difference, round(a.fg-a.bg,8) as after_difference, round((a.fg-a.bg)-(b.fg-b.bg),8) as difference_delta from b join a using (feature_id)")
def agg_14(t: Tables) -> DataFrame:
    return rounded(E.before_after(_protein_contrast(t, None), _protein_contrast(t, "r2"), ["feature_id"]), "before_difference", "after_difference", "difference_delta")


_PAIRS = f"""pr as (select p.cell_id, p.feature_id, p.value as protein_value, coalesce(k.value,0) as rna_raw, case when l.library>0 then coalesce(k.value,0)/l.library*10000 end as rna_per_10k
    from protein p join cells_r2 c on c.cell_id=p.cell_id and c.included join libs l on l.cell_id=p.cell_id left join counts k on k.cell_id=p.cell_id and k.feature_id='Brand#23' where p.feature_id in {_CH})"""


@query("JOIN_07_rna_protein_pairs", ["cells_r2", "protein", "counts", "libs"], f"with {_PAIRS} select cell_id, feature_id, round(protein_value,4) as protein_value, rna_raw, round(rna_per_10k,6) as rna_per_10k from pr")
def join_07(t: Tables) -> DataFrame:
    out = PR.rna_protein_pairs(t.at("r2"), t.counts, t.protein, "Brand#23", channels(t))
    return rounded(rounded(out, "rna_per_10k", digits=6), "protein_value", digits=4)


_RANKED = """u as (select feature_id, 'raw' as measure, cell_id, rna_raw as a, protein_value as b from pr union all select feature_id, 'per_10k', cell_id, rna_per_10k, protein_value from pr where rna_per_10k is not null),
    rk as (select *, rank() over (partition by feature_id, measure order by a) + (count(*) over (partition by feature_id, measure, a) - 1)/2.0::double as ra,
        rank() over (partition by feature_id, measure order by b) + (count(*) over (partition by feature_id, measure, b) - 1)/2.0::double as rb from u)"""


@query("AGG_15_spearman", ["cells_r2", "protein", "counts", "libs"], f"with {_PAIRS}, {_RANKED} select feature_id, measure, count(*) as n, case when count(*)>=3 and min(a)<max(a) and min(b)<max(b) then round(corr(ra,rb),8) end as rho, case when count(*)>=3 and min(a)<max(a) and min(b)<max(b) then 'descriptive' else 'unknown' end as status from rk group by 1,2")
def agg_15(t: Tables) -> DataFrame:
    return rounded(PR.rna_protein_correlation(PR.rna_protein_pairs(t.at("r2"), t.counts, t.protein, "Brand#23", channels(t))), "rho")


@query("WIN_05_average_ranks", ["cells_r2", "protein", "counts", "libs"], f"with {_PAIRS}, {_RANKED} select cell_id, feature_id, ra as rank from rk where measure='raw'")
def win_05(t: Tables) -> DataFrame:
    pairs = PR.rna_protein_pairs(t.at("r2"), t.counts, t.protein, "Brand#23", channels(t))
    return ranking.average_ranks(pairs, ["feature_id"], "rna_raw", "rank").select("cell_id", "feature_id", "rank")


# --- features -------------------------------------------------------------------------------------------

_VAR = "v as (select feature_id, sum(value*value)/n - (sum(value)/n)*(sum(value)/n) as variance from norm, (select count(*)::double as n from live) group by feature_id, n)"


@query("AGG_24_variable_features", ["norm", "live"], f"with {_VAR} select feature_id, round(variance,8) as variance from v order by v.variance desc, feature_id limit 10")
def agg_24(t: Tables) -> DataFrame:
    cells = live_cells(t)
    return rounded(E.top_features(E.feature_variance(E.normalise(t.counts, cells), cells.count()), "variance", 10), "variance")


@query("AGG_25_raw_variance", ["cells", "counts"], "select feature_id, round(sum(value*value)/n - (sum(value)/n)*(sum(value)/n),4) as variance from counts join (select cell_id from cells where included) using (cell_id), (select count(*)::double as n from cells where included) group by feature_id, n")
def agg_25(t: Tables) -> DataFrame:
    active = t.cells.filter("included")
    chosen = t.counts.join(active.select("cell_id"), "cell_id", "left_semi")
    return rounded(E.top_features(E.feature_variance(chosen, active.count()), "variance", 128), "variance", digits=4)


@query("ORD_05_top_features", ["norm"], "select feature_id, round(sum(value),6) as total from norm group by 1 order by sum(value) desc, feature_id limit 5")
def ord_05(t: Tables) -> DataFrame:
    return rounded(E.top_features(E.normalise(t.counts, t.cells.filter("included")).groupBy("feature_id").agg(F.sum("value").alias("total")), "total", 5), "total", digits=6)


def _panels(t: Tables) -> list[DataFrame]:
    counts = t.counts.join(t.cells.select("cell_id", "region"), "cell_id")
    return [counts.filter((F.col("region") == r) & (F.col("value") > low)).select("feature_id").distinct() for r, low in (("n1", 60), ("n2", 60), ("n3", 60))]


@query("SET_04_shared_features", ["cells", "counts"], " intersect ".join(f"select feature_id from counts join cells using (cell_id) where region='{r}' and value>60" for r in ("n1", "n2", "n3")))
def set_04(t: Tables) -> DataFrame:
    return E.shared_features(_panels(t))


@query("JOIN_12_shared_axis_counts", ["cells", "counts"], "with s as (" + " intersect ".join(f"select feature_id from counts join cells using (cell_id) where region='{r}' and value>60" for r in ("n1", "n2", "n3")) + ") select feature_id, count(*) as entries, sum(value) as total from counts where feature_id in (select feature_id from s) group by 1")
def join_12(t: Tables) -> DataFrame:
    kept = t.counts.join(E.shared_features(_panels(t)), "feature_id", "left_semi")
    return kept.groupBy("feature_id").agg(F.count("*").alias("entries"), F.sum("value").alias("total"))


@query("SET_07_stack_samples", ["cells", "counts"], "select case when region in ('n1','n2') then 's1' else 's2' end as sample_id, count(*) as entries, sum(value) as total from counts join cells using (cell_id) where region in ('n1','n2','n3') group by 1")
def set_07(t: Tables) -> DataFrame:
    counts = t.counts.join(t.cells.select("cell_id", "region"), "cell_id")
    s1 = counts.filter(F.col("region").isin("n1", "n2")).withColumn("sample_id", F.lit("s1"))
    s2 = counts.filter(F.col("region") == "n3").withColumn("sample_id", F.lit("s2"))
    return s1.unionByName(s2).groupBy("sample_id").agg(F.count("*").alias("entries"), F.sum("value").alias("total"))


# --- atlas --------------------------------------------------------------------------------------------------

_EXT = """ext as (select least(c.x0,m.x0) as x0, least(c.y0,m.y0) as y0, greatest(c.x1,m.x1) as x1, greatest(c.y1,m.y1) as y1 from
    (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from vertices) c, (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from transcripts) m)"""


@query("AGG_35_atlas_extent", ["vertices", "transcripts"], f"with {_EXT} select round(x0,6) as x0, round(y0,6) as y0, round(x1,6) as x1, round(y1,6) as y1 from ext")
def agg_35(t: Tables) -> DataFrame:
    return rounded(atlas.extent(t.cells, t.transcripts, t.vertices), "x0", "y0", "x1", "y1", digits=6)


def _bin_sql(level: str, table: str) -> str:
    x0, y0, x1, y1 = WINDOW
    return f"""select {level} as level, least({level}-1, trunc((x-({x0}))/{x1 - x0}::double*{level}))::bigint as gx, least({level}-1, trunc((y-({y0}))/{y1 - y0}::double*{level}))::bigint as gy, count(*) as n from {table} group by 1,2,3"""


@query("AGG_18_density_pyramid", ["cells"], " union all ".join(_bin_sql(str(v), "cells") for v in atlas.LEVELS))
def agg_18(t: Tables) -> DataFrame:
    return t.atlas.pyramid


@query("AGG_18_transcript_pyramid", ["transcripts"], " union all ".join(_bin_sql(str(v), "transcripts") for v in atlas.LEVELS))
def agg_18_transcripts(t: Tables) -> DataFrame:
    return t.atlas.molecule_pyramid


_X0, _Y0, _X1, _Y1 = VIEW
_DX, _DY = (_X1 - _X0) / 32, (_Y1 - _Y0) / 32


@query("AGG_19_viewport_density", ["transcripts"], f"""select *, {_X0}::double+gx*{_DX}::double as x, {_Y0}::double+gy*{_DY}::double as y, {_DX}::double as width, {_DY}::double as height from (
    select least(31, trunc((x-{_X0}::double)/{_DX}::double))::bigint as gx, least(31, trunc((y-{_Y0}::double)/{_DY}::double))::bigint as gy, count(*) as count from transcripts where x between {_X0} and {_X1} and y between {_Y0} and {_Y1} group by 1,2)""")
def agg_19(t: Tables) -> DataFrame:
    return atlas.stored_grid(t.atlas.molecule_tree, VIEW, 32)


# Viewports of every shape: inside, across a border, beyond it, thin, and one of bins finer than tiles.
VIEWS = [VIEW, WINDOW, (-50.0, -50.0, 1100.0, 1100.0), (0.0, 0.0, 100.0, 996.0), (500.25, 100.75, 501.5, 900.0), (300.0, 300.0, 301.0, 301.0),
         (900.0, 900.0, 2000.0, 2000.0), (-10.0, 400.0, 333.3, 401.0), (123.4, 567.8, 890.1, 901.2), (5000.0, 5000.0, 6000.0, 6000.0)]
_VIEWS_SQL = "(values " + ", ".join(f"({i},{','.join(f'{c}::double' for c in v)})" for i, v in enumerate(VIEWS)) + ") v(view,x0,y0,x1,y1)"


@query("AGG_19_ten_viewports", ["transcripts"], f"""select view, feature, gx, gy, count(*) as n from (
    select view, f.feature, least(15, trunc((x-x0)/((x1-x0)/16)))::bigint as gx, least(15, trunc((y-y0)/((y1-y0)/16)))::bigint as gy
    from transcripts t join {_VIEWS_SQL} on x between x0 and x1 and y between y0 and y1
    join (values ('any'),('Brand#23')) f(feature) on f.feature in ('any', t.feature)) group by 1,2,3,4""")
def agg_19_views(t: Tables) -> DataFrame:
    trees = {"any": t.atlas.molecule_tree, "Brand#23": t.atlas.feature_tree.of(F.col("feature") == "Brand#23")}
    grids = [quadtree.density(tree, bounds, 16).select(F.lit(i).alias("view"), F.lit(name).alias("feature"), "gx", "gy", "n")
             for name, tree in trees.items() for i, bounds in enumerate(VIEWS)]
    return reduce(DataFrame.unionByName, grids)


@query("AGG_20_viewport_totals", ["cells", "transcripts", "vertices"], f"""with boxes as (select count(*) as vertex_count, min(x) as minx, max(x) as maxx, min(y) as miny, max(y) as maxy from vertices group by boundary_id),
    many as (select view, 'cells' as layer, 0 as vertices from cells join {_VIEWS_SQL} on x between x0 and x1 and y between y0 and y1
    union all select view, 'transcripts', 0 from transcripts join {_VIEWS_SQL} on x between x0 and x1 and y between y0 and y1
    union all select view, 'boundaries', vertex_count from boxes join {_VIEWS_SQL} on maxx>=x0 and minx<=x1 and maxy>=y0 and miny<=y1),
    axes as (select view, layer from {_VIEWS_SQL}, (values ('cells'),('transcripts'),('boundaries')) l(layer))
    select view, layer, count(vertices) as n, coalesce(sum(vertices),0)::bigint as vertices from axes left join many using (view, layer) group by 1,2""")
def agg_20_totals(t: Tables) -> DataFrame:
    layers = {"cells": t.atlas.cell_tree, "transcripts": t.atlas.molecule_tree, "boundaries": t.atlas.boundary_tree}
    rows = [quadtree.total(tree, bounds).select(F.lit(i).alias("view"), F.lit(name).alias("layer"), "n",
                                                (F.col("vertex_count") if tree.weights else F.lit(0)).cast("bigint").alias("vertices"))
            for name, tree in layers.items() for i, bounds in enumerate(VIEWS)]
    return reduce(DataFrame.unionByName, rows)


_IN_VIEW = f"x between {_X0} and {_X1} and y between {_Y0} and {_Y1}"


@query("AGG_20_viewport_modes", ["cells", "transcripts", "vertices"], f"""with b as (select boundary_id, count(*) as v from vertices group by 1 having max(x)>={_X0} and min(x)<={_X1} and max(y)>={_Y0} and min(y)<={_Y1}),
    bt as (select count(*) as n, coalesce(sum(v),0) as v from b), ct as (select count(*) as n from cells where {_IN_VIEW}), ft as (select count(*) as n from transcripts where feature='Brand#23' and {_IN_VIEW}),
    wt as (select count(*) as n from transcripts where x between {WINDOW[0]} and {WINDOW[2]} and y between {WINDOW[1]} and {WINDOW[3]})
    select 'cells' as asked, case when n<=10000 then 'exact_points' else 'aggregate_density' end as mode, n as total, n as counted from ct
    union all select 'feature', case when n<=10000 then 'exact_points' else 'aggregate_density' end, n, n from ft
    union all select 'grid', 'aggregate_density', count(*), count(*) from transcripts where {_IN_VIEW}
    union all select 'level', 'aggregate_density', n, (select count(*) from transcripts) from wt
    union all select 'boundaries', case when n<=2000 and v<=100000 then 'exact_boundaries' else 'zoom_required' end, n, case when n<=2000 and v<=100000 then n else 0 end from bt""")
def agg_20_modes(t: Tables) -> DataFrame:
    a, feature = t.atlas, F.col("feature") == "Brand#23"
    seen = {"cells": atlas.stored_view(lambda: a.cells, a.cell_tree, VIEW), "feature": atlas.stored_view(lambda: a.transcripts.filter(feature), a.feature_tree.of(feature), VIEW),
            "grid": atlas.stored_view(lambda: a.transcripts, a.molecule_tree, VIEW, limit=1),
            "level": atlas.stored_view(lambda: a.transcripts, a.molecule_tree, WINDOW, limit=1, pyramid=a.molecule_pyramid, whole=True),
            "boundaries": atlas.stored_boundary_view(a.boundaries, a.boundary_tree, VIEW)}
    counted = lambda v: F.coalesce(F.sum("count"), F.lit(0)) if v.mode == "aggregate_density" else F.count("*")
    return reduce(DataFrame.unionByName, [v.records.agg(counted(v).alias("counted")).select(
        F.lit(name).alias("asked"), F.lit(v.mode).alias("mode"), F.lit(v.total).cast("bigint").alias("total"), "counted") for name, v in seen.items()])


@query("AGG_20_viewport_answer", ["transcripts"], f"select 'aggregate_density' as mode, count(*) as total, count(*) as counted from transcripts where x between {_X0} and {_X1} and y between {_Y0} and {_Y1}")
def agg_20(t: Tables) -> DataFrame:
    seen = atlas.stored_view(lambda: t.atlas.transcripts, t.atlas.molecule_tree, VIEW, limit=1, grid=64)
    return seen.records.agg(F.lit(seen.mode).alias("mode"), F.lit(seen.total).cast("bigint").alias("total"), F.sum("count").alias("counted"))


@query("JOIN_10_boundary_viewport", ["vertices"], f"select boundary_id, any_value(cell_id) as cell_id, any_value(kind) as kind, count(*) as vertex_count from vertices group by boundary_id having max(x)>={_X0} and min(x)<={_X1} and max(y)>={_Y0} and min(y)<={_Y1}")
def join_10(t: Tables) -> DataFrame:
    return atlas.boundaries_in(t.atlas.boundaries, VIEW).select("boundary_id", "cell_id", "kind", "vertex_count")


@query("JOIN_11_molecules_of_feature", ["transcripts"], f"select id, cell_id, x, y from transcripts where feature='Brand#23' and x between {_X0} and {_X1} and y between {_Y0} and {_Y1}")
def join_11(t: Tables) -> DataFrame:
    return atlas.molecules_of(t.atlas.transcripts, "Brand#23", VIEW).select("id", "cell_id", "x", "y")


@query("JOIN_19_assigned_cells", ["transcripts", "cells"], "select coalesce(c.label,'unassigned') as cell_label, count(*) as molecules from (select case when cell_id%4=0 then null else cell_id end as cell_id from transcripts) t left join cells c using (cell_id) group by 1")
def join_19(t: Tables) -> DataFrame:
    some = t.transcripts.withColumn("cell_id", F.when(F.col("cell_id") % 4 != 0, F.col("cell_id")))
    return atlas.with_assigned_cell(some, t.cells).groupBy(F.coalesce("cell_label", F.lit("unassigned")).alias("cell_label")).agg(F.count("*").alias("molecules"))


@query("SNK_05_roi_freeze", ["cells", "counts", "features"], f"""select (select count(*) from cells where x between {_X0} and {_X1} and y between {_Y0} and {_Y1}) as cells,
    (select count(*) from features) as panel, count(*) as entries, sum(value) as total from counts where cell_id in (select cell_id from cells where x between {_X0} and {_X1} and y between {_Y0} and {_Y1})""")
def snk_05(t: Tables) -> DataFrame:
    folder = scratch(t)
    # Counts are not stored first: those of other cells are dropped at the orders, before lines are joined and summed.
    written = atlas.write_roi(folder, t.atlas.cells, t.counts, t.features, VIEW)
    size = lambda name: F.max(F.when(F.col("table") == name, F.col("row_count")))
    sums = t.spark.read.parquet(f"{folder}/counts").agg(F.sum("value").alias("total")).withColumn("_k", F.lit(1))
    return written.agg(size("cells").alias("cells"), size("features").alias("panel"), size("counts").alias("entries")).withColumn("_k", F.lit(1)).join(sums, "_k").drop("_k")


@query("VAL_20_axis_totals", ["cells", "features", "counts", "transcripts", "vertices"], """select 'cells' as "table", count(*) as rows from cells union all select 'features', count(*) from features union all select 'counts', count(*) from counts
    union all select 'transcripts', count(*) from transcripts union all select 'boundaries', count(distinct boundary_id) from vertices""")
def val_20(t: Tables) -> DataFrame:
    return atlas.totals(cells=t.cells, features=t.features, counts=t.counts, transcripts=t.transcripts, boundaries=t.vertices.select("boundary_id").distinct())


@query("FLT_14_affine_points", ["cells"], "select cell_id, round(0.9*x-0.2*y+15,6) as wx, round(0.3*x+1.1*y-7,6) as wy from cells")
def flt_14(t: Tables) -> DataFrame:
    from ..functions.geometry import apply_affine
    x, y = apply_affine(F.col("x"), F.col("y"), [[0.9, -0.2, 15], [0.3, 1.1, -7], [0, 0, 1]])
    return rounded(t.cells.select("cell_id", x.alias("wx"), y.alias("wy")), "wx", "wy", digits=6)


@query("FN_06_polygon_measures", ["vertices"], "select boundary_id, round((max(x)-min(x))*(max(y)-min(y)),8) as area, round((max(x)+min(x))/2,8) as cx, round((max(y)+min(y))/2,8) as cy from vertices group by boundary_id")
def fn_06(t: Tables) -> DataFrame:
    from ..functions.geometry import ring_centroid, shoelace
    b = atlas.assemble_boundaries(t.vertices)
    xs, ys = F.col("ring.x"), F.col("ring.y")
    c = ring_centroid(xs, ys)
    return rounded(b.select("boundary_id", (F.abs(shoelace(xs, ys)) / 2).alias("area"), c["x"].alias("cx"), c["y"].alias("cy")), "area", "cx", "cy")


@query("WIN_07_closing_edges", ["vertices"], "select boundary_id, vertex, round(x,8) as x, round(y,8) as y, round(coalesce(lead(x) over w, first_value(x) over w),8) as next_x, round(coalesce(lead(y) over w, first_value(y) over w),8) as next_y from vertices window w as (partition by boundary_id order by vertex)")
def win_07(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W
    w = W.partitionBy("boundary_id").orderBy("vertex")  # at most 1000 vertices per boundary
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return rounded(t.vertices.select("boundary_id", "vertex", "x", "y", nxt("x").alias("next_x"), nxt("y").alias("next_y")), "x", "y", "next_x", "next_y")


@query("VAL_08_boundary_assembly", ["vertices"], "select boundary_id, min(cell_id) as cell_id, min(kind) as kind, count(*) as vertex_count, round(min(x),8) as minx, round(min(y),8) as miny, round(max(x),8) as maxx, round(max(y),8) as maxy, cast(null as varchar) as problem from vertices group by 1")
def val_08(t: Tables) -> DataFrame:
    return rounded(atlas.assemble_boundaries(t.vertices).drop("ring"), "minx", "miny", "maxx", "maxy")
