"""Neighbour graphs, permutation tests, models and studies."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import numeric
from ..operators import expression as E, integration as I, models as M, ranking, spatial as S, spectral as SP, statistics as ST, study
from ..operators.vectors import knn_vectors
from ..session import materialise
from .annotation import rounded
from .measurement import channels, live_cells
from .registry import query
from .tables import Tables

MORAN_PERMUTATIONS, PAIR_PERMUTATIONS = 99, 199
SEED = 7
STILL = float("nan")  # SQL divides by a bandwidth of zero, so a row that has one is NaN


def _xy(t: Tables) -> DataFrame:
    return live_cells(t).select("cell_id", "x", "y")


def _norm(t: Tables) -> DataFrame:
    cells = live_cells(t)
    return E.normalise(t.counts, cells)


# --- graphs -----------------------------------------------------------------------------------------

@query("JOIN_02_k_nearest", ["knn6"], "select src, dst, round(dist,8) as dist from knn6")
def join_02(t: Tables) -> DataFrame:
    return rounded(S.knn(_xy(t), 6).select("src", "dst", "dist"), "dist")


@query("WIN_04_nearest_ranks", ["live"], """select src, dst, rk as rank from (select a.cell_id as src, b.cell_id as dst, row_number() over (partition by a.cell_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) as rk
    from live a join live b on a.cell_id<>b.cell_id) where rk<=3""")
def win_04(t: Tables) -> DataFrame:
    return S.knn(_xy(t), 3).select("src", "dst", F.col("rank").cast("bigint").alias("rank"))


@query("WIN_06_adaptive_bandwidth", ["knn6"], "select src, round(median(dist),8) as sigma from knn6 group by src")
def win_06(t: Tables) -> DataFrame:
    return rounded(S.knn(_xy(t), 6).groupBy("src").agg(F.median("dist").alias("sigma")), "sigma")


@query("FN_05_gaussian_kernel", ["kernel6"], "select src, dst, round(w,8) as w from kernel6")
def fn_05(t: Tables) -> DataFrame:
    edges = S.knn(_xy(t), 6)
    edges = edges.join(edges.groupBy("src").agg(F.median("dist").alias("sigma")), "src")
    return rounded(edges.select("src", "dst", numeric.gaussian_kernel(F.col("dist"), F.col("sigma")).alias("w")), "w")


@query("ML_01_adaptive_graph", ["graph6"], "select src, dst, round(w,8) as w from graph6")
def ml_01(t: Tables) -> DataFrame:
    return rounded(S.adaptive_graph(_xy(t), 6), "w")


@query("ML_02_row_stochastic_graph", ["row_graph6"], "select src, dst, round(w,8) as w from row_graph6")
def ml_02(t: Tables) -> DataFrame:
    return rounded(S.row_stochastic_graph(_xy(t), 6, STILL).select("src", "dst", "w"), "w")


@query("JOIN_20_spatial_lag", ["row_graph6", "norm"], "select g.src as cell_id, n.feature_id, round(sum(g.w*n.value),8) as lag from row_graph6 g join norm n on n.cell_id=g.dst group by 1,2")
def join_20(t: Tables) -> DataFrame:
    return rounded(S.spatial_lag(S.row_stochastic_graph(_xy(t), 6, STILL), _norm(t)), "lag")


@query("ML_03_graph_smoothing", ["row_graph6", "norm"], "select cell_id, feature_id, round(sum(v),8) as value from (select cell_id, feature_id, 0.65::double*value as v from norm union all select g.src, n.feature_id, 0.35::double*g.w*n.value from row_graph6 g join norm n on n.cell_id=g.dst) group by 1,2")
def ml_03(t: Tables) -> DataFrame:
    return rounded(S.smooth(S.row_stochastic_graph(_xy(t), 6, STILL), _norm(t), 0.65), "value")


_DENSE = """dense as (select c.cell_id, f.feature_id, coalesce(n.value,0) as y from live c cross join features f left join norm n on n.cell_id=c.cell_id and n.feature_id=f.feature_id),
    mom as (select feature_id, avg(y) as m, var_pop(y)*count(*) as d, count(*) as n, count(case when y>0 then 1 end) as detected from dense group by 1),
    z as (select cell_id, feature_id, y-m as z from dense join mom using (feature_id)), s0 as (select sum(w) as s0 from {g})"""


def _moran_sql(graph: str) -> str:
    return f"with {_DENSE.format(g=graph)}, num as (select a.feature_id, sum(g.w*a.z*b.z) as num from {graph} g join z a on a.cell_id=g.src join z b on b.cell_id=g.dst and b.feature_id=a.feature_id group by 1), i as (select feature_id, n/s0*num/d as morans_i from num join mom using (feature_id), s0)"


@query("AGG_26_morans_i", ["graph6", "norm", "live", "features"], _moran_sql("graph6") + " select feature_id, round(morans_i,8) as morans_i from i")
def agg_26(t: Tables) -> DataFrame:
    cells = _xy(t)
    return rounded(ST.moran_i(_norm(t), S.adaptive_graph(cells, 6), cells.count()), "morans_i")


@query("AGG_26_morans_i_row_graph", ["row_graph6", "norm", "live", "features"], _moran_sql("row_graph6") + " select feature_id, round(morans_i,8) as morans_i from i")
def agg_26_row(t: Tables) -> DataFrame:
    cells = _xy(t)
    return rounded(ST.moran_i(_norm(t), S.row_stochastic_graph(cells, 6, STILL), cells.count()), "morans_i")


@query("AGG_27_moran_ranked_features", ["row_graph6", "norm", "live", "features", "counts"], _moran_sql("row_graph6").replace("coalesce(n.value,0) as y", "coalesce(k.value,0) as y").replace("left join norm n on n.cell_id=c.cell_id and n.feature_id=f.feature_id", "left join counts k on k.cell_id=c.cell_id and k.feature_id=f.feature_id")
       + " select feature_id, round(morans_i,8) as morans_i from i order by i.morans_i desc, feature_id limit 8")
def agg_27(t: Tables) -> DataFrame:
    cells = _xy(t)
    raw = t.counts.join(cells.select("cell_id"), "cell_id", "left_semi")
    return rounded(E.top_features(ST.moran_i(raw, S.row_stochastic_graph(cells, 6, STILL), cells.count()), "morans_i", 8), "morans_i")


def _perm(count: int) -> str:
    return f"""perms as (select p as perm, cell_id, row_number() over (partition by p order by md5(concat('{SEED}|',cast(p as varchar),'|',cast(cell_id as varchar))))-1 as idx from live, range(1,{count + 1}) r(p)),
    ids as (select cell_id, row_number() over (order by cell_id)-1 as idx from live),
    placed as (select perm, i.cell_id, p.cell_id as from_id from perms p join ids i using (idx) union all select 0, cell_id, cell_id from live)"""


@query("WIN_09_permutations", ["live"], f"with {_perm(MORAN_PERMUTATIONS)} select perm, cell_id, from_id from placed")
def win_09(t: Tables) -> DataFrame:
    return ranking.permutations(_xy(t), MORAN_PERMUTATIONS, SEED)


def _bh_sql(rows: str) -> str:
    return f"bh as (select *, case when p_value is not null then least(1, min(case when p_value is not null then p_value*m/rk end) over (order by rk desc rows unbounded preceding)) end as q_value from (select *, count(p_value) over () as m, row_number() over (order by p_value nulls last) as rk from {rows}))"


_SVG = f"""with {_DENSE.format(g='graph6')}, {_perm(MORAN_PERMUTATIONS)}, sc as (select p.perm, a.feature_id, sum(g.w*a.z*b.z) as num from placed p join graph6 g on g.src=p.cell_id join placed q on q.perm=p.perm and q.cell_id=g.dst
    join z a on a.cell_id=p.from_id join z b on b.cell_id=q.from_id and b.feature_id=a.feature_id group by 1,2),
    i as (select perm, feature_id, n/s0*num/d as i from sc join mom using (feature_id), s0),
    o as (select feature_id, i as morans_i from i where perm=0), e as (select feature_id, count(case when i.i>=o.morans_i-1e-12*greatest(1,abs(o.morans_i)) then 1 end) as exceed from i join o using (feature_id) where perm>0 group by 1),
    r as (select m.feature_id, m.detected, case when m.detected<5 then 'below_detection_filter' else 'tested' end as status, case when m.detected>=5 then o.morans_i end as morans_i, case when m.detected>=5 then (exceed+1)/{MORAN_PERMUTATIONS + 1}::double end as p_value
        from mom m left join o using (feature_id) left join e using (feature_id)), {_bh_sql('r')}"""


def _svg(t: Tables) -> DataFrame:
    cells = _xy(t)
    detected = t.features.select("feature_id").join(
        t.counts.filter("value > 0").join(cells.select("cell_id"), "cell_id", "left_semi").groupBy("feature_id").agg(F.count("*").alias("_d")), "feature_id", "left"
    ).select("feature_id", F.coalesce("_d", F.lit(0)).alias("detected"))
    return ST.spatially_variable(_norm(t), detected, S.adaptive_graph(cells, 6), cells, permutation_count=MORAN_PERMUTATIONS, seed=SEED)


@query("ML_04_spatially_variable", ["graph6", "norm", "live", "features"], _SVG + " select feature_id, detected, status, round(morans_i,8) as morans_i, p_value, round(q_value,8) as q_value from bh")
def ml_04(t: Tables) -> DataFrame:
    return rounded(_svg(t), "morans_i", "q_value")


_LR = f"""with {_perm(PAIR_PERMUTATIONS)}, ent as (select distinct e from (select ligand as e from lr_pairs union all select receptor from lr_pairs)),
    su as (select e, unnest(string_split(e,'_')) as s from ent), ok as (select e, count(*) as size, bool_and(f.feature_id is not null) as fine from su left join features f on f.symbol=s group by e),
    ex as (select e, cell_id, min(value) as v from su join ok using (e) join norm n on n.feature_id=s where fine group by e, cell_id, size having count(*)=size),
    rw as (select src, dst, w/sum(w) over (partition by src) as w from graph6),
    fold as (select e as ligand, dst as cell_id, sum(v*w) as c from ex join rw on rw.src=ex.cell_id where e in (select ligand from lr_pairs) group by 1,2),
    sc as (select l.ligand, l.receptor, p.perm, sum(f.c*x.v)/(select count(*) from live) as s from lr_pairs l join fold f on f.ligand=l.ligand join placed p on p.cell_id=f.cell_id join ex x on x.e=l.receptor and x.cell_id=p.from_id group by 1,2,3),
    st as (select l.ligand, l.receptor, a.fine and b.fine as t from lr_pairs l join ok a on a.e=l.ligand join ok b on b.e=l.receptor),
    r as (select st.ligand, st.receptor, case when t then 'tested' else 'unmeasured_or_ambiguous_required_subunit' end as status, case when t then coalesce(o.s,0) end as score,
        case when t then (case when coalesce(o.s,0)<=0 then {PAIR_PERMUTATIONS} else coalesce((select count(*) from sc where sc.ligand=st.ligand and sc.receptor=st.receptor and sc.perm>0 and sc.s>=o.s-1e-12*greatest(1,o.s)),0) end+1)/{PAIR_PERMUTATIONS + 1}::double end as p_value,
        case when t then coalesce((select count(*) from ex where e=st.ligand),0)/(select count(*) from live)::double end as ligand_detection
        from st left join sc o on o.ligand=st.ligand and o.receptor=st.receptor and o.perm=0), {_bh_sql('r')}"""


@query("ML_05_ligand_receptor", ["graph6", "norm", "live", "features", "lr_pairs"], _LR + " select ligand, receptor, status, round(score,8) as score, round(ligand_detection,8) as ligand_detection, p_value, round(q_value,8) as q_value from bh")
def ml_05(t: Tables) -> DataFrame:
    cells = _xy(t)
    out = ST.ligand_receptor(_norm(t), t.features, t.lr_pairs, S.adaptive_graph(cells, 6), cells, permutation_count=PAIR_PERMUTATIONS, seed=SEED)
    return rounded(out.select("ligand", "receptor", "status", "score", "ligand_detection", "p_value", "q_value"), "score", "ligand_detection", "q_value")


@query("AGG_32_ligand_receptor_score", ["graph6", "norm", "live", "features", "lr_pairs"], _LR.replace(_perm(PAIR_PERMUTATIONS), "placed as (select 0 as perm, cell_id, cell_id as from_id from live)") + " select ligand, receptor, round(score,8) as score from bh where status='tested'")
def agg_32(t: Tables) -> DataFrame:
    cells = _xy(t)
    return rounded(ST.pair_scores(_norm(t), t.features, t.lr_pairs, S.adaptive_graph(cells, 6), cells), "score")


@query("JOIN_13_complex_resolution", ["features", "lr_pairs"], """with su as (select ligand, receptor, unnest(list_concat(string_split(ligand,'_'),string_split(receptor,'_'))) as s from lr_pairs)
    select ligand, receptor, bool_and(f.feature_id is not null) as testable, coalesce(string_agg(distinct case when f.feature_id is null then s end, ',' order by case when f.feature_id is null then s end),'') as unresolved from su left join features f on f.symbol=s group by 1,2""")
def join_13(t: Tables) -> DataFrame:
    _, verdict = ST.resolve_pairs(t.lr_pairs, t.features)
    return verdict.select("ligand", "receptor", "testable", F.array_join("unresolved_subunits", ",").alias("unresolved"))


@query("FN_15_complex_minimum", ["norm", "lr_pairs", "features"], "select e as entity, cell_id, round(min(value),8) as value from (select e, unnest(string_split(e,'_')) as s, length(e)-length(replace(e,'_',''))+1 as size from (select distinct receptor as e from lr_pairs)) join norm on feature_id=s group by 1,2,size having count(*)=size")
def fn_15(t: Tables) -> DataFrame:
    entities, _ = ST.resolve_pairs(t.lr_pairs.select(F.col("receptor").alias("ligand"), "receptor"), t.features)
    return rounded(ST.entity_expression(_norm(t), entities), "value")


# --- false discovery and resolution ---------------------------------------------------------------------

_PV = "pv as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as family, round(((l_orderkey*7919+l_partkey*104729+l_linenumber*31)%10007+1)/10008.0::double,6) as p_value from lineitem)"


def _p_values(t: Tables) -> DataFrame:
    p = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 10007 + 1) / 10008.0
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("family"), F.round(p, 6).alias("p_value"))


@query("WIN_01_benjamini_hochberg", (), f"with {_PV} select l_orderkey, l_linenumber, l_partkey, l_suppkey, family, p_value, round(least(1,min(p_value*m/rk) over (partition by family order by rk desc rows unbounded preceding)),8) as q_value from (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by p_value) as rk from pv)")
def win_01(t: Tables) -> DataFrame:
    return rounded(ranking.benjamini_hochberg(_p_values(t), family=["family"]), "q_value")


@query("WIN_02_failed_tests_kept", (), f"with {_PV}, f as (select *, case when l_suppkey%5=0 then null else p_value end as p2 from pv) select l_orderkey, l_linenumber, l_partkey, l_suppkey, family, p2 as p_value, case when p2 is not null then round(least(1,min(p*m/rk) over (partition by family order by rk desc rows unbounded preceding)),8) end as q_value from (select *, coalesce(p2,1) as p, count(*) over (partition by family) as m, row_number() over (partition by family order by coalesce(p2,1)) as rk from f)")
def win_02(t: Tables) -> DataFrame:
    rows = _p_values(t).withColumn("p_value", F.when(F.col("l_suppkey") % 5 != 0, F.col("p_value")))
    return rounded(ranking.benjamini_hochberg(rows, family=["family"], failed_as_one=True), "q_value")


@query("AGG_33_discovery_summary", (), f"with {_PV}, b as (select *, least(1,min(p_value*m/rk) over (partition by family order by rk desc rows unbounded preceding)) as q from (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by p_value) as rk from (select * replace (case when l_partkey%7<>0 then p_value/case when l_suppkey%4=0 then 1e6 else 1 end end as p_value) from pv) z where p_value is not null)) select (select count(*) from pv) as row_count, count(*) as tested, count(case when q<0.05 then 1 end) as discoveries from b")
def agg_33_discoveries(t: Tables) -> DataFrame:
    p = F.when(F.col("l_partkey") % 7 != 0, F.col("p_value") / F.when(F.col("l_suppkey") % 4 == 0, 1e6).otherwise(1.0))
    return ST.discovery_summary(ranking.benjamini_hochberg(_p_values(t).withColumn("p_value", p), family=["family"]))


@query("FN_07_wilson_interval", (), """select l_returnflag, l_linestatus, round(greatest(0,(p+z*z/(2*n))/(1+z*z/n)-z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n)),8) as low, round(least(1,(p+z*z/(2*n))/(1+z*z/n)+z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n)),8) as high
    from (select l_returnflag, l_linestatus, count(*)::double as n, count(case when l_quantity>25 then 1 end)/count(*)::double as p, 1.959963984540054::double as z from lineitem group by 1,2)""")
def fn_07(t: Tables) -> DataFrame:
    g = t.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_quantity") > 25).alias("k"), F.count("*").alias("n"))
    ci = numeric.wilson_interval(F.col("k"), F.col("n"))
    return rounded(g.select("l_returnflag", "l_linestatus", ci["low"].alias("low"), ci["high"].alias("high")), "low", "high")


@query("FN_08_permutation_p", (), "select p_brand, (count(case when p_size>25 then 1 end)+1)/(999+1)::double as p from part group by 1")
def fn_08(t: Tables) -> DataFrame:
    return t.raw("part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("b")).select("p_brand", numeric.permutation_p(F.col("b"), 999).alias("p"))


@query("FN_09_permutation_resolution", (), """select p_partkey, 1.0::double/(b+1) as minimum_p, (m*20)//(b+1)+1 as minimum_rejection_rank, (m*20)//r as minimum_permutations, m*20 < r*(b+1) as rank_attainable
    from (select p_partkey, (p_partkey+1)*7 as m, p_size*37+18 as b, p_size+1 as r from part)""")
def fn_09(t: Tables) -> DataFrame:
    p = t.raw("part").select("p_partkey", ((F.col("p_partkey") + 1) * 7).alias("m"), (F.col("p_size") * 37 + 18).alias("b"), (F.col("p_size") + 1).alias("r"))
    out = p.select("p_partkey", numeric.permutation_resolution(F.col("m"), F.col("b"), F.col("r"), "0.05").alias("s")).select("p_partkey", "s.*")
    return out.drop("rank_threshold")


@query("ORD_03_ranked_results", (), f"with {_PV} select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_value from pv order by p_value, l_orderkey, l_partkey, l_suppkey, l_linenumber limit 200)")
def ord_03(t: Tables) -> DataFrame:
    from ..operators.filters import ranked
    rows = _p_values(t).drop("family").withColumn("score", F.lit(0.0))
    return rows.orderBy(*ranked(rows, "p_value", "score", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).limit(200).drop("score")


@query("ORD_03_ranked_by_score", (), f"""with {_PV} select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber<7 then round(p_value,1) end as q, l_partkey%97 as score
    from pv order by q nulls last, score desc, l_orderkey, l_partkey, l_suppkey, l_linenumber limit 500)""")
def ord_03_score(t: Tables) -> DataFrame:
    from ..operators.filters import ranked
    rows = _p_values(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") < 7, F.round("p_value", 1)).alias("q"), (F.col("l_partkey") % 97).alias("score"))
    return rows.orderBy(*ranked(rows, "q", "score", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).limit(500)


@query("FN_10_entropy", (), "select o_custkey, round(sum(-p*ln(p)),8) as entropy from (select o_custkey, o_totalprice/sum(o_totalprice) over (partition by o_custkey) as p from orders) group by 1")
def fn_10(t: Tables) -> DataFrame:
    share = F.col("o_totalprice") / F.sum("o_totalprice").over(W.partitionBy("o_custkey"))
    return rounded(t.raw("orders").select("o_custkey", share.alias("p")).groupBy("o_custkey").agg(F.sum(numeric.entropy_term(F.col("p"))).alias("entropy")), "entropy")


# --- partitions and transports ------------------------------------------------------------------------

def _partitions(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = t.at("r2").filter("included").select("cell_id", F.col("label").alias("domain"))
    right = t.cells.filter(F.col("cell_id") % 10 != 0).select("cell_id", F.concat(F.lit("d"), ((F.floor(F.col("x") / 300) + F.floor(F.col("y") / 300) * 4)).cast("string")).alias("domain"))
    return left, right


_PARTS = """pa as (select cell_id, label as domain from cells_r2 where included), pb as (select cell_id, concat('d',cast(cast(floor(x/300)+floor(y/300)*4 as bigint) as varchar)) as domain from cells where cell_id%10<>0),
    both_ as (select pa.cell_id, pa.domain as a, pb.domain as b, c.x, c.y from pa join pb using (cell_id) join cells c using (cell_id))"""


@query("AGG_16_adjusted_rand", ["cells", "cells_r2"], f"""with {_PARTS}, s as (select sum(n*(n-1)/2) as s, sum(n)::bigint as t from (select count(*)::double as n from both_ group by a,b)), ca as (select sum(n*(n-1)/2) as ca from (select count(*)::double as n from both_ group by a)), cb as (select sum(n*(n-1)/2) as cb from (select count(*)::double as n from both_ group by b))
    select t as common_count, round((s-ca*cb/(t*(t-1)/2.0::double))/((ca+cb)/2-ca*cb/(t*(t-1)/2.0::double)),8) as adjusted_rand_index from s, ca, cb""")
def agg_16(t: Tables) -> DataFrame:
    return rounded(I.adjusted_rand(*_partitions(t)), "adjusted_rand_index")


_DIS = f"with {_PARTS}, nn as (select * from (select p.cell_id, p.a, p.b, q.a as qa, q.b as qb, q.cell_id as dst, row_number() over (partition by p.cell_id order by (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y), q.cell_id) as rk from both_ p join both_ q on p.cell_id<>q.cell_id) where rk<=6), d as (select cell_id, avg(case when (a=qa)<>(b=qb) then 1.0::double else 0 end) as boundary_disagreement, any_value(a) as left_domain, any_value(b) as right_domain from nn group by 1)"


@query("AGG_17_boundary_disagreement", ["cells", "cells_r2"], _DIS + " select cell_id, round(boundary_disagreement,8) as boundary_disagreement, left_domain, right_domain from d")
def agg_17(t: Tables) -> DataFrame:
    return rounded(I.boundary_disagreement(t.cells, *_partitions(t)), "boundary_disagreement")


@query("JOIN_04_nearest_common", ["cells", "cells_r2"], _DIS + " select cell_id as src, dst from nn")
def join_04(t: Tables) -> DataFrame:
    common = t.cells.join(I.common_observations(*_partitions(t)), "cell_id", "left_semi")
    return S.knn(common.select("cell_id", "x", "y"), 6).select("src", "dst")


@query("ML_21_integration_comparison", ["cells", "cells_r2"], _DIS + " select (select round(avg(boundary_disagreement),8) from d) as mean_boundary_disagreement, (select count(*) from both_) as common_count, (select count(*) from pa)-(select count(*) from both_) as left_only_count, (select count(*) from pb)-(select count(*) from both_) as right_only_count")
def ml_21(t: Tables) -> DataFrame:
    from ..operators.validate import id_sets
    left, right = _partitions(t)
    mean = I.boundary_disagreement(t.cells, left, right).agg(F.round(F.avg("boundary_disagreement"), 8).alias("mean_boundary_disagreement")).withColumn("_k", F.lit(1))
    sets = id_sets(left, right).withColumnsRenamed({"shared": "common_count", "left_only": "left_only_count", "right_only": "right_only_count"}).withColumn("_k", F.lit(1))
    return mean.join(sets, "_k").drop("_k")


@query("SET_03_common_observations", ["cells", "cells_r2"], f"with {_PARTS} select cell_id from pa intersect select cell_id from pb")
def set_03(t: Tables) -> DataFrame:
    return I.common_observations(*_partitions(t))


@query("SET_06_retained_rows", ["cells_r0", "cells_r2"], "select cell_id from cells_r0 where included intersect select cell_id from cells_r2 where included")
def set_06(t: Tables) -> DataFrame:
    return t.cells.filter("included").select("cell_id").intersect(t.at("r2").filter("included").select("cell_id"))


# A transport whose rows are orders, whose columns are nations, with masses proportional to price.
_TR = "tr as (select o_custkey%40 as i, o_orderkey%25 as j, sum(o_totalprice)/(select sum(o_totalprice) from orders) as mass from orders group by 1,2), tg as (select n_nationkey as j, n_nationkey*10.0::double as x, n_regionkey*25.0::double as y from nation)"


def _transport(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.raw("orders")
    total = o.agg(F.sum("o_totalprice")).first()[0]
    transport = o.groupBy((F.col("o_custkey") % 40).alias("i"), (F.col("o_orderkey") % 25).alias("j")).agg((F.sum("o_totalprice") / total).alias("mass"))
    return transport, t.raw("nation").select(F.col("n_nationkey").alias("j"), (F.col("n_nationkey") * 10.0).alias("x"), (F.col("n_regionkey") * 25.0).alias("y"))


@query("AGG_30_transport_summaries", (), f"with {_TR}, r as (select i, sum(mass) as row_mass from tr group by i) select i, round(any_value(row_mass),8) as row_mass, round(sum(-(mass/row_mass)*ln(mass/row_mass)),8) as row_entropy, round(sum(mass/row_mass*x),6) as x, round(sum(mass/row_mass*y),6) as y from tr join r using (i) join tg using (j) group by i")
def agg_30(t: Tables) -> DataFrame:
    return rounded(rounded(I.transport_rows(*_transport(t)), "row_mass", "row_entropy"), "x", "y", digits=6)


@query("JOIN_18_transport_marginals", (), f"with {_TR} select round(greatest((select max(abs(s-1.0::double/40)) from (select sum(mass) as s from tr group by i)), (select max(abs(s-1.0::double/25)) from (select sum(mass) as s from tr group by j))),8) as marginal_max_error")
def join_18(t: Tables) -> DataFrame:
    return rounded(I.marginal_error(_transport(t)[0], 40, 25), "marginal_max_error")


# --- pathways, references -------------------------------------------------------------------------------

@query("AGG_31_pathway_coverage", ["pathway_net", "features"], "select source, count(*) as database_targets, count(f.feature_id) as measured_targets, case when count(f.feature_id)>=5 then 'tested' else 'insufficient_measured_targets' end as status from pathway_net left join features f on f.symbol=target and f.symbol<>'Brand#11' group by source")
def agg_31(t: Tables) -> DataFrame:
    return M.pathway_coverage(t.pathway_net, t.features.filter("symbol <> 'Brand#11'"), 5)


@query("JOIN_14_network_genes", ["pathway_net", "features"], "select source, target, f.feature_id, round(weight,8) as weight from pathway_net join features f on f.symbol=target")
def join_14(t: Tables) -> DataFrame:
    return rounded(t.pathway_net.join(t.features.withColumnRenamed("symbol", "target"), "target"), "weight")


@query("ML_07_pathway_activity", ["pathway_net", "norm", "live", "features"], """with g as (select count(*)::double as g from features), w as (select source, sum(weight) as sw, sum(weight*weight) as sww from pathway_net group by 1 having count(*)>=5),
    y as (select cell_id, sum(value) as sy, sum(value*value) as syy from norm group by 1), x as (select n.cell_id, p.source, sum(n.value*p.weight) as swy from norm n join pathway_net p on p.target=n.feature_id group by 1,2),
    r as (select c.cell_id, w.source, (coalesce(swy,0)-sw*sy/g)/sqrt((sww-sw*sw/g)*(syy-sy*sy/g)) as r, g from live c cross join w join y using (cell_id) left join x on x.cell_id=c.cell_id and x.source=w.source, g)
    select cell_id, source, round(r*sqrt((g-2)/((1-r)*(1+r))),6) as score from r""")
def ml_07(t: Tables) -> DataFrame:
    out = M.pathway_activity(live_cells(t), _norm(t), t.features, t.pathway_net, 5)
    return rounded(out.select("cell_id", "source", "score"), "score", digits=6)


# For an odd number of degrees of freedom 2k+1 the two-sided t tail is 1 - 2/pi (a + sin a cos a (1 + 2/3 cos^2 a (1 + 4/5 cos^2 a (...)))), a = atan(t / sqrt(df)).
def _odd_t_tail(score: str, df: int) -> str:
    inner = "1"
    for k in range((df - 3) // 2, 0, -1):
        inner = f"1+{2 * k}/{2 * k + 1}.0::double*c*c*({inner})"
    return f"(select 1-2/pi()*(a+s*c*({inner})) from (select atan(abs({score})/sqrt({df}::double)) as a, sin(atan(abs({score})/sqrt({df}::double))) as s, cos(atan(abs({score})/sqrt({df}::double))) as c))"


@query("WIN_03_pathway_fdr", ["pathway_net", "norm", "live", "features"], f"""with g as (select count(*)::double as g from features), w as (select source, sum(weight) as sw, sum(weight*weight) as sww from pathway_net group by 1 having count(*)>=5),
    y as (select cell_id, sum(value) as sy, sum(value*value) as syy from norm group by 1), x as (select n.cell_id, p.source, sum(n.value*p.weight) as swy from norm n join pathway_net p on p.target=n.feature_id group by 1,2),
    u as (select c.cell_id, w.source, (coalesce(swy,0)-sw*sy/g)/sqrt((sww-sw*sw/g)*(syy-sy*sy/g)) as r, g from live c cross join w join y using (cell_id) left join x on x.cell_id=c.cell_id and x.source=w.source, g),
    v as (select cell_id, source, r*sqrt((g-2)/((1-r)*(1+r))) as score from u), r as (select *, {_odd_t_tail('score', 23)} as p_value from v), {_bh_sql('r')}
    select cell_id, source, round(p_value,6) as p_value, round(q_value,6) as q_value from bh""")
def win_03(t: Tables) -> DataFrame:
    out = M.pathway_activity(live_cells(t), _norm(t), t.features, t.pathway_net, 5)  # 25 features: 23 degrees of freedom
    return rounded(out.select("cell_id", "source", "p_value", "q_value"), "p_value", "q_value", digits=6)


@query("AGG_28_reference_signatures", ["cells", "counts"], "select c.label, k.feature_id, round(sum(k.value)/any_value(n),8) as mean_count from counts k join cells c using (cell_id) join (select label, count(*)::double as n from cells group by 1) s on s.label=c.label group by 1,2")
def agg_28(t: Tables) -> DataFrame:
    return rounded(M.signatures(t.counts, t.cells, 5), "mean_count")


def spots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Spot-level input: cells with counts, summed by tile of a 20-unit grid."""
    tile = F.concat_ws(":", F.floor(F.col("x") / 20).cast("string"), F.floor(F.col("y") / 20).cast("string"))
    counts = t.counts.filter("value > 0").join(t.cells.select("cell_id", tile.alias("spot")), "cell_id").groupBy(F.col("spot").alias("cell_id"), "feature_id").agg(F.sum("value").alias("value"))
    counts = materialise(counts)
    return counts.select("cell_id").distinct(), counts


@query("ML_06_deconvolution")
def ml_06(t: Tables) -> DataFrame:
    spot_cells, spot_counts = spots(t)
    return M.deconvolve(spot_cells, spot_counts, M.signatures(t.counts, t.cells, 5), M.feature_order(t.features))


# --- embeddings -----------------------------------------------------------------------------------------

def _multimodal(t: Tables, spatial: bool, components: int = 10, clusters: int = 6) -> DataFrame:
    panel = channels(t)
    t.protein = materialise(t.protein)  # read for the complete cells, the check, the deviations and the blocks
    complete = t.protein.groupBy("cell_id").agg(F.count("*").alias("k")).filter(F.col("k") == len(panel)).select("cell_id")
    cells = live_cells(t).join(complete, "cell_id", "left_semi")
    values = t.protein.withColumn("value", F.log1p("value"))
    return M.multimodal_baseline(cells, E.normalise(t.counts, cells), values, M.feature_order(t.features), panel, components=components, clusters=clusters, seed=1, spatial=spatial)


def _embedding(t: Tables, cells: DataFrame, components: int) -> DataFrame:
    return SP.principal_components(cells, E.normalise(t.counts, cells), components, t.features)[0]


@query("ML_08_principal_components")
def ml_08(t: Tables) -> DataFrame:
    return _embedding(t, live_cells(t), 5)


_Z_SQL = """d as (select c.cell_id, f.feature_id, coalesce(n.value,0) as y from live c cross join features f left join norm n on n.cell_id=c.cell_id and n.feature_id=f.feature_id),
    z as (select cell_id, feature_id, (y-m)/s as z from d join (select feature_id, avg(y) as m, case when stddev_pop(y)<1e-12 then 1 else stddev_pop(y) end as s from d group by 1) using (feature_id))"""


@query("ML_08_component_energy", ["norm", "live", "features"], f"with {_Z_SQL} select cell_id, round(sum(z*z),6) as energy from z group by 1")
def ml_08_energy(t: Tables) -> DataFrame:
    """On as many components as features the scores of a cell have the length of its standardised row."""
    scores = _embedding(t, live_cells(t), t.features.count())
    return rounded(scores.select("cell_id", F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v).alias("energy")), "energy", digits=6)


@query("ML_08_component_spectrum", ["norm", "live", "features"], f"""with {_Z_SQL}, c as (select a.feature_id as i, b.feature_id as j, sum(a.z*b.z)/(select count(*) from live) as v from z a join z b using (cell_id) group by 1,2),
    s as (select x.i, y.j, sum(x.v*y.v) as v from c x join c y on x.j=y.i group by 1,2)
    select 1 as power, round(sum(v),6) as total from c where i=j union all select 2, round(sum(v*v),6) from c
    union all select 3, round(sum(s.v*c.v),6) from s join c on s.i=c.j and s.j=c.i union all select 4, round(sum(v*v),6) from s""")
def ml_08_spectrum(t: Tables) -> DataFrame:
    """Sums of powers of the components' variances: the traces of powers of the correlation matrix."""
    cells = live_cells(t)
    rows = SP.StandardRows(cells, E.normalise(t.counts, cells), t.features)
    variance, _ = SP.leading(rows.covariance_times, rows.d, rows.d)
    totals = t.spark.createDataFrame([(p, float((variance**p).sum())) for p in range(1, 5)], "power int, total double")
    return rounded(totals, "total", digits=6)


@query("FLT_13_block_scaling", ["norm", "live", "features"], f"""with d as (select c.cell_id, f.feature_id, coalesce(n.value,0) as y from live c cross join features f left join norm n on n.cell_id=c.cell_id and n.feature_id=f.feature_id)
    select cell_id, feature_id, round((y-m)/s/sqrt(k),8) as value from d join (select feature_id, avg(y) as m, case when stddev_pop(y)<1e-12 then 1 else stddev_pop(y) end as s from d group by 1) using (feature_id), (select count(*)::double as k from features)""")
def flt_13(t: Tables) -> DataFrame:
    cells = live_cells(t)
    rows = SP.StandardRows(cells, E.normalise(t.counts, cells), t.features, block=True)
    return rounded(rows.dense().join(rows.index, "idx").select("cell_id", "feature_id", "value"), "value")


@query("ML_09_multimodal_baseline")
def ml_09(t: Tables) -> DataFrame:
    return _multimodal(t, spatial=False)


@query("ML_10_spatial_multimodal")
def ml_10(t: Tables) -> DataFrame:
    return _multimodal(t, spatial=True)


@query("ML_11_spatial_domains")
def ml_11(t: Tables) -> DataFrame:
    cells = live_cells(t)
    embedding = _embedding(t, cells, 5)
    return M.spatial_domains(cells, embedding)


@query("ML_11_domain_vectors", (), """select a::int as a, b::int as b, case when a=b then 1.0 else 0.0 end::double as product, case when a=b then 0.0 end::double as residual
    from range(6) p(a), range(6) q(b)""")
def ml_11_vectors(t: Tables) -> DataFrame:
    """Products of the leading vectors with each other, and the length of A v - (v A v) v of each, from the edges themselves."""
    cells = live_cells(t)
    edges, index, vectors = M.domain_vectors(cells, _embedding(t, cells, 5))
    degree = edges.groupBy(F.col("src").alias("cell_id")).agg(F.sum("affinity").alias("degree"))
    entry = materialise(vectors.join(index, "idx").join(degree, "cell_id").select("cell_id", "degree", F.posexplode("vec").alias("a", "v")))
    to = entry.select(F.col("cell_id").alias("dst"), F.col("degree").alias("dj"), "a", F.col("v").alias("u"))
    image = edges.join(to, "dst").groupBy(F.col("src").alias("cell_id"), "a").agg(F.sum(F.col("affinity") * F.col("u") / F.sqrt("dj")).alias("s"))
    both = materialise(entry.join(image, ["cell_id", "a"]).select("cell_id", "a", "v", (F.col("s") / F.sqrt("degree")).alias("av")))
    value = both.groupBy("a").agg((F.sum(F.col("v") * F.col("av")) / F.sum(F.col("v") * F.col("v"))).alias("theta"))
    rest = both.join(value, "a").groupBy("a").agg(F.sqrt(F.sum((F.col("av") - F.col("theta") * F.col("v")) ** 2)).alias("residual"))
    products = both.select("cell_id", "a", "v").join(both.select("cell_id", F.col("a").alias("b"), F.col("v").alias("u")), "cell_id").groupBy("a", "b").agg(F.sum(F.col("v") * F.col("u")).alias("product"))
    out = products.join(rest.withColumn("b", F.col("a")), ["a", "b"], "left")
    return rounded(out.select("a", "b", "product", "residual"), "product", "residual", digits=6).withColumns({c: F.col(c) + 0.0 for c in ("product", "residual")})


@query("ML_12_batch_correction")
def ml_12(t: Tables) -> DataFrame:
    cells = live_cells(t)
    embedding = _embedding(t, cells, 5)
    batches = cells.select("cell_id", F.when(F.col("x") < 500, "left").otherwise("right").alias("batch"))
    design = batches.join(cells.select("cell_id", F.col("label").alias("condition")), "cell_id")
    if study.confounding(design).first()[0]:
        raise ValueError("condition is completely confounded with batch")
    return M.harmonise(embedding, batches, seed=1)


@query("ML_19_integration_alternatives", ["live"], """with a as (select * from (values (0,3),(1,3),(2,6)) v(alternative, domains))
    select alternative, variant, 'computed' as status, cast(null as varchar) as reason, 'rna_only' as representation, n as observation_count, domains from a, (select 'baseline' as variant, count(*) as n from live union all select 'drop', count(*) from live where region<>'n1') v
    union all select alternative, variant, 'unknown', reason, null, null, null from a, (values ('readmit','hypothetical_reinclusion_requires_explicit_revision'),('blurred','selector_has_unknown_objects')) v(variant, reason)""")
def ml_19(t: Tables) -> DataFrame:
    cells = materialise(t.cells.join(live_cells(t).select("cell_id"), "cell_id", "left_semi"))
    values = materialise(E.normalise(t.counts, cells))  # read by every fit

    def fit(kept: DataFrame, components: int, clusters: int) -> DataFrame:
        embedding = SP.principal_components(kept, values, components, t.features)[0]
        return M.kmeans(embedding, clusters, 1).withColumn("representation", F.lit("rna_only"))

    members = (cells.filter("region = 'n1'").select(F.lit("drop").alias("variant"), "cell_id")
               .unionByName(t.cells.filter("region = 'n2'").select(F.lit("readmit").alias("variant"), "cell_id")))
    return M.alternatives_grid(cells, members, {"drop": {"included": False}, "readmit": {"included": True}, "blurred": {"included": False}}, {"blurred": 3},
                               [{"components": 3, "clusters": 3}, {"components": 5, "clusters": 3}, {"components": 5, "clusters": 6}], fit)


@query("JOIN_03_embedding_neighbours", (), """select src, dst from (select a.vec_id as src, b.vec_id as dst, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.e,b.e), lambda z: (z[1]-z[2])*(z[1]-z[2]))), b.vec_id) as rk
    from (select vec_id, embedding::double[] as e from embeddings) a join (select vec_id, embedding::double[] as e from embeddings) b on a.vec_id<>b.vec_id) where rk<=15""")
def join_03(t: Tables) -> DataFrame:
    return knn_vectors(t.embeddings, 15).select("src", "dst")


@query("AGG_29_cross_batch_fraction", (), """select round(avg(case when la<>lb then 1.0::double else 0 end),8) as cross_batch_neighbor_fraction from (select a.label as la, b.label as lb, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.e,b.e), lambda z: (z[1]-z[2])*(z[1]-z[2]))), b.vec_id) as rk
    from (select vec_id, label, embedding::double[] as e from embeddings) a join (select vec_id, label, embedding::double[] as e from embeddings) b on a.vec_id<>b.vec_id) where rk<=15""")
def agg_29(t: Tables) -> DataFrame:
    return rounded(M.cross_batch_fraction(t.embeddings.select("cell_id", "embedding"), t.embeddings.select("cell_id", "batch"), 15), "cross_batch_neighbor_fraction")


# --- studies ----------------------------------------------------------------------------------------------

def _full_records(t: Tables) -> DataFrame:
    return t.records.select("section_id", "metric", "value").withColumns({"units": F.lit("au"), "method_version": F.lit("1")})


@query("AGG_21_subject_means", ["records"], "select subject_id, condition, 'all' as roi_class, metric, 'au' as units, '1' as method_version, round(avg(value),8) as mean_of_section_summaries, count(*) as section_count from records group by subject_id, condition, metric")
def agg_21(t: Tables) -> DataFrame:
    return rounded(study.subject_means(_full_records(t), t.sections), "mean_of_section_summaries")


@query("AGG_22_design_confounding", ["sections"], "select bool_and(k=1) and min(c0)<>max(c1) as condition_batch_complete_confounding from (select subject_id%4 as batch, count(distinct condition) as k, min(condition) as c0, max(condition) as c1 from sections group by 1)")
def agg_22(t: Tables) -> DataFrame:
    return study.confounding(t.sections.withColumn("batch", F.col("subject_id") % 4))


@query("AGG_23_subjects_per_condition", ["sections"], "select condition, count(distinct subject_id) as subjects from sections group by 1")
def agg_23(t: Tables) -> DataFrame:
    return study.subjects_per_condition(t.sections)


@query("JOIN_15_missing_sections", ["sections", "records"], "select s.section_id, m.metric, s.subject_id, s.condition from sections s cross join (select distinct metric from records) m left join records r on r.section_id=s.section_id and r.metric=m.metric where r.section_id is null")
def join_15(t: Tables) -> DataFrame:
    return study.missing_sections(t.records, t.sections, t.records).select("section_id", "metric", "subject_id", "condition")


_MISSING = "ms as (select s.section_id, m.metric, s.subject_id from sections s cross join (select distinct metric from records) m left join records r on r.section_id=s.section_id and r.metric=m.metric where r.section_id is null)"


@query("ML_16_missing_policies", ["sections", "records"], f"with {_MISSING} select metric, count(*) as records, count(distinct subject_id) as subjects from records r where not exists (select 1 from ms where ms.metric=r.metric and ms.subject_id=r.subject_id) group by metric")
def ml_16(t: Tables) -> DataFrame:
    usable, _ = study.complete_records(t.records, study.missing_sections(t.records, t.sections, t.records), "complete_subjects")
    return usable.groupBy("metric").agg(F.count("*").alias("records"), F.count_distinct("subject_id").alias("subjects"))


_T_OUT = "effect", "standard_error", "statistic", "degrees_of_freedom"


@query("ML_13_welch", ["records"], """with s as (select subject_id, condition, metric, avg(value) as v from records group by 1,2,3), a as (select metric, count(case when condition='control' then v end) as n0, count(case when condition='case' then v end) as n1, avg(case when condition='control' then v end) as m0, avg(case when condition='case' then v end) as m1,
    var_samp(case when condition='control' then v end) as s0, var_samp(case when condition='case' then v end) as s1 from s group by 1)
    select metric, n0, n1, round(m1-m0,8) as effect, round(sqrt(s0/n0+s1/n1),8) as standard_error, round((m1-m0)/sqrt(s0/n0+s1/n1),8) as statistic, round((s0/n0+s1/n1)*(s0/n0+s1/n1)/((s0/n0)*(s0/n0)/(n0-1)+(s1/n1)*(s1/n1)/(n1-1)),6) as degrees_of_freedom from a""")
def ml_13(t: Tables) -> DataFrame:
    out = study.welch(t.records, "control", "case").select("metric", "n0", "n1", *_T_OUT)
    return rounded(rounded(out, "effect", "standard_error", "statistic"), "degrees_of_freedom", digits=6)


# The tail as an integral: x = |t| + u/(1-u) maps it to 0..1, by Simpson's rule.
@query("FN_16_t_distribution", ["records"], f"""with s as (select subject_id, condition, metric, avg(value) as v from records group by 1,2,3), a as (select metric, count(case when condition='control' then v end) as n0, count(case when condition='case' then v end) as n1, avg(case when condition='control' then v end) as m0, avg(case when condition='case' then v end) as m1,
    var_samp(case when condition='control' then v end)/count(case when condition='control' then v end) as a, var_samp(case when condition='case' then v end)/count(case when condition='case' then v end) as b from s group by 1),
    w as (select metric, abs(m1-m0)/sqrt(a+b) as t, (a+b)*(a+b)/(a*a/(n0-1)+b*b/(n1-1)) as df from a),
    f as (select metric, k, case when k=20000 then 0 else exp(lgamma((df+1)/2)-lgamma(df/2))/sqrt(df*pi())*power(1+power(t+(k/20000.0::double)/(1-k/20000.0::double),2)/df,-(df+1)/2)/power(1-k/20000.0::double,2) end as y from w, range(0,20001) r(k)),
    r as (select metric, 2*sum(y*case when k in (0,20000) then 1 when k%2=1 then 4 else 2 end)/60000 as p_value from f group by 1), {_bh_sql('r')}
    select metric, round(p_value,7) as p_value, round(q_value,7) as q_value, 0.05::double as tail_at_bounds, 'tested' as status from bh""")
def fn_16(t: Tables) -> DataFrame:
    from ..functions.distributions import t_p_value
    out = study.welch(t.records, "control", "case")
    bound = (F.col("ci_high") - F.col("ci_low")) / 2 / F.col("standard_error")
    return rounded(out.select("metric", "p_value", "q_value", t_p_value(bound, F.col("degrees_of_freedom")).alias("tail_at_bounds"), "status"), "p_value", "q_value", "tail_at_bounds", digits=7)


@query("ML_14_paired_t", (), """with paired as (select user_id as subject_id, case when d<=15 then 'control' else 'case' end as condition, event_type as metric, value
        from (select user_id, extract(day from ts) as d, event_type, avg(value) as value from events group by 1,2,3) e where event_type='click' or d%2=0), s as (select subject_id, metric, avg(case when condition='control' then value end) as v0, avg(case when condition='case' then value end) as v1 from paired group by 1,2), k as (select * from s where subject_id not in (select subject_id from s where v0 is null or v1 is null)),
    a as (select metric, count(*) as n0, avg(v1-v0) as d, stddev_samp(v1-v0) as sd from k group by 1)
    select metric, n0, n0 as n1, case when metric='click' then 'several_batches_need_a_mixed_model' end as reason, case when metric<>'click' then round(d,8) end as effect, case when metric<>'click' then round(sd/sqrt(n0),8) end as standard_error,
    case when metric<>'click' then round(d/(sd/sqrt(n0)),8) end as statistic, case when metric<>'click' then (n0-1)::double end as degrees_of_freedom from a""")
def ml_14(t: Tables) -> DataFrame:
    """One batch for all metrics but one, which is refused and keeps its row."""
    records = t.paired_records.filter("metric = 'click' or batch = 'b0'")
    arms = records.groupBy("subject_id", "metric").agg(F.count_distinct("condition").alias("k"))
    broken = arms.filter("k < 2").select("subject_id").distinct()
    out = study.paired_t(records.join(broken, "subject_id", "left_anti"), "control", "case")
    return rounded(out.select("metric", "n0", "n1", "reason", *_T_OUT), "effect", "standard_error", "statistic")


@query("ML_15_mixed_model")
def ml_15(t: Tables) -> DataFrame:
    return study.mixed_model(t.paired_records, "control", "case", ["b0", "b1"])


@query("FN_17_normal_distribution", (), """with z as (select p_partkey, abs((p_size-25)/10.0::double) as z from part), d as (select distinct z from z),
    p as (select z, 1-2*sum(exp(-power(z*k/2000,2)/2)*case when k in (0,2000) then 1 when k%2=1 then 4 else 2 end)*z/6000/sqrt(2*pi()) as p from d, range(0,2001) r(k) group by z)
    select p_partkey, round(p,8) as p_value, 0.05::double as tail_at_quantile from z join p using (z)""")
def fn_17(t: Tables) -> DataFrame:
    from ..functions.distributions import normal_p_value, normal_quantile
    z = ((F.col("p_size") - 25) / 10.0).cast("double")
    out = t.raw("part").select("p_partkey", normal_p_value(z).alias("p_value"), normal_p_value(F.lit(normal_quantile(0.975))).alias("tail_at_quantile"))
    return rounded(out, "p_value", "tail_at_quantile")


@query("ML_15_mixed_model_covariates")
def ml_15_covariates(t: Tables) -> DataFrame:
    return study.mixed_model(t.paired_records, "control", "case", ["b0", "b1"], covariates=["day"]).select("metric", "z", "p_value", "q_value", "ci_low", "ci_high", "status", "reason")
