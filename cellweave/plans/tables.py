"""Spatial-omics tables derived from the test star schema, once for Spark and once as portable SQL."""
from __future__ import annotations

from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.predicates import attribute
from ..operators import atlas, filters, revisions
from ..session import ensure_checkpoint_dir

ROI = [(100.0, 100.0), (600.0, 80.0), (700.0, 500.0), (350.0, 700.0), (90.0, 450.0)]
WINDOW = (0.0, 0.0, 1008.0, 996.0)
VIEW = (200.0, 200.0, 520.0, 480.0)
SOURCE, TARGET = "BUILDING", "MACHINERY"
PROGRAM_A = [f"Brand#{i}" for i in (11, 12, 13, 14, 15)]
PROGRAM_B = [f"Brand#{i}" for i in (21, 22, 23, 24, 25)]
GENES = ["Brand#11", "Brand#23", "Brand#45", "Brand#55"]
FIELDS = ["qc", "transcript_counts", "cell_area"]


_ATLASES: dict[tuple[str, str], atlas.Atlas] = {}  # one stored atlas per session and input


class Tables:
    """Lazily derived DataFrames over one directory of parquet files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.live: DataFrame | None = None  # set by the first statistic that needs it

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def cells(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("cell_id"), ((key * 7919) % 1009).cast("double").alias("x"), ((key * 104729) % 997).cast("double").alias("y"),
            F.col("c_mktsegment").alias("label"), (F.col("c_acctbal") >= 0).alias("included"),
            F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("region"), F.col("c_acctbal").alias("qc_balance"))

    @cached_property
    def slices(self) -> DataFrame:
        """The declared slice of the cells and its unit."""
        return self.cells.limit(1).select(F.lit("slice-1").alias("slice_id"), F.lit("micrometer").alias("units"))

    @cached_property
    def features(self) -> DataFrame:
        return self.raw("part").select(F.col("p_brand").alias("feature_id"), F.col("p_brand").alias("symbol")).distinct()

    @cached_property
    def _lines(self) -> DataFrame:
        return (self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")))

    @cached_property
    def counts(self) -> DataFrame:
        return self._lines.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))

    @cached_property
    def protein(self) -> DataFrame:
        return (self._lines.filter(F.col("o_custkey") % 3 != 0)
                .groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_type").alias("feature_id")).agg(F.sum("l_extendedprice").alias("value")))

    @cached_property
    def transcripts(self) -> DataFrame:
        text = lambda c: F.col(c).cast("string")
        molecule = F.md5(F.concat_ws("|", text("l_orderkey"), text("l_partkey"), text("l_suppkey"), text("l_linenumber"),
                                     F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
                                     F.col("l_shipdate").cast("date").cast("string")))
        owned = self.raw("orders").join(self.cells, F.col("o_custkey") == F.col("cell_id"))  # before the lines, which are shuffled once less
        lines = self.raw("lineitem").join(owned, F.col("l_orderkey") == F.col("o_orderkey")).join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select(
            molecule.alias("id"), F.col("p_brand").alias("feature"), "cell_id", (F.col("x") + (F.col("l_linenumber") - 4) * 0.25).alias("x"),
            (F.col("y") + (F.col("l_orderkey") % 7 - 3) * 0.25).alias("y"), (F.col("l_discount") * 100).alias("qv"))

    @cached_property
    def vertices(self) -> DataFrame:
        corners = F.array(*[F.struct(F.lit(i).alias("vertex"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)])])
        kinds = F.array(F.struct(F.lit("cell").alias("kind"), F.lit(0.4).alias("h")), F.struct(F.lit("nucleus").alias("kind"), F.lit(0.2).alias("h")))
        v = self.cells.select("cell_id", "x", "y", F.explode(kinds).alias("k")).select("*", F.explode(corners).alias("v"))
        return v.select(F.concat_ws("-", F.col("cell_id").cast("string"), "k.kind").alias("boundary_id"), "cell_id", "k.kind", "v.vertex",
                        (F.col("x") + F.col("v.a") * F.col("k.h")).alias("x"), (F.col("y") + F.col("v.b") * F.col("k.h")).alias("y"))

    @property
    def atlas(self) -> atlas.Atlas:
        """The stored atlas of this input; its tables are written into the shared folder when they are first asked for."""
        key = (self.spark.sparkContext.applicationId, self.path)
        if key not in _ATLASES:
            ensure_checkpoint_dir(self.spark)
            folder = f"{self.spark.sparkContext.getCheckpointDir()}/atlas-{uuid4().hex}"
            _ATLASES[key] = atlas.Atlas(folder, self.cells, self.counts, self.transcripts, self.vertices, WINDOW)
        return _ATLASES[key]

    @cached_property
    def overlays(self) -> DataFrame:
        hit = (F.col("label") == SOURCE) & F.col("region").isin("n3", "n4", "n5")
        r1 = self.cells.filter(hit).select(F.lit("r1").alias("revision_id"), "cell_id", F.lit(TARGET).alias("label"), F.lit(None).cast("boolean").alias("included"))
        r2 = self.cells.filter(hit | (F.col("region") == "n7")).select(
            F.lit("r2").alias("revision_id"), "cell_id", F.when(hit, TARGET).alias("label"), F.when(F.col("region") == "n7", False).alias("included"))
        return r1.unionByName(r2)

    def at(self, revision: str | None) -> DataFrame:
        return revisions.materialise(self.cells, self.overlays, revision)

    @cached_property
    def roi(self) -> DataFrame:
        return filters.select_polygon(self.cells, ROI).select("cell_id")

    def _supplier_rings(self, corners: list[tuple[str, str]]) -> DataFrame:
        """One ring per supplier around a place of its own, corners as expressions of its reach ``s`` (an even number)."""
        k = F.col("s_suppkey")
        placed = self.raw("supplier").select(k.alias("polygon_id"), ((k * 7919) % 1009).cast("double").alias("cx"), ((k * 104729) % 997).cast("double").alias("cy"),
                                             (F.lit(20.0) + 2 * (k % 60)).alias("s"))
        return placed.select("polygon_id", F.array(*[F.struct((F.col("cx") + F.expr(a)).alias("x"), (F.col("cy") + F.expr(b)).alias("y")) for a, b in corners]).alias("ring"))

    @cached_property
    def arrows(self) -> DataFrame:
        """A concave polygon per supplier."""
        return self._supplier_rings([("0", "-s"), ("s", "s"), ("0", "s/2"), ("-s", "s")])

    @cached_property
    def diamonds(self) -> DataFrame:
        """The points within a walking distance ``s`` of each supplier's place."""
        return self._supplier_rings([("0", "-s"), ("s", "0"), ("0", "s"), ("-s", "0")])

    @cached_property
    def with_attributes(self) -> DataFrame:
        """Cells with typed attributes that mix absent, null, text, boolean and numeric values."""
        k, bal = F.col("cell_id"), F.col("qc_balance")
        qc = (F.when(k % 6 == 1, attribute(None, "null")).when(k % 6 == 2, attribute(F.floor(bal / 1000).cast("string"), "str"))
              .when(k % 6 == 3, attribute(bal > 5000, "bool")).when(k % 6 >= 4, attribute(F.floor(bal / 1000), "num")))
        transcripts = attribute(F.floor(F.abs(bal)), "num")
        method = (F.when(k % 5 == 1, attribute(None, "null")).when(k % 5 == 2, attribute(bal, "num")).when(k % 5 >= 3, attribute(F.col("region"), "str")))
        entries = F.array_compact(F.array(
            F.when(k % 6 != 0, F.struct(F.lit("qc").alias("key"), qc.alias("value"))),
            F.struct(F.lit("transcript_counts").alias("key"), transcripts.alias("value")),
            F.when(k % 5 != 0, F.struct(F.lit("segmentation_method").alias("key"), method.alias("value")))))
        return self.cells.withColumn("attributes", F.map_from_entries(entries))

    @cached_property
    def records(self) -> DataFrame:
        e = self.raw("events").select("user_id", "event_type", "value", F.floor((F.dayofmonth("ts") - 1) / 8).cast("int").alias("w"))
        return e.groupBy("user_id", "w", "event_type").agg(F.avg("value").alias("value")).select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.col("w").cast("string")).alias("section_id"), F.col("user_id").alias("subject_id"),
            F.when(F.col("user_id") % 2 == 0, "control").otherwise("case").alias("condition"), F.col("event_type").alias("metric"), "value")

    @cached_property
    def sections(self) -> DataFrame:
        """Declared sections: every section any metric was recorded for."""
        return self.records.select("section_id", "subject_id", "condition").distinct().withColumns({
            "roi_class": F.lit("all"), "sample_id": F.col("section_id"), "roi_origin": F.lit("prespecified"), "batch": F.lit("b0")})

    @cached_property
    def paired_records(self) -> DataFrame:
        """Both arms per user: first and second half of the month, recorded per day."""
        e = self.raw("events").select("user_id", "event_type", "value", F.dayofmonth("ts").alias("d"))
        return e.groupBy("user_id", "d", "event_type").agg(F.avg("value").alias("value")).select(
            F.col("user_id").alias("subject_id"), F.when(F.col("d") <= 15, "control").otherwise("case").alias("condition"),
            F.col("event_type").alias("metric"), "value", F.when(F.col("d") % 2 == 0, "b0").otherwise("b1").alias("batch"), F.col("d").cast("double").alias("day"))

    @cached_property
    def lr_pairs(self) -> DataFrame:
        a, brand = F.col("a"), lambda c: F.concat(F.lit("Brand#"), c.cast("string"))
        sizes = self.raw("part").filter(F.col("p_size").between(1, 20)).select(F.col("p_size").alias("a")).distinct()
        return sizes.select(brand(a).alias("ligand"), F.when(a % 5 == 0, F.concat_ws("_", brand(a + 1), brand(a + 2))).when(a == 7, "Brand#99").otherwise(brand(a + 1)).alias("receptor"))

    @cached_property
    def pathway_net(self) -> DataFrame:
        return self.raw("part").groupBy(F.col("p_type").alias("source"), F.col("p_brand").alias("target")).agg((F.avg("p_size") - 25.5).alias("weight"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("batch"))


def scratch(t: Tables) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/export-{uuid4().hex}"


_EDGES = ", ".join(f"({a[0]}::double,{a[1]}::double,{b[0]}::double,{b[1]}::double)" for a, b in zip(ROI, ROI[1:] + ROI[:1]))
_HIT = "label='BUILDING' and region in ('n3','n4','n5')"

# name -> (names it builds on, SELECT text)
SQL_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "cells": ((), """select c_custkey as cell_id, cast((c_custkey*7919)%1009 as double) as x, cast((c_custkey*104729)%997 as double) as y,
        c_mktsegment as label, c_acctbal>=0 as included, concat('n', cast(c_nationkey as varchar)) as region, c_acctbal as qc_balance from customer"""),
    "features": ((), "select distinct p_brand as feature_id, p_brand as symbol from part"),
    "counts": ((), """select o.o_custkey as cell_id, p.p_brand as feature_id, sum(l.l_quantity) as value
        from lineitem l join orders o on l.l_orderkey=o.o_orderkey join part p on l.l_partkey=p.p_partkey group by o.o_custkey, p.p_brand"""),
    "protein": ((), """select o.o_custkey as cell_id, p.p_type as feature_id, sum(l.l_extendedprice) as value
        from lineitem l join orders o on l.l_orderkey=o.o_orderkey join part p on l.l_partkey=p.p_partkey
        where o.o_custkey%3<>0 group by o.o_custkey, p.p_type"""),
    "transcripts": (("cells",), """select md5(concat(cast(l.l_orderkey as varchar),'|',cast(l.l_partkey as varchar),'|',cast(l.l_suppkey as varchar),'|',
        cast(l.l_linenumber as varchar),'|',cast(cast(l.l_quantity as int) as varchar),'|',cast(cast(round(l.l_extendedprice*100) as bigint) as varchar),'|',
        cast(cast(l.l_shipdate as date) as varchar))) as id, p.p_brand as feature, c.cell_id, c.x+(l.l_linenumber-4)*0.25 as x,
        c.y+(l.l_orderkey%7-3)*0.25 as y, l.l_discount*100 as qv
        from lineitem l join orders o on l.l_orderkey=o.o_orderkey join cells c on c.cell_id=o.o_custkey join part p on l.l_partkey=p.p_partkey"""),
    "vertices": (("cells",), """select concat(cast(cell_id as varchar),'-',kind) as boundary_id, cell_id, kind, vertex, x+a*h as x, y+b*h as y
        from cells, (values ('cell',0.4::double),('nucleus',0.2::double)) k(kind,h), (values (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1)) v(vertex,a,b)"""),
    "overlays": (("cells",), f"""select 'r1' as revision_id, cell_id, 'MACHINERY' as label, cast(null as boolean) as included from cells where {_HIT}
        union all select 'r2', cell_id, case when {_HIT} then 'MACHINERY' end, case when region='n7' then false end from cells where ({_HIT}) or region='n7'"""),
    "cells_r0": (("cells",), "select * from cells"),
    "cells_r2": (("cells", "overlays"), """select c.cell_id, c.x, c.y, coalesce(o.label,c.label) as label, coalesce(o.included,c.included) as included, c.region, c.qc_balance
        from cells c left join (select * from overlays where revision_id='r2') o on o.cell_id=c.cell_id"""),
    "cells_r1": (("cells", "overlays"), """select c.cell_id, c.x, c.y, coalesce(o.label,c.label) as label, coalesce(o.included,c.included) as included, c.region, c.qc_balance
        from cells c left join (select * from overlays where revision_id='r1') o on o.cell_id=c.cell_id"""),
    "roi": (("cells",), f"""select cell_id from cells, (values {_EDGES}) e(ax,ay,ex,ey) group by cell_id
        having bool_or(abs((ex-ax)*(y-ay)-(ey-ay)*(x-ax)) <= 1e-10*greatest(1,abs(ex-ax),abs(ey-ay))
            and x between least(ax,ex)-1e-7 and greatest(ax,ex)+1e-7 and y between least(ay,ey)-1e-7 and greatest(ay,ey)+1e-7)
        or sum(case when (ay>y)<>(ey>y) and x < (ex-ax)*(y-ay)/(ey-ay)+ax then 1 else 0 end)%2=1"""),
    "places": ((), """select s_suppkey as polygon_id, cast((s_suppkey*7919)%1009 as double) as cx, cast((s_suppkey*104729)%997 as double) as cy,
        cast(20+2*(s_suppkey%60) as double) as s from supplier"""),
    "arrow_edges": (("places",), """select polygon_id, cx+a*s as ax, cy+b*s as ay, cx+c*s as ex, cy+d*s as ey from places,
        (values (0,-1,1,1),(1,1,0,0.5),(0,0.5,-1,1),(-1,1,0,-1)) v(a,b,c,d)"""),
    "attrs": (("cells",), """select cell_id, 'qc' as field, case when cell_id%6=0 then 'absent' when cell_id%6=1 then 'null' when cell_id%6=2 then 'str' when cell_id%6=3 then 'bool' else 'num' end as kind,
        case when cell_id%6>=4 then floor(qc_balance/1000) end as num, case when cell_id%6=2 then cast(cast(floor(qc_balance/1000) as bigint) as varchar) end as str from cells
        union all select cell_id, 'transcript_counts', 'num', floor(abs(qc_balance)), null from cells
        union all select cell_id, 'cell_area', 'absent', null, null from cells
        union all select cell_id, 'segmentation_method', case when cell_id%5=0 then 'absent' when cell_id%5=1 then 'null' when cell_id%5=2 then 'num' else 'str' end,
            case when cell_id%5=2 then qc_balance end, case when cell_id%5>=3 then region end from cells"""),
    "records": ((), """select concat(cast(user_id as varchar),'-',cast(w as varchar)) as section_id, user_id as subject_id,
        case when user_id%2=0 then 'control' else 'case' end as condition, event_type as metric, avg(value) as value
        from (select user_id, event_type, value, cast(floor((extract(day from ts)-1)/8) as int) as w from events) e group by user_id, w, event_type"""),
    "sections": (("records",), "select distinct section_id, subject_id, condition from records"),
    "paired": ((), """select user_id as subject_id, case when d<=15 then 'control' else 'case' end as condition, event_type as metric, value
        from (select user_id, extract(day from ts) as d, event_type, avg(value) as value from events group by 1,2,3) e"""),
    "lr_pairs": ((), """select distinct concat('Brand#',cast(a as varchar)) as ligand,
        case when a%5=0 then concat('Brand#',cast(a+1 as varchar),'_Brand#',cast(a+2 as varchar)) when a=7 then 'Brand#99' else concat('Brand#',cast(a+1 as varchar)) end as receptor
        from (select distinct p_size as a from part where p_size between 1 and 20) t"""),
    "pathway_net": ((), "select p_type as source, p_brand as target, avg(p_size)-25.5 as weight from part group by p_type, p_brand"),
    "libs": (("cells", "counts"), "select c.cell_id, coalesce(sum(k.value),0) as library, count(case when k.value>0 then 1 end) as detected from cells c left join counts k on k.cell_id=c.cell_id group by c.cell_id"),
    "live": (("cells", "libs"), "select c.* from cells c join libs l using (cell_id) where c.included and l.library>0"),
    "norm": (("live", "libs", "counts"), "select k.cell_id, k.feature_id, ln(1+k.value*(10000.0::double/l.library)) as value from counts k join libs l using (cell_id) join live using (cell_id) where k.value>0"),
    "knn6": (("live",), """select src, dst, dist from (select a.cell_id as src, b.cell_id as dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as dist,
        row_number() over (partition by a.cell_id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) as rk
        from live a join live b on a.cell_id<>b.cell_id) where rk<=6"""),
    "kernel6": (("knn6",), "select k.src, k.dst, k.dist, s.sigma, exp(-0.5*(k.dist/s.sigma)*(k.dist/s.sigma)) as w from knn6 k join (select src, median(dist) as sigma from knn6 group by src) s using (src)"),
    "graph6": (("kernel6",), "select src, dst, max(w) as w from (select src, dst, w from kernel6 union all select dst, src, w from kernel6) group by src, dst"),
    "row_graph6": (("kernel6",), "select src, dst, w/sum(w) over (partition by src) as w from kernel6"),
}


def sql_with(needs: tuple[str, ...] | list[str], body: str) -> str:
    """Prefix a statement with the table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for dep in SQL_TABLES[name][0]:
                add(dep)
            ordered.append(name)

    for n in needs:
        add(n)
    parts = [f"{n} as ({SQL_TABLES[n][1]})" for n in ordered]
    text = body.strip()
    if text.lower().startswith("with "):
        parts, text = parts + [text[5:].strip()], ""
        return "with " + ",\n".join(parts)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + text
