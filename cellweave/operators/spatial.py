"""Distance joins: inclusive radius pairs and exact k nearest neighbours.

Spark plans a distance predicate as a nested-loop join. Both joins here are rewritten as
equi-joins on grid tiles, so they shuffle on the tile key and stay linear in the number of
candidate pairs; AQE splits a tile whose partition turns out to be skewed.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import gaussian_kernel
from ..session import materialise

BLOCK = 2048  # rows of a part of a tile, on each side of a radius join
TASK_PAIRS = 2_000_000  # pairs of rows that a task of a radius join looks at, about
MOST_TASKS = 4096
_SLACK = 1e-9  # tiles are a hair wider than the radius so rounding cannot hide an inclusive neighbour


def _neighbour_tiles(tx: Column, ty: Column) -> Column:
    offsets = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.array(*[F.struct((tx + i).alias("tx"), (ty + j).alias("ty")) for i, j in offsets])


def tile_index(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side)).cast("bigint")


def radius_join(left: DataFrame, right: DataFrame, radius: float, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """All (left, right) rows at distance <= radius; both need x, y and disjoint other columns.

    The left side (usually the smaller one: the sources) is copied to its 3x3 tiles. ``by`` adds
    equality keys such as a slice id. Column ``d2`` is the squared distance. The rows are few beside their
    pairs, so pairs decide how they are dealt: both sides of a tile are cut to parts of about ``block`` rows that meet
    each other, over as many tasks as the pairs need.
    """
    side = float(radius) * (1 + _SLACK)
    probes = (left.withColumnsRenamed({"x": "_lx", "y": "_ly"})
              .withColumn("_t", F.explode(_neighbour_tiles(tile_index(F.col("_lx"), side), tile_index(F.col("_ly"), side))))
              .withColumns({"_tx": F.col("_t.tx"), "_ty": F.col("_t.ty")}).drop("_t"))
    points = (right.withColumnsRenamed({"x": "_rx", "y": "_ry"})
              .withColumns({"_tx": tile_index(F.col("_rx"), side), "_ty": tile_index(F.col("_ry"), side)}))
    tile = [*by, "_tx", "_ty"]
    sizes = materialise(probes.groupBy(*tile).agg(F.count("*").alias("_ln")).join(points.groupBy(*tile).agg(F.count("*").alias("_rn")), tile))
    pairs = sizes.agg(F.sum(F.col("_ln").cast("double") * F.col("_rn"))).first()[0] or 0
    tasks = min(MOST_TASKS, math.ceil(pairs / TASK_PAIRS) or 1)
    parts = sizes.select(*tile, F.ceil(F.col("_ln") / block).alias("_lc"), F.ceil(F.col("_rn") / block).alias("_rc"))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)

    def own(rows: DataFrame, n: str) -> Column:
        return F.array(F.pmod(F.xxhash64(*rows.columns), F.col(n)))

    def dealt(rows: DataFrame, lp: Column, rp: Column) -> DataFrame:
        return rows.join(parts, tile).withColumn("_lp", F.explode(lp)).withColumn("_rp", F.explode(rp)).drop("_lc", "_rc").repartition(tasks, *tile, "_lp", "_rp")

    dx, dy = F.col("_lx") - F.col("_rx"), F.col("_ly") - F.col("_ry")
    return (dealt(probes, own(probes, "_lc"), every("_rc")).join(dealt(points, every("_lc"), own(points, "_rc")).hint("merge"), [*tile, "_lp", "_rp"])
            .withColumn("d2", dx * dx + dy * dy)
            .filter(F.col("d2") <= float(radius) ** 2)
            .drop("_tx", "_ty", "_lp", "_rp", "_lx", "_ly", "_rx", "_ry"))


def radius_edges(sources: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """Directed edges source -> node at distance <= radius, self excluded by id (coincident cells count)."""
    left = sources.select(F.col("cell_id").alias("src"), "x", "y")
    right = nodes.select(F.col("cell_id").alias("dst"), "x", "y")
    return (radius_join(left, right, radius).filter(F.col("src") != F.col("dst"))
            .select("src", "dst", F.sqrt("d2").alias("dist")))


def scoped_nodes(cells: DataFrame, roi: DataFrame | None, scope: str) -> tuple[DataFrame, DataFrame]:
    """(sources candidates, nodes): included cells in the ROI, and the graph's node set under a scope."""
    active = cells.filter("included")
    inside = active if roi is None else active.join(roi.select("cell_id"), "cell_id", "left_semi")
    if scope not in ("whole_slice", "roi_induced"):
        raise ValueError("scope must be whole_slice or roi_induced")
    return inside, (active if scope == "whole_slice" else inside)


# --- k nearest ---------------------------------------------------------------------------------

def _box(points: DataFrame, dims: Sequence[str]) -> tuple[float, float, float, int]:
    a, b = dims[0], dims[1]
    row = points.agg(F.min(a).alias("a0"), F.min(b).alias("b0"), F.max(a).alias("a1"), F.max(b).alias("b1"),
                     F.count("*").alias("n")).first()
    if not row["n"]:
        return 0.0, 0.0, 1.0, 0
    extent = max(row["a1"] - row["a0"], row["b1"] - row["b0"])
    return row["a0"], row["b0"], (extent * (1 + _SLACK) if extent > 0 else 1.0), row["n"]


def _levels(cand: DataFrame, k: int, base: int, deepest: int) -> DataFrame:
    """Finest quadtree level at which each tile still holds k+1 points, per base or deep tile.

    Counts are rolled up from pre-aggregated tiles; only crowded base tiles are refined further, so a
    region holding a large share of all rows gets small tiles and everything else stays coarse.
    """
    need = k + 1

    def up(level: Column, finest: int) -> list[Column]:
        shift = (F.lit(finest) - level).cast("int")
        return [F.call_function("shiftright", F.col("_fx"), shift).alias("_cx"),
                F.call_function("shiftright", F.col("_fy"), shift).alias("_cy")]

    at_base = cand.select(F.shiftright("_fx", deepest - base).alias("_bx"), F.shiftright("_fy", deepest - base).alias("_by"), "_fx", "_fy")
    base_tiles = at_base.groupBy("_bx", "_by").agg(F.count("*").alias("n"))
    crowded = base_tiles.filter(F.col("n") > 4 * need).select("_bx", "_by")
    fine_tiles = at_base.join(crowded, ["_bx", "_by"]).groupBy("_fx", "_fy").agg(F.count("*").alias("n"))
    coarse = (base_tiles.select(F.col("_bx").alias("_fx"), F.col("_by").alias("_fy"), "n")
              .withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(base)))))
    fine = fine_tiles.withColumn("_lv", F.explode(F.sequence(F.lit(min(base + 1, deepest)), F.lit(deepest))))
    coarse = coarse.select("_fx", "_fy", "n", "_lv", *up(F.col("_lv"), base))
    fine = fine.select("_fx", "_fy", "n", "_lv", *up(F.col("_lv"), deepest))
    dense = (coarse.select("_lv", "_cx", "_cy", "n").unionByName(fine.select("_lv", "_cx", "_cy", "n"))
             .groupBy("_lv", "_cx", "_cy").agg(F.sum("n").alias("t")).filter(F.col("t") >= need).drop("t"))
    keys = ["_lv", "_cx", "_cy"]
    base_level = coarse.join(dense, keys).groupBy("_fx", "_fy").agg(F.max("_lv").alias("_base_level"))
    fine_level = fine.join(dense, keys).groupBy("_fx", "_fy").agg(F.max("_lv").alias("_fine_level"))
    base_level = base_level.withColumnsRenamed({"_fx": "_bx", "_fy": "_by"})
    return (cand.withColumns({"_bx": F.shiftright("_fx", deepest - base), "_by": F.shiftright("_fy", deepest - base)})
            .join(base_level, ["_bx", "_by"]).join(fine_level, ["_fx", "_fy"], "left")
            .withColumn("_lv", F.coalesce("_fine_level", "_base_level"))
            .drop("_bx", "_by", "_base_level", "_fine_level"))


def knn(points: DataFrame, k: int, dims: Sequence[str] = ("x", "y"), id_col: str = "cell_id") -> DataFrame:
    """Exact k nearest other points: (src, dst, dist, rank); ties go to the smaller id.

    Each round searches the 3x3 tiles of a point's grid level and settles the points whose block provably
    contains the ball around their k-th hit; the others retry on tiles at least that radius wide (or one
    level up when fewer than k points were seen). Evenly spread data start at one level; where a tile is
    crowded, every tile gets its own level first. With more than two dimensions the first two carry the
    tiles (a projected distance never exceeds the full one) and the full distance ranks.
    """
    dims = list(dims)
    points = materialise(points.select(id_col, *dims))  # read by every round
    a0, b0, extent, n = _box(points, dims)
    k = min(k, n - 1)
    id_type = points.schema[id_col].dataType.simpleString()
    if k < 1:
        return points.sparkSession.createDataFrame([], f"src {id_type}, dst {id_type}, dist double, rank int")
    base = max(0, math.floor(math.log(max(n / (k + 1), 1), 4))) + 1
    deepest = min(28, base + 12)
    fine = extent / 2**deepest
    last = F.lit(2**deepest - 1)
    gridded = points.select(F.col(id_col).alias("_id"), *dims).withColumns({
        "_fx": F.least(F.floor((F.col(dims[0]) - a0) / fine), last).cast("bigint"),
        "_fy": F.least(F.floor((F.col(dims[1]) - b0) / fine), last).cast("bigint")})
    # Of coincident points only the k+1 smallest ids can ever be among somebody's k nearest.
    copies = W.partitionBy(*dims).orderBy("_id")
    cand = gridded.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= k + 1).drop("_c")
    crowd = (cand.groupBy(F.shiftright("_fx", deepest - base), F.shiftright("_fy", deepest - base)).count()
             .agg(F.max("count")).first()[0])
    if crowd <= 32 * (k + 1):
        asked, used = gridded.withColumn("_lv", F.lit(base)), [base]
    else:
        levelled = _levels(cand, k, base, deepest).select("_fx", "_fy", "_lv").distinct()
        asked = materialise(gridded.join(levelled, ["_fx", "_fy"]))
        used = _levels_in(asked)

    renamed = {d: f"_r{i}" for i, d in enumerate(dims)}
    targets = cand.select(F.col("_id").alias("dst"), *[F.col(d).alias(r) for d, r in renamed.items()], "_fx", "_fy")
    shift = (F.lit(deepest) - F.col("_lv")).cast("int")
    cx, cy = F.call_function("shiftright", F.col("_fx"), shift), F.call_function("shiftright", F.col("_fy"), shift)
    d2 = F.lit(0.0)
    for d, r in renamed.items():
        d2 = d2 + (F.col(d) - F.col(r)) * (F.col(d) - F.col(r))
    side = F.lit(extent) / F.pow(F.lit(2.0), F.col("_lv"))
    u, v = F.col(dims[0]) - a0, F.col(dims[1]) - b0
    margin = F.least(u - (cx - 1) * side, (cx + 2) * side - u, v - (cy - 1) * side, (cy + 2) * side - v) - extent * _SLACK
    margin = F.when(F.col("_lv") == 0, F.lit(float("inf"))).otherwise(margin)

    def search(asked: DataFrame, used: list[int]) -> DataFrame:
        probes = (asked.withColumn("_margin", margin).withColumn("_t", F.explode(_neighbour_tiles(cx, cy)))
                  .withColumns({"_tx": F.col("_t.tx"), "_ty": F.col("_t.ty")}).drop("_t", "_fx", "_fy"))
        tiles = (targets.withColumn("_lv", F.explode(F.array(*[F.lit(v).cast("int") for v in used])))
                 .withColumns({"_tx": cx, "_ty": cy}).drop("_fx", "_fy"))
        near = (probes.join(tiles, ["_lv", "_tx", "_ty"]).filter(F.col("_id") != F.col("dst"))
                .withColumn("_d2", d2)
                .withColumn("rank", F.row_number().over(W.partitionBy("_id").orderBy("_d2", "dst")))
                .filter(F.col("rank") <= k))
        per_point = W.partitionBy("_id")
        near = near.withColumns({"_seen": F.count("*").over(per_point), "_r": F.sqrt(F.max("_d2").over(per_point))})
        done = (F.col("_seen") == k) & (F.col("_r") <= F.col("_margin"))
        return materialise(near.select("_id", "dst", "_d2", "rank", "_seen", "_r", done.alias("_done")))

    rounds = []
    while used:
        near = search(asked, used)
        rounds.append(near.filter("_done").select(F.col("_id").alias("src"), "dst", F.sqrt("_d2").alias("dist"), "rank"))
        seen = near.filter(F.col("rank") == 1).select("_id", "_done", F.when(F.col("_seen") == k, F.col("_r")).alias("_r"))
        wide = F.floor(F.log2(F.lit(extent) / (F.col("_r") * (1 + 1e-6) + extent * 1e-12))).cast("int")
        asked = materialise(
            asked.join(seen, "_id", "left").filter(F.expr("not coalesce(_done, false)"))
            .withColumn("_lv", F.greatest(F.lit(0), F.least(F.col("_lv") - 1, F.coalesce(wide, F.col("_lv") - 1)))).drop("_done", "_r"))
        used = _levels_in(asked)
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionByName(part)
    return out


def _levels_in(asked: DataFrame) -> list[int]:
    return [r[0] for r in asked.select("_lv").distinct().collect()]  # at most 29 small integers


# --- weighted neighbour graphs -------------------------------------------------------------------

def _kernel_edges(points: DataFrame, k: int, still: float | None) -> DataFrame:
    """(src, dst, w): kernel on the k nearest with the median of their distances; ``still`` replaces a bandwidth of zero."""
    edges = knn(points, k)
    bandwidth = edges.groupBy("src").agg(F.median("dist").alias("sigma"))
    sigma = F.col("sigma") if still is None else F.when(F.col("sigma") <= 1e-12, F.lit(still)).otherwise(F.col("sigma"))
    return edges.join(bandwidth, "src").select("src", "dst", gaussian_kernel(F.col("dist"), sigma).alias("w"))


def adaptive_graph(points: DataFrame, k: int = 6, still: float | None = None) -> DataFrame:
    """Symmetric adaptive Gaussian graph (src, dst, w): kernel on k nearest, symmetrised by the maximum.

    Points that lie on most of their neighbours have a bandwidth of zero: their weights are 0 and NaN, unless ``still`` stands for it.
    """
    w = _kernel_edges(points, k, still)
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def row_stochastic_graph(points: DataFrame, k: int = 6, still: float = 1.0) -> DataFrame:
    """Row-normalised, not symmetrised kernel graph (src, dst, w); ``still`` stands for a bandwidth of zero."""
    raw = _kernel_edges(points, k, still).withColumnRenamed("w", "raw")
    total = F.sum("raw").over(W.partitionBy("src"))
    return raw.withColumn("w", F.col("raw") / F.when(total == 0, 1.0).otherwise(total)).drop("raw")


def spatial_lag(graph: DataFrame, values: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """W.x for every feature at once from long values (cell_id, *keys, value): absent entries are zeros."""
    return (graph.join(values.withColumnRenamed("cell_id", "dst"), "dst")
            .groupBy(F.col("src").alias("cell_id"), *keys)
            .agg(F.sum(F.col("w") * F.col("value")).alias("lag")))


def smooth(graph: DataFrame, values: DataFrame, alpha: float = 0.65, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """alpha * x + (1 - alpha) * W.x in long form."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    own = values.select("cell_id", *keys, (F.col("value") * alpha).alias("value"))
    lag = spatial_lag(graph, values, keys).select("cell_id", *keys, (F.col("lag") * (1 - alpha)).alias("value"))
    return own.unionByName(lag).groupBy("cell_id", *keys).agg(F.sum("value").alias("value"))
