"""Sums of neighbours within a radius, counted by pairs of tiles instead of pairs of points.

A tile pair that lies wholly within the radius adds the target tile's totals to the source tile, one that lies
wholly beyond it is dropped, and only a pair on the rim is split into its children or, once small, looked at point by point.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import materialise
from .spatial import _SLACK, _neighbour_tiles

SPLIT = 16  # point pairs of a rim pair that are cheaper to expand than to split into up to 16 child pairs
LEAST = 1_000_000  # point pairs of all rims together below which another level costs more than it saves
PACKED_SPLIT = 131_072  # the same two bounds for packed blocks, whose pairs are looked at as matrices
PACKED_LEAST = 100_000_000
BLOCK = 1024  # rows of a packed block, about
MEET = 65_536  # target rows that a group of blocks holds beside its source block, about
TASK_PAIRS = 8_000_000  # point pairs of a task, about
MOST_TASKS = 4096
DEPTH = 20  # halvings of the largest radius; closer positions are no longer told apart and expand to points


def _gridded(points: DataFrame, fine: float, tag: str) -> DataFrame:
    """Points with their finest tile; rows without a finite position have no neighbours."""
    finite = lambda c: F.abs(F.col(c)) < float("inf")  # noqa: E731  (null and NaN are not below infinity)
    return points.filter(finite("x") & finite("y")).withColumns({f"_f{tag}{a}": F.floor(F.col(a) / F.lit(fine)).cast("bigint") for a in "xy"})


def _at(level: int, depth: int, tag: str) -> dict[str, Column]:
    return {f"{tag}{a}": F.shiftright(F.col(f"_f{tag}{a}"), depth - level) for a in "xy"}


def _tiles(points: DataFrame, level: int, depth: int, tag: str) -> DataFrame:
    """Number of points and bounding box of every tile of a level."""
    at = _at(level, depth, tag)
    return points.groupBy(*[c.alias(n) for n, c in at.items()]).agg(
        F.count("*").alias(f"{tag}n"), *[f(a).alias(f"{tag}{a}{i}") for a in "xy" for i, f in enumerate((F.min, F.max))])


def _classified(pairs: DataFrame) -> DataFrame:
    """Which of the pair's radii hold it wholly, and which cut it.

    The bounds use the subtractions and products that a pair of points would, whose rounding is monotone: a pair
    of points can never disagree with its boxes.
    """
    far2 = near2 = F.lit(0.0)
    for a in "xy":
        s0, s1, t0, t1 = (F.col(f"{tag}{a}{i}") for tag in "st" for i in (0, 1))
        far, near = F.greatest(s1 - t0, t1 - s0), F.greatest(F.lit(0.0), s0 - t1, t0 - s1)
        far2, near2 = far2 + far * far, near2 + near * near
    out = pairs.withColumns({"_far2": far2, "_near2": near2})
    return (out.withColumns({"inside": F.filter("radii", lambda r: F.col("_far2") <= r * r),
                             "rim": F.filter("radii", lambda r: (F.col("_near2") <= r * r) & (F.col("_far2") > r * r))})
            .filter((F.size("inside") > 0) | (F.size("rim") > 0)).select("sx", "sy", "tx", "ty", "sn", "tn", "inside", "rim"))


def tile_pairs(sources: DataFrame, nodes: DataFrame, radii: Sequence[float], depth: int = DEPTH, split: int = SPLIT,
               least: int = LEAST) -> Iterator[tuple[int, DataFrame, int, DataFrame, int]]:
    """Per level: (level, pairs wholly inside a radius, their number, rim pairs to expand, their point pairs).

    ``sources`` and ``nodes`` come from ``_gridded``. Level 0 has tiles as wide as the largest radius, each next
    one halves them; only crowded rim pairs go on. The driver sees three sums a level.
    """
    level, every = 0, F.array(*[F.lit(r) for r in radii])
    s, t = _tiles(sources, 0, depth, "s"), _tiles(nodes, 0, depth, "t")
    around = s.withColumn("_t", F.explode(_neighbour_tiles(F.col("sx"), F.col("sy")))).withColumns({"tx": F.col("_t.tx"), "ty": F.col("_t.ty")}).drop("_t")
    pairs = around.join(t, ["tx", "ty"]).withColumn("radii", every)
    while True:
        pairs = materialise(_classified(pairs))
        work, on_rim = F.col("sn") * F.col("tn"), F.size("rim") > 0
        seen = pairs.agg(F.coalesce(F.sum(F.when(on_rim & (work > split), work)), F.lit(0)).alias("crowded"),
                         F.coalesce(F.sum(F.when(on_rim & (work <= split), work)), F.lit(0)).alias("small"), F.count_if(F.size("inside") > 0).alias("inside")).first()
        last = seen["crowded"] <= least or level == depth
        yield (level, pairs.filter(F.size("inside") > 0), seen["inside"], pairs.filter(on_rim if last else on_rim & (work <= split)),
               seen["small"] + (seen["crowded"] if last else 0))
        if last:
            return
        level += 1
        parent = lambda tiles, tag: tiles.withColumns({f"_p{a}": F.shiftright(F.col(f"{tag}{a}"), 1) for a in "xy"})
        pairs = pairs.filter(on_rim & (work > split)).select(*[F.col(f"{tag}{a}").alias(f"_{tag}{a}") for tag in "st" for a in "xy"], F.col("rim").alias("radii"))
        for tag, points in (("s", sources), ("t", nodes)):
            children = parent(_tiles(points, level, depth, tag), tag).withColumnsRenamed({"_px": f"_{tag}x", "_py": f"_{tag}y"})
            pairs = pairs.join(children, [f"_{tag}x", f"_{tag}y"])


def _met(width: int) -> Callable[[pa.Table], pa.Table]:
    """Sums of one source block over its packed target blocks, per source and radius with a target in reach."""
    def of_group(table: pa.Table) -> pa.Table:
        own = table["own"].combine_chunks().flatten()
        x, y = (pc.struct_field(own, c).to_numpy(zero_copy_only=False)[:, None] for c in ("_lx", "_ly"))
        sums: dict[float, np.ndarray] = {}
        met: dict[float, np.ndarray] = {}
        for tx, ty, n, rim in zip(*[table[c] for c in ("x", "y", "n", "rim")]):
            if not tx.is_valid:
                continue
            dx, dy = x - tx.values.to_numpy(), y - ty.values.to_numpy()
            d2, n = dx * dx + dy * dy, n.values.to_numpy(zero_copy_only=False).reshape(-1, width)
            short = np.float64 if len(n) * np.abs(n).max(initial=0).astype(np.float64) < 2.0 ** 53 else np.int64  # either way exact
            for r in rim.as_py():
                near = d2 <= r * r
                sums[r] = sums.get(r, 0) + (near.astype(short) @ n.astype(short)).astype(np.int64)
                met[r] = met.get(r, False) | near.any(axis=1)
        found = {r: np.flatnonzero(hit) for r, hit in sorted(met.items())}
        which = np.concatenate([np.zeros(0, np.int64), *found.values()])
        flat = np.concatenate([np.zeros(0, np.int64), *[sums[r][i].ravel() for r, i in found.items()]])
        lists = pa.ListArray.from_arrays(np.arange(len(which) + 1, dtype=np.int32) * width, pa.array(flat))
        return pa.table({"own": own.take(pa.array(which)), "radius": np.repeat(np.array(list(found)), [len(i) for i in found.values()]).astype(np.float64), "n": lists})
    return of_group


def _rim_sums(here: DataFrame, there: DataFrame, rim: DataFrame, own: Sequence[str], width: int, pairs: int) -> DataFrame:
    """(own, radius, n) of the points of rim pairs, by packed blocks that meet as matrices; a source may have several rows.

    The points of a tile are cut to blocks of bounded size. The blocks of targets that one block of sources meets are dealt to groups,
    and groups to as many tasks as the pairs of points need.
    """
    rim = rim.select("sx", "sy", "tx", "ty", "sn", "tn", "rim")
    of = lambda n: F.ceil(F.col(n) / BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    def dealt(points: DataFrame, tag: str) -> DataFrame:
        tile = [f"{tag}x", f"{tag}y"]
        parts = rim.groupBy(*tile).agg(F.max(of(f"{tag}n")).alias("_parts"))
        return points.join(parts, tile).withColumn(f"{tag}p", F.pmod(F.xxhash64(*points.columns), F.col("_parts"))).drop("_parts")

    whole = F.array(*[F.coalesce(F.col("n")[i], F.lit(0)).cast("bigint") for i in range(width)])
    targets = dealt(there.select("tx", "ty", "x", "y", whole.alias("n")), "t").groupBy("tx", "ty", "tp").agg(
        F.collect_list("x").alias("x"), F.collect_list("y").alias("y"), F.flatten(F.collect_list("n")).alias("n"))
    packed = dealt(here.select("sx", "sy", F.struct(*own, F.col("x").cast("double").alias("_lx"), F.col("y").cast("double").alias("_ly")).alias("own")), "s")
    packed = packed.groupBy("sx", "sy", "sp").agg(F.collect_list("own").alias("own"))
    groups = rim.groupBy("sx", "sy").agg(F.ceil(F.sum("tn") / MEET).alias("_groups"))
    asked = (rim.join(groups, ["sx", "sy"]).withColumn("tp", every(of("tn"))).withColumn("sp", every(of("sn")))
             .withColumn("g", F.pmod(F.xxhash64("tx", "ty", "tp"), F.col("_groups"))).select("sx", "sy", "sp", "g", "tx", "ty", "tp", "rim"))
    key = ["sx", "sy", "sp", "g"]
    met = asked.join(targets, ["tx", "ty", "tp"]).select(*key, "x", "y", "n", "rim")
    asking = packed.join(groups, ["sx", "sy"]).withColumn("g", every(F.col("_groups"))).select(*key, "own")
    tasks = min(MOST_TASKS, math.ceil(pairs / TASK_PAIRS) or 1)
    rows = met.unionByName(asking, allowMissingColumns=True).repartition(tasks, *key)
    out = StructType([StructField("own", packed.schema["own"].dataType.elementType), StructField("radius", DoubleType()), StructField("n", ArrayType(LongType()))])
    return rows.groupBy(*key).applyInArrow(_met(width), out).select(*[F.col(f"own.{c}").alias(c) for c in own], "radius", "n")


def radius_sums(sources: DataFrame, nodes: DataFrame, radii: Sequence[float], keys: Sequence[str], carry: Sequence[str], width: int,
                depth: int = DEPTH, split: int = PACKED_SPLIT, least: int = PACKED_LEAST) -> DataFrame:
    """Per source and radius, the elementwise sum of ``n`` over all nodes at distance <= radius: (keys, carry, radius, n).

    ``sources`` hold x, y, keys (unique per row) and carried columns, ``nodes`` hold x, y and an array ``n`` of
    ``width`` integers; both are read once or twice a level, so pass stored tables. Sources without any node in reach, and rows with a null or non-finite position, have no row. Sums are exact.
    """
    radii = sorted({float(r) for r in radii})
    side = radii[-1] * (1 + _SLACK) or 1.0
    s, t = _gridded(sources, side / 2 ** depth, "s"), _gridded(nodes, side / 2 ** depth, "t")
    sums = [F.sum(F.col("n")[i]).alias(f"_n{i}") for i in range(width)]
    together = F.array(*[F.col(f"_n{i}") for i in range(width)]).alias("n")
    own, parts = [*keys, *carry], []
    for level, inside, n_inside, rim, n_rim in tile_pairs(s, t, radii, depth, split, least):
        here, there = s.withColumns(_at(level, depth, "s")), t.withColumns(_at(level, depth, "t"))
        if n_inside:
            totals = there.groupBy("tx", "ty").agg(*sums).select("tx", "ty", together)
            per_tile = inside.select("sx", "sy", "tx", "ty", F.explode("inside").alias("radius")).join(totals, ["tx", "ty"]).groupBy("sx", "sy", "radius").agg(*sums)
            parts.append(here.join(per_tile.select("sx", "sy", "radius", together), ["sx", "sy"]).select(*own, "radius", "n"))
        if n_rim:
            parts.append(_rim_sums(here, there, rim, own, width, n_rim))
    if not parts:
        return s.limit(0).select(*own, F.lit(0.0).alias("radius"), F.array(*[F.lit(0).cast("bigint")] * width).alias("n"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*keys, "radius").agg(*[F.first(c).alias(c) for c in carry], *sums).select(*own, "radius", together)
