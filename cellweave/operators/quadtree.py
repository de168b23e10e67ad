"""Exact sums over any viewport from a stored quadtree: whole tiles by their totals, rows only where a tile is cut.

Every tile keeps the range of its own rows' coordinates, not its nominal square. A display bin is a rounded but
monotone function of a coordinate, so a tile whose two ends fall into one bin lies in it with every row: totals are
exact without any tolerance. A tile is used where it is decided and its parent, whose range it carries, is not, so
a descent is one filter and no join.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROWS_PER_TILE = 64  # mean of the finest tiles; the number of levels follows the counted rows
MAX_DEPTH = 15
_ENDS = ("lo_x0", "lo_x1", "hi_x0", "hi_x1", "lo_y0", "lo_y1", "hi_y0", "hi_y1")  # least and greatest low end, least and greatest high end, per axis


@dataclass
class Tree:
    """Tiles of all levels with their sums, and the coordinates of all rows beside the ranges of their finest tiles."""

    tiles: DataFrame
    rows: DataFrame
    weights: tuple[str, ...]

    def of(self, condition: Column) -> Tree:
        """The part of a keyed tree that a condition on its keys chooses."""
        return Tree(self.tiles.filter(condition), self.rows.filter(condition), self.weights)


def depth_for(rows: int, keys: int = 1) -> int:
    """Levels below the root so that the finest tiles of each key hold about ``ROWS_PER_TILE`` rows."""
    depth = 0
    while depth < MAX_DEPTH and rows > keys * ROWS_PER_TILE * 4 ** depth:
        depth += 1
    return depth


def _low_high(columns: Sequence[str]) -> tuple[str, str, str, str]:
    return ("minx", "maxx", "miny", "maxy") if "minx" in columns else ("x", "x", "y", "y")


def write_tree(path: str, layer: DataFrame, window: Sequence[float], depth: int, keys: Sequence[str] = (), weights: Sequence[str] = (), count: str | None = None) -> Tree:
    """Write the tiles and rows of a layer of points (x, y) or boxes (minx, maxx, miny, maxy).

    With ``count`` a row stands for so many rows of the same place.

    Rows beyond the window belong to its outermost tiles. Rows without coordinates lie in no tile and no viewport.
    An empty layer has no tiles, and all its sums are 0.
    """
    low_x, high_x, low_y, high_y = _low_high(layer.columns)
    x0, y0, x1, y1 = map(float, window)
    side = 1 << depth
    place = lambda v, low, width: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(v) - low) / width * side))).cast("int")
    known = F.lit(True)
    for c in {low_x, high_x, low_y, high_y}:
        known = known & F.col(c).isNotNull()
    coordinates = list(dict.fromkeys([low_x, high_x, low_y, high_y]))
    held = [] if count is None else [F.col(count).cast("bigint").alias("n")]
    placed = layer.filter(known).select(*keys, *coordinates, *weights, *held, place(low_x, x0, x1 - x0).alias("gx"), place(low_y, y0, y1 - y0).alias("gy"))
    ends = dict(zip(_ENDS, [F.min(low_x), F.max(low_x), F.min(high_x), F.max(high_x), F.min(low_y), F.max(low_y), F.min(high_y), F.max(high_y)]))
    kept = [e for e in _ENDS if low_x != high_x or e.startswith("lo")]  # a point's two ends are one
    half = depth // 2
    block = [F.shiftright(g, half).alias(f"b{g}") for g in ("gx", "gy")]

    def stored(name: str, df: DataFrame, *order: str) -> DataFrame:
        """Neighbouring tiles lie together; a crowded block is split over tasks by adaptive execution."""
        out = df.select("*", *block).hint("rebalance", *[F.col(c) for c in [*keys, *order, "bgx", "bgy"]])
        out.sortWithinPartitions(*keys, *order, "bgx", "bgy", "gx", "gy").drop("bgx", "bgy").write.parquet(f"{path}/{name}")
        return layer.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    finest = stored("finest", placed.groupBy(*keys, "gx", "gy").agg(
        (F.sum("n") if held else F.count("*")).alias("n"), *[F.sum(w).alias(w) for w in weights], *[ends[e].alias(e) for e in kept]))
    extreme = lambda e: F.min(e) if e.endswith("0") else F.max(e)
    levels = (finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
              .withColumns({g: F.expr(f"shiftright({g}, {depth} - level)") for g in ("gx", "gy")})
              .groupBy(*keys, "level", "gx", "gy").agg(F.sum("n").alias("n"), *[F.sum(w).alias(w) for w in weights], *[extreme(e).alias(e) for e in kept]))
    siblings = W.partitionBy(*keys, "level", F.shiftright("gx", 1), F.shiftright("gy", 1))  # four tiles at most
    tiles = stored("tiles", levels.withColumns({f"p_{e}": extreme(e).over(siblings) for e in kept}), "level")

    same = F.lit(True)
    for k in [*keys, "gx", "gy"]:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    columns = [F.col(f"r.{c}") for c in dict.fromkeys([*keys, *coordinates, *weights, *(["n"] if held else []), "gx", "gy"])]
    rows = placed.alias("r").join(finest.alias("t"), same).select(*columns, *[F.col(f"t.{e}") for e in kept])
    return Tree(tiles, stored("rows", rows), tuple(weights))


def _all_meet(tree: Tree, bounds: Sequence[float], prefix: str = "") -> Column:
    """Every row of a tile meets the closed viewport."""
    x0, y0, x1, y1 = map(float, bounds)
    e = lambda name: F.col(prefix + (name if name in tree.rows.columns else name.replace("hi", "lo")))
    return (e("hi_x0") >= x0) & (e("lo_x1") <= x1) & (e("hi_y0") >= y0) & (e("lo_y1") <= y1)


def _row_meets(bounds: Sequence[float], columns: Sequence[str]) -> Column:
    x0, y0, x1, y1 = map(float, bounds)
    low_x, high_x, low_y, high_y = (F.col(c) for c in _low_high(columns))
    return (high_x >= x0) & (low_x <= x1) & (high_y >= y0) & (low_y <= y1)


def _held(tree: Tree) -> Column:
    """How many rows a stored row stands for."""
    return (F.col("n") if "n" in tree.rows.columns else F.lit(1).cast("bigint")).alias("n")


def total(tree: Tree, bounds: Sequence[float]) -> DataFrame:
    """One row: how many rows meet the closed viewport (``n``), and the sums of the weights over them."""
    names = ["n", *tree.weights]
    # A tile that is used has rows in the viewport, so its parent has too and is only open where it has others.
    whole = tree.tiles.filter(_all_meet(tree, bounds) & ((F.col("level") == 0) | ~_all_meet(tree, bounds, "p_"))).select(*names)
    rim = rim_rows(tree, bounds).select(_held(tree), *tree.weights)
    return whole.unionByName(rim).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])


def rim_rows(tree: Tree, bounds: Sequence[float]) -> DataFrame:
    """The rows in the viewport whose finest tile is cut by its border: those that ``total`` looks at one by one."""
    return tree.rows.filter(_row_meets(bounds, tree.rows.columns) & ~_all_meet(tree, bounds))


def bin_of(value: Column, low: float, width: float, grid: int) -> Column:
    return F.least(F.lit(grid - 1), ((value - low) / width).cast("int"))


def density(tree: Tree, bounds: Sequence[float], grid: int) -> DataFrame:
    """Exact counts of a tree of points per bin (gx, gy) of a grid over a closed viewport; empty bins have no row."""
    x0, y0, x1, y1 = map(float, bounds)
    dx, dy = (x1 - x0) / grid, (y1 - y0) / grid
    at_x, at_y = (lambda v: bin_of(v, x0, dx, grid)), (lambda v: bin_of(v, y0, dy, grid))

    def decided(prefix: str = "") -> Column:
        e = lambda name: F.col(prefix + name)
        # Bins are taken only inside the viewport, where they fit an integer.
        one_bin = (at_x(e("lo_x0")) == at_x(e("lo_x1"))) & (at_y(e("lo_y0")) == at_y(e("lo_y1")))
        return F.when(_all_meet(tree, bounds, prefix), one_bin).otherwise(F.lit(False))

    whole = (tree.tiles.filter(_all_meet(tree, bounds)).filter(decided() & ((F.col("level") == 0) | ~decided("p_")))
             .select(at_x(F.col("lo_x0")).alias("gx"), at_y(F.col("lo_y0")).alias("gy"), "n"))
    rim = (tree.rows.filter(_row_meets(bounds, ("x", "y"))).filter(~decided())
           .select(at_x(F.col("x")).alias("gx"), at_y(F.col("y")).alias("gy"), _held(tree)))
    return whole.unionByName(rim).groupBy("gx", "gy").agg(F.sum("n").alias("n"))
