"""Permutation-based spatial statistics over a weighted graph."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import permutation_p
from ..session import materialise
from .ranking import benjamini_hochberg, cumulative_counts, dense_index
from .replicates import SLOTS, chunking, edge_pairs, placed_pairs, position_blocks, replicate_sums, row_chunks


MIN_PERMUTATIONS = 19
TIE = 1e-12  # replicates are summed in any order, so equal scores may differ in their last bits


def enough(permutation_count: int) -> None:
    if permutation_count < MIN_PERMUTATIONS:
        raise ValueError(f"a permutation test takes at least {MIN_PERMUTATIONS} replicates")


def reaches(score: Column, observed: Column) -> Column:
    """Whether a replicate's score is at least the observed one, up to rounding."""
    return score >= observed - TIE * F.greatest(F.lit(1.0), F.abs(observed))


def _blocked(values: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell_id, block, y0..y31) and the feature -> (block, slot) map; all-zero blocks are not stored."""
    index = cumulative_counts(features, [], "feature_id").select(
        "feature_id", F.floor(F.col("before") / SLOTS).cast("int").alias("block"), F.pmod("before", F.lit(SLOTS)).cast("int").alias("slot"))
    wide = values.join(index, "feature_id").groupBy("cell_id", "block").agg(
        *[F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("value"))), F.lit(0.0)).alias(f"y{i}") for i in range(SLOTS)])
    return wide, index


def _unblock(sums: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """Back to one row per feature from columns s0..s31."""
    arr = F.array(*[F.col(f"s{i}") for i in range(SLOTS)])
    return sums.join(index, "block").select("perm", "feature_id", arr[F.col("slot")].alias(name))


def _moments(values: DataFrame, n: Column | int) -> tuple[Column, Column]:
    total, squares = F.sum("value"), F.sum(F.col("value") * F.col("value"))
    return total / n, squares - total * total / n


def moran_i(values: DataFrame, graph: DataFrame, n: int, constant: float = 1e-12) -> DataFrame:
    """Moran's I per feature (NULL where constant) for long values with implicit zeros and any graph."""
    values, graph = materialise(values), materialise(graph)
    mean, spread = _moments(values, n)
    stats = values.groupBy("feature_id").agg(mean.alias("m"), spread.alias("d"))
    s0 = graph.agg(F.sum("w").alias("s0")).withColumn("_k", F.lit(1))
    x_src = values.select(F.col("cell_id").alias("src"), "feature_id", F.col("value").alias("a"))
    x_dst = values.select(F.col("cell_id").alias("dst"), "feature_id", F.col("value").alias("b"))
    a = graph.join(x_src, "src").join(x_dst, ["dst", "feature_id"]).groupBy("feature_id").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("aa"))
    degree = (graph.select(F.col("src").alias("cell_id"), "w").unionByName(graph.select(F.col("dst").alias("cell_id"), "w"))
              .groupBy("cell_id").agg(F.sum("w").alias("deg")))
    r = values.join(degree, "cell_id").groupBy("feature_id").agg(F.sum(F.col("deg") * F.col("value")).alias("r"))
    out = stats.join(a, "feature_id", "left").join(r, "feature_id", "left").withColumn("_k", F.lit(1)).join(F.broadcast(s0), "_k")  # s0: one row
    m, d, w = F.col("m"), F.col("d"), F.col("s0")
    top = F.coalesce("aa", F.lit(0.0)) - m * F.coalesce("r", F.lit(0.0)) + m * m * w
    return out.select("feature_id", F.when(d > constant, F.lit(n) / w * top / d).alias("morans_i"))


def spatially_variable(values: DataFrame, detected: DataFrame, graph: DataFrame, ids: DataFrame, *, permutation_count: int = 99,
                       seed: int = 0, min_detected: int = 5) -> DataFrame:
    """One-sided permutation Moran test per feature with BH over the tested ones; every feature keeps a row.

    ``values`` are normalised non-zero entries, ``detected`` (feature_id, detected) the whole panel, ``graph``
    symmetric. One permutation table serves all features, and only row numbers travel with it: the rows that a replicate
    moves to the ends of an edge are named by a packed pair, and chunks of rows meet once for all replicates (``replicates``).
    """
    enough(permutation_count)
    ids = materialise(ids.select("cell_id", *[c for c in ("x", "y") if c in ids.columns]))
    graph, detected = materialise(graph), materialise(detected)
    index_of = materialise(dense_index(ids, "cell_id"))
    n = ids.count()
    eligible = detected.filter(F.col("detected") >= min_detected).select("feature_id")
    tested_values = materialise(values.join(eligible, "feature_id", "left_semi"))
    wide, index = _blocked(tested_values, eligible)
    index = materialise(index)
    mean, spread = _moments(tested_values, n)
    stats = materialise(tested_values.groupBy("feature_id").agg(mean.alias("m"), spread.alias("d")))
    shift: dict[int, np.ndarray] = {}
    for r in index.join(stats, "feature_id", "left").select("block", "slot", F.coalesce("m", F.lit(0.0)).alias("m")).collect():  # a row per feature of the panel
        shift.setdefault(r["block"], np.zeros(SLOTS))[r["slot"]] = r["m"]
    place = lambda end, name: index_of.select(F.col("cell_id").alias(end), F.col("idx").cast("bigint").alias(name))
    half = graph.filter(F.col("src") < F.col("dst")).join(place("src", "i"), "src").join(place("dst", "j"), "dst").select("i", "j", "w")
    half = materialise(half)
    size, chunks = chunking(n, float(half.count()) * (permutation_count + 1), ordered=False)
    blocks = position_blocks(ids, index_of, n, permutation_count)
    rows = row_chunks(wide.join(index_of, "cell_id"), "y", size, shift)
    sums = replicate_sums(edge_pairs(index_of, permutation_count, seed, half, blocks, size, chunks), rows, rows, len(shift), permutation_count, size, chunks, False, shift) if shift else None
    s0 = graph.agg(F.sum("w").alias("s0")).withColumn("_k", F.lit(1))
    if sums is None:
        scored = graph.sparkSession.createDataFrame([], f"feature_id {detected.schema['feature_id'].dataType.simpleString()}, perm int, i double")
    else:
        joined = _unblock(sums, index, "aa").join(stats, "feature_id").withColumn("_k", F.lit(1)).join(F.broadcast(s0), "_k")  # s0: one row
        scored = materialise(joined.filter(F.col("d") > 1e-12).select("feature_id", "perm", (F.lit(n) / F.col("s0") * 2 * F.col("aa") / F.col("d")).alias("i")))
    observed = scored.filter("perm = 0").select("feature_id", F.col("i").alias("morans_i"))
    exceed = (scored.filter("perm > 0").join(observed, "feature_id").groupBy("feature_id")
              .agg(F.count_if(reaches(F.col("i"), F.col("morans_i"))).alias("exceed")))
    rows = detected.join(observed, "feature_id", "left").join(exceed, "feature_id", "left").select(
        "feature_id", "detected",
        F.when(F.col("detected") < min_detected, "below_detection_filter").when(F.col("morans_i").isNull(), "constant_after_normalization")
        .otherwise("tested").alias("status"), "morans_i", permutation_p(F.col("exceed"), permutation_count).alias("p_value"))
    return benjamini_hochberg(rows)


# --- ligand-receptor ---------------------------------------------------------------------------

def resolve_pairs(pairs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, pairs): complexes split on ``_`` into uniquely named subunits.

    A pair with any missing or ambiguous subunit is untestable and keeps its unresolved list.
    """
    unique = features.filter("symbol is not null").groupBy("symbol").agg(F.count("*").alias("_n"), F.first("feature_id").alias("feature_id")).filter("_n = 1")
    named = pairs.select(F.col("ligand").alias("entity")).union(pairs.select("receptor")).distinct()
    subunits = named.withColumn("symbol", F.explode(F.split("entity", "_"))).distinct().join(unique.drop("_n"), "symbol", "left")
    verdict = subunits.groupBy("entity").agg(F.bool_and(F.col("feature_id").isNotNull()).alias("ok"), F.count("*").alias("size"),
                                             F.collect_set(F.when(F.col("feature_id").isNull(), F.col("symbol"))).alias("missing"))
    entities = subunits.join(verdict.filter("ok").select("entity", "size"), "entity").select("entity", "feature_id", "size")
    side = lambda name, p: verdict.select(F.col("entity").alias(name), F.col("ok").alias(f"_{p}ok"), F.col("missing").alias(f"_{p}m"))
    out = pairs.join(side("ligand", "l"), "ligand").join(side("receptor", "r"), "receptor").select(
        "ligand", "receptor", (F.col("_lok") & F.col("_rok")).alias("testable"), F.array_sort(F.array_union("_lm", "_rm")).alias("unresolved_subunits"))
    return entities, out


def entity_expression(values: DataFrame, entities: DataFrame) -> DataFrame:
    """Minimum over subunits; a cell lacking any subunit is zero and gets no row."""
    return (values.join(entities, "feature_id").groupBy("entity", "cell_id")
            .agg(F.min("value").alias("value"), F.count("*").alias("_k"), F.first("size").alias("size"))
            .filter("_k = size and value > 0").select("entity", "cell_id", "value"))


def _sides(values: DataFrame, features: DataFrame, pairs: DataFrame, graph: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(verdict, expression, index, ligand side, receptor side) of the testable pairs.

    Ligand sides are folded over the graph once, c_j = sum_i a_i w~_ij with row-normalised weights. Both sides are
    held in rows of 32 pairs, so a replicate moves one row of a cell for all of them.
    """
    ids, graph = materialise(ids.select("cell_id")), materialise(graph)
    entities, verdict = (materialise(df) for df in resolve_pairs(pairs, features))
    expr = materialise(entity_expression(values.join(ids, "cell_id", "left_semi"), entities))
    testable = verdict.filter("testable").select("ligand", "receptor", F.concat_ws("\t", "ligand", "receptor").alias("pair"))
    index = materialise(cumulative_counts(testable.select("pair").distinct(), [], "pair").join(testable.distinct(), "pair").select(
        "ligand", "receptor", F.floor(F.col("before") / SLOTS).cast("int").alias("block"), F.pmod("before", F.lit(SLOTS)).cast("int").alias("slot")))
    weights = graph.join(graph.groupBy("src").agg(F.sum("w").alias("_t")), "src").select("src", "dst", (F.col("w") / F.col("_t")).alias("w"))
    ligands = expr.join(index.select(F.col("ligand").alias("entity")).distinct(), "entity", "left_semi")
    folded = (ligands.join(weights, F.col("cell_id") == F.col("src")).groupBy(F.col("entity").alias("ligand"), F.col("dst").alias("cell_id"))
              .agg(F.sum(F.col("value") * F.col("w")).alias("v")))
    receptors = expr.select(F.col("entity").alias("receptor"), F.col("cell_id").alias("from_id"), F.col("value").alias("v"))

    def rows(side: DataFrame, entity: str, cell: str, p: str) -> DataFrame:
        return materialise(side.join(index, entity).groupBy(cell, "block").agg(
            *[F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("v"))), F.lit(0.0)).alias(f"{p}{i}") for i in range(SLOTS)]))

    return verdict, expr, index, rows(folded, "ligand", "cell_id", "c"), rows(receptors, "receptor", "from_id", "r")


def _scores(placed: DataFrame, index: DataFrame, left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """(perm, ligand, receptor, s): sum of c_j b_j over positions, divided by the number of cells; where b_j is zero c_j may be NaN."""
    sums = placed.join(left, "cell_id").join(right, ["from_id", "block"]).groupBy("perm", "block").agg(
        *[(F.coalesce(F.sum(F.when(F.col(f"r{i}") != 0, F.col(f"c{i}") * F.col(f"r{i}"))), F.lit(0.0)) / n).alias(f"s{i}") for i in range(SLOTS)])
    every = F.array(*[F.col(f"s{i}") for i in range(SLOTS)])
    return sums.join(index, "block").select("perm", "ligand", "receptor", every[F.col("slot")].alias("s"))


def pair_scores(values: DataFrame, features: DataFrame, pairs: DataFrame, graph: DataFrame, ids: DataFrame) -> DataFrame:
    """(ligand, receptor, score) of the testable pairs as observed: (1/n) sum a_i w~_ij b_j, without any replicate."""
    _, _, index, left, right = _sides(values, features, pairs, graph, ids)
    placed = ids.select(F.lit(0).alias("perm"), "cell_id", F.col("cell_id").alias("from_id"))
    found = _scores(placed, index, left, right, ids.count()).drop("perm")
    return index.join(found, ["ligand", "receptor"], "left").select("ligand", "receptor", F.coalesce("s", F.lit(0.0)).alias("score"))


def ligand_receptor(values: DataFrame, features: DataFrame, pairs: DataFrame, graph: DataFrame, ids: DataFrame, *,
                    permutation_count: int = 199, seed: int = 0) -> DataFrame:
    """Spatial co-expression per pair, receptors permuted over the cells; every pair keeps a row.

    A replicate pairs the ligand rows with moved receptor rows by their numbers and never touches the edges again.
    """
    enough(permutation_count)
    verdict, expr, index, left, right = _sides(values, features, pairs, graph, ids)
    n = ids.count()
    index_of = materialise(dense_index(ids.select("cell_id"), "cell_id"))
    size, chunks = chunking(n, float(n) * (permutation_count + 1), ordered=True)
    c = row_chunks(left.join(index_of, "cell_id"), "c", size)
    r = row_chunks(right.withColumnRenamed("from_id", "cell_id").join(index_of, "cell_id"), "r", size)
    blocks = index.agg(F.max("block")).first()[0]
    if blocks is None:
        per_perm = graph.sparkSession.createDataFrame([], "perm int, ligand string, receptor string, s double")
    else:
        sums = replicate_sums(placed_pairs(index_of, permutation_count, seed, size, chunks), c, r, blocks + 1, permutation_count, size, chunks, True)
        every = F.array(*[F.col(f"s{i}") / n for i in range(SLOTS)])
        per_perm = materialise(sums.join(index, "block").select("perm", "ligand", "receptor", every[F.col("slot")].alias("s")))
    observed = per_perm.filter("perm = 0").select("ligand", "receptor", F.col("s").alias("_obs"))
    keys = ["ligand", "receptor"]
    exceed = (per_perm.filter("perm > 0").join(observed, keys).groupBy(*keys).agg(F.count_if(reaches(F.col("s"), F.col("_obs"))).alias("_e")))
    seen = expr.groupBy("entity").agg((F.count("*") / n).alias("_d"))
    rows = (verdict.join(observed, keys, "left").join(exceed, keys, "left")
            .join(seen.withColumnsRenamed({"entity": "ligand", "_d": "_ld"}), "ligand", "left")
            .join(seen.withColumnsRenamed({"entity": "receptor", "_d": "_rd"}), "receptor", "left"))
    on = F.col("testable")
    # A zero score is matched by every replicate: all scores are non-negative.
    hits = F.when(F.coalesce("_obs", F.lit(0.0)) <= 0, F.lit(permutation_count)).otherwise(F.coalesce("_e", F.lit(0)))
    return benjamini_hochberg(rows.select(
        *keys, F.when(on, "tested").otherwise("unmeasured_or_ambiguous_required_subunit").alias("status"), "unresolved_subunits",
        F.when(on, F.coalesce("_obs", F.lit(0.0))).alias("score"), F.when(on, F.coalesce("_ld", F.lit(0.0))).alias("ligand_detection"),
        F.when(on, F.coalesce("_rd", F.lit(0.0))).alias("receptor_detection"), F.when(on, permutation_p(hits, permutation_count)).alias("p_value")))


def discovery_summary(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    return rows.agg(F.count("*").alias("row_count"), F.count("p_value").alias("tested"), F.count_if(F.col("q_value") < alpha).alias("discoveries"))
