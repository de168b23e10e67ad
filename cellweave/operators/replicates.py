"""Sums over pairs of moved rows for every replicate of a permutation test.

A replicate hands rows of ids to positions, and a score sums products of the rows at two places. Rows are wide, so they do not travel
with the replicates: pairs of row numbers do, packed by the two chunks of rows that they name, and each two chunks meet once.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .ranking import dense_index, placements

SLOTS = 32  # columns of a block of rows
PAIRS = 8_000_000  # pairs that two chunks meet in, about
CHUNK_BYTES = 48 << 20  # of a chunk, at most
PACKED = 1 << 20  # row numbers that a block of positions or a message is made of, about
_MESSAGE = "key int, perm binary, a binary, b binary, w binary"
_PLACED = "blk long, perm binary, at binary, frm binary"


def chunking(n: int, pairs: float, ordered: bool) -> tuple[int, int]:
    """(rows of a chunk, chunks): as few chunks as give every two of them (either order counts, if ``ordered``) about ``PAIRS``."""
    meetings = max(1.0, pairs / PAIRS)
    chunks = max(math.ceil(math.sqrt(meetings if ordered else 2 * meetings)), math.ceil(n * SLOTS * 8 / CHUNK_BYTES))
    size = max(1, math.ceil(n / chunks))
    return size, max(1, math.ceil(n / size))


def _local(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _runs(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places that hold it), places in their order."""
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(some):
            yield int(key[some[0]]), some


def _packed(size: int, chunks: int, perm: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray | None) -> pa.Table:
    """Messages of pairs (a, b): one for each two chunks."""
    kind, rows = _local(size), []
    for key, some in _runs((a // size) * chunks + b // size):
        rows.append((key, perm[some].astype(np.uint16).tobytes(), (a[some] % size).astype(kind).tobytes(), (b[some] % size).astype(kind).tobytes(),
                     b"" if w is None else w[some].tobytes()))
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))],
                    names=["key", "perm", "a", "b", "w"])


def placed_pairs(index: DataFrame, replicates: int, seed: int, size: int, chunks: int) -> DataFrame:
    """Messages of the pairs (position, row moved there) of replicates 0 to ``replicates`` of ``index`` (cell_id, idx)."""
    return placements(index, replicates, seed, pack=lambda perm, at, frm: _packed(size, chunks, perm, at, frm, None), schema=_MESSAGE)


def edge_pairs(index: DataFrame, replicates: int, seed: int, edges: DataFrame, blocks: DataFrame, size: int, chunks: int) -> DataFrame:
    """Messages of the pairs of rows that replicates 0 to ``replicates`` move to the ends of edges (i, j, w).

    ``blocks`` (at, blk) puts positions that share edges together: a block gathers the rows moved to its own positions and to those
    its edges lead to, all replicates of a position as one value.
    """
    many = replicates + 1
    run = min(1 << 16, max(64, PACKED // many))  # positions that are packed together

    def deal(perm: np.ndarray, at: np.ndarray, frm: np.ndarray) -> pa.Table:
        found = [(key, perm[s].astype(np.uint16).tobytes(), (at[s] % run).astype(np.uint16).tobytes(), frm[s].astype(np.int32).tobytes()) for key, s in _runs(at // run)]
        return pa.table([pa.array([r[0] for r in found], pa.int64()), *(pa.array([r[i] for r in found], pa.binary()) for i in (1, 2, 3))], names=["blk", "perm", "at", "frm"])

    def pack(key: tuple, messages: pa.Table, asked: pa.Table) -> pa.Table:
        moved = np.zeros((run, many), np.int32)
        for perm, at, frm in zip(messages["perm"], messages["at"], messages["frm"], strict=True):
            moved[np.frombuffer(at.as_py(), np.uint16), np.frombuffer(perm.as_py(), np.uint16)] = np.frombuffer(frm.as_py(), np.int32)
        own = [row.tobytes() for row in moved]
        at = asked["at"].to_numpy()
        return pa.table([asked["blk"].combine_chunks(), pa.array(at, pa.int64()), pa.array([own[i] for i in at % run], pa.binary())], names=["blk", "at", "moved"])

    def pairs(key: tuple, packs: pa.Table, ends: pa.Table) -> pa.Table:
        at = packs["at"].to_numpy()
        order = np.argsort(at)
        moved = np.frombuffer(b"".join(packs["moved"].to_pylist()), np.int32).reshape(-1, many)
        i, j, w = (ends[c].to_numpy() for c in ("i", "j", "w"))
        by = np.argsort(w, kind="stable")  # equal weights next to each other are small when they are shuffled
        i, j, w = order[np.searchsorted(at, i[by], sorter=order)], order[np.searchsorted(at, j[by], sorter=order)], w[by]
        out, step = [], max(1, PACKED // max(1, len(w)))
        for first in range(0, many, step):
            a, b = moved[i, first:first + step], moved[j, first:first + step]
            perm = np.broadcast_to(np.arange(first, first + a.shape[1]), a.shape)
            out.append(_packed(size, chunks, perm.ravel(), np.minimum(a, b).ravel(), np.maximum(a, b).ravel(), np.repeat(w, a.shape[1])))
        return pa.concat_tables(out)

    ends = materialise(edges.join(blocks.select(F.col("at").alias("i"), "blk"), "i").select("blk", "i", "j", "w"))
    asked = ends.select("blk", F.col("i").alias("at")).unionByName(ends.select("blk", F.col("j").alias("at"))).distinct()
    runs = asked.withColumn("run", F.floor(F.col("at") / run))
    packs = (placements(index, replicates, seed, pack=deal, schema=_PLACED).groupBy("blk").cogroup(runs.groupBy("run")).applyInArrow(pack, "blk long, at long, moved binary"))
    return packs.groupBy("blk").cogroup(ends.groupBy("blk")).applyInArrow(pairs, _MESSAGE)


def position_blocks(ids: DataFrame, index: DataFrame, n: int, replicates: int) -> DataFrame:
    """(at, blk): strips of the plane cut to blocks of positions, or runs of positions where cells have no coordinates."""
    block = max(64, PACKED // (replicates + 1))
    if not {"x", "y"} <= set(ids.columns):
        return index.select(F.col("idx").alias("at"), F.floor(F.col("idx") / block).alias("blk"))
    box = ids.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if box["lo"] is None:
        return index.select(F.col("idx").alias("at"), F.floor(F.col("idx") / block).alias("blk"))
    width = max((box["hi"] - box["lo"]) / max(1.0, math.sqrt(n / block)), 1e-300) * (1 + 1e-9)
    keyed = ids.select("cell_id", "x", "y").join(index.select("cell_id", "idx"), "cell_id").select(F.struct(F.floor((F.col("x") - box["lo"]) / width).alias("strip"), "y", F.col("idx").alias("at")).alias("place"))
    return dense_index(keyed, "place").select("place.at", F.floor(F.col("idx") / block).alias("blk"))


def row_chunks(wide: DataFrame, prefix: str, size: int, shift: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(k, block, body): rows (idx, block, columns) as matrices of ``size`` rows, less what ``shift`` has for their block; absent rows are zeros."""
    names = [f"{prefix}{i}" for i in range(SLOTS)]

    def build(key: tuple, table: pa.Table) -> pa.Table:
        k, block = (x.as_py() for x in key)
        body = np.zeros((size, SLOTS))
        body[table["idx"].to_numpy() - k * size] = np.stack([table[c].to_numpy() for c in names], axis=1)
        if shift is not None:
            body -= shift[block]
        return pa.table([pa.array([k], pa.int64()), pa.array([block], pa.int32()), pa.array([body.tobytes()], pa.binary())], names=["k", "block", "body"])

    keyed = wide.select(F.floor(F.col("idx") / size).alias("k"), F.col("block").cast("int").alias("block"), F.col("idx").cast("bigint").alias("idx"), *names)
    return materialise(keyed.groupBy("k", "block").applyInArrow(build, "k long, block int, body binary"))


def replicate_sums(messages: DataFrame, left: DataFrame, right: DataFrame, blocks: int, replicates: int, size: int, chunks: int, ordered: bool,
                   shift: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(perm, block, s0..s31): per replicate and column the sum of w a b over the pairs, rows a of ``left`` and b of ``right``.

    A weight that a message lacks is 1. Where b is zero a may be NaN. Without ``ordered`` a pair names the smaller row first.
    """
    kind, names = _local(size), [f"s{i}" for i in range(SLOTS)]

    def meet(key: tuple, parcels: pa.Table, bodies: pa.Table) -> pa.Table:
        block = key[1].as_py()
        empty = np.broadcast_to(np.zeros(SLOTS) if shift is None else -shift[block], (size, SLOTS))
        held = {s: np.frombuffer(b.as_py()).reshape(size, SLOTS) for s, b in zip(bodies["side"].to_pylist(), bodies["body"], strict=True)}
        one = held.get(0, held.get(2, empty))
        two = held.get(1, held.get(2, empty))
        total, seen = np.zeros((replicates + 1, SLOTS)), np.zeros(replicates + 1, bool)
        for perm, a, b, w in zip(parcels["perm"], parcels["a"], parcels["b"], parcels["w"], strict=True):
            perm, w = np.frombuffer(perm.as_py(), np.uint16), np.frombuffer(w.as_py())
            order = np.argsort(perm, kind="stable")
            perm = perm[order]
            first = np.flatnonzero(np.concatenate([[True], perm[1:] != perm[:-1]]))
            x, y = one[np.frombuffer(a.as_py(), kind)[order]], two[np.frombuffer(b.as_py(), kind)[order]]
            product = np.where(y != 0, x, 0.0) * y if shift is None else x * y
            if len(w):
                product *= w[order][:, None]
            total[perm[first]] += np.add.reduceat(product, first, axis=0)
            seen[perm[first]] = True
        found = np.flatnonzero(seen)
        return pa.table([pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int32()), *(pa.array(total[found, i]) for i in range(SLOTS))], names=["perm", "block", *names])

    k = F.col("k")
    last, first = F.lit(chunks - 1).cast("bigint"), F.lit(0).cast("bigint")
    ahead = F.sequence(first if ordered else k, last)
    behind = F.sequence(first, last if ordered else k)
    if not ordered:  # a chunk meets itself by one copy
        own = left.select((k * chunks + k).alias("key"), "block", F.lit(2).alias("side"), "body")
        ahead, behind = F.filter(ahead, lambda o: o != k), F.filter(behind, lambda o: o != k)
    sent = left.withColumn("_o", F.explode(ahead)).select((k * chunks + F.col("_o")).alias("key"), "block", F.lit(0).alias("side"), "body").unionByName(
        right.withColumn("_o", F.explode(behind)).select((F.col("_o") * chunks + k).alias("key"), "block", F.lit(1).alias("side"), "body"))
    if not ordered:
        sent = sent.unionByName(own)
    parcels = messages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = parcels.groupBy("key", "block").cogroup(sent.withColumn("key", F.col("key").cast("int")).groupBy("key", "block")).applyInArrow(
        meet, ", ".join(["perm int, block int", *(f"{c} double" for c in names)]))
    return met.groupBy("perm", "block").agg(*[F.sum(c).alias(c) for c in names])
