"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking in blocks."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written
from .shingles import mix

TABLES, PROBES, NEAREST = 16, 8, 20
#: Vectors and queries that meet in one block at most, about; fuller buckets are split.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
_ROUNDS = 3
BLOCK = "tab int, bucket int, vec_id long, is_query boolean, vector binary"


def signs(table: int, width: int) -> np.ndarray:
    """The random signs of a table's rotation rounds (rounds x width), from hashes of their places."""
    at = np.arange(_ROUNDS * width, dtype=np.uint64) + np.uint64((table + 1) << 32)
    return np.where(mix(mix(at)) >> np.uint64(63), 1.0, -1.0).reshape(_ROUNDS, width)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pair = x.reshape(n, width // (2 * half), 2, half)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Projections on the signed axes after the table's pseudo-rotation: columns 0..w-1 are +axes, w..2w-1 -axes."""
    for s in signs(table, x.shape[1]):
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def unit(vectors: np.ndarray, longest: float, as_query: bool) -> np.ndarray:
    """Unit rows, padded to a power of two, whose cosines order candidates as inner products do.

    A candidate is divided by the largest norm and completed by one more coordinate, a query normalised.
    """
    n, dims = vectors.shape
    out = np.zeros((n, 1 << max(0, dims - 1).bit_length() if longest == 0 else 1 << dims.bit_length()))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    if longest == 0 or as_query:
        out[:, :dims] = vectors / norms
    else:
        out[:, :dims] = vectors / longest
        out[:, dims] = np.sqrt(np.maximum(0, 1 - (norms[:, 0] / longest) ** 2))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of rows that take part: not null, empty or zero, all components finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))


def index_rows(vectors: DataFrame, query_every: int, tables: int, probes: int, longest: float) -> DataFrame:
    """For each table one row in a vector's bucket, and for queries one in each of the ``probes`` nearest buckets."""
    def work(batches):
        for batch in batches:
            ids, values = batch["vec_id"].to_numpy(), batch["embedding"]
            widths = values.value_lengths().to_numpy()
            for dims in np.unique(widths):
                rows = np.flatnonzero(widths == dims)
                x = np.array([values[int(i)].as_py() for i in rows], dtype=np.float64)
                body = [r.tobytes() for r in x]
                asks = np.flatnonzero(ids[rows] % query_every == 0)
                for t in range(tables):
                    own = rotated(unit(x, longest, False), t).argmax(axis=1)
                    near = np.argsort(-rotated(unit(x[asks], longest, True), t), axis=1, kind="stable")[:, :probes]
                    at = np.concatenate([np.arange(len(rows)), np.repeat(asks, near.shape[1])])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), t), pa.int32()), pa.array(np.concatenate([own, near.ravel()]), pa.int32()), pa.array(ids[rows][at]),
                        pa.array(np.arange(len(at)) >= len(rows)), pa.array([body[i] for i in at], pa.binary())],
                        names=["tab", "bucket", "vec_id", "is_query", "vector"])
    return map_batches(vectors, work, BLOCK)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component, so that equal vectors score equally wherever they stand."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _nearest(k: int):
    def of_block(table: pa.Table) -> pa.Table:
        asked = table["is_query"].to_numpy(zero_copy_only=False)
        ids = table["vec_id"].to_numpy()
        lengths = np.array([len(v.as_py()) for v in table["vector"]])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(lengths):
            same = np.flatnonzero(lengths == width)
            x = np.frombuffer(b"".join(table["vector"].take(same).to_pylist()), np.float64).reshape(len(same), -1)
            q, v = same[asked[same]], same[~asked[same]]
            if not len(q) or not len(v):
                continue
            xq, xv = x[asked[same]], x[~asked[same]]
            near = xq @ xv.T
            near[ids[q][:, None] == ids[v][None, :]] = -np.inf
            most = min(k, len(v))
            kth = np.partition(near, len(v) - most, axis=1)[:, len(v) - most]
            slack = 1e-12 * (1 + np.linalg.norm(xq, axis=1) * np.linalg.norm(xv, axis=1).max())
            row, col = np.nonzero((near >= (kth - slack)[:, None]) & (near > -np.inf))
            score = exact_scores(xq[row], xv[col])
            order = np.lexsort((ids[v][col], -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.searchsorted(row, row)
            kept = np.arange(len(row)) - first < k
            out.append((ids[q][row[kept]], ids[v][col[kept]], score[kept]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})
    return of_block


def in_blocks(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query within each (tab, bucket), as (query_id, vec_id, score), possibly repeated.

    Full buckets are dealt to blocks by a hash of the id: each vector to one part, each query to one, and each pair
    of parts is one block, so every pair of a bucket meets once and no task holds a whole hot bucket.
    """
    counts = (rows.groupBy("tab", "bucket").agg(F.count_if(~F.col("is_query")).alias("v"), F.count_if("is_query").alias("q"))
              .select("tab", "bucket", F.ceil(F.greatest("v", F.lit(1)) / BLOCK_VECTORS).alias("vs"), F.ceil(F.greatest("q", F.lit(1)) / BLOCK_QUERIES).alias("qs")))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dealt = (rows.join(F.broadcast(counts), ["tab", "bucket"])  # tables x signed axes rows, whatever the input
             .withColumn("vp", F.explode(F.when(F.col("is_query"), all_of("vs")).otherwise(F.array(part("vs")))))
             .withColumn("qp", F.explode(F.when(F.col("is_query"), F.array(part("qs"))).otherwise(all_of("qs")))))
    return dealt.groupBy("tab", "bucket", "vp", "qp").applyInArrow(_nearest(k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, query_every: int = 20, k: int = NEAREST, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``query_every``.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. Every row is indexed. Null,
    empty and zero vectors and those with null or non-finite components take no part, nor do rows without id; vectors
    of different length never meet. Rows that repeat an id and vector count once, and none is its own neighbour.
    A query that finds fewer than k (or than there are) is searched again against all rows, in blocks, so small
    tables come out whole. Other columns are ignored; an empty table gives no rows.
    """
    vectors = written(usable(vectors))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    shortest, longest, there = vectors.select(norm.alias("n"), "vec_id").agg(F.min("n"), F.max("n"), F.count_distinct("vec_id")).first()
    if not there:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    even = longest - shortest <= 1e-6 * longest  # equal norms need no completing coordinate
    found = written(_ranked(in_blocks(written(index_rows(vectors, query_every, tables, probes, 0.0 if even else float(longest))), k), k))
    least = min(k, there - 1)
    asked = vectors.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id")).distinct()
    short = written(asked.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < least).select("query_id"))
    if not short.isEmpty():
        flat = map_batches(vectors, _flat, BLOCK)
        again = flat.join(short.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi").withColumn("is_query", F.lit(True)).select(flat.columns)
        found = found.join(short, "query_id", "left_anti").unionByName(_ranked(in_blocks(flat.unionByName(again), k), k))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _flat(batches):
    """All vectors in one bucket, for the search against all rows."""
    for batch in batches:
        body = [np.array(v, dtype=np.float64).tobytes() for v in batch["embedding"].to_pylist()]
        zero = pa.array(np.zeros(len(body)), pa.int32())
        yield pa.RecordBatch.from_arrays([zero, zero, batch["vec_id"], pa.array(np.zeros(len(body), bool)), pa.array(body, pa.binary())],
                                         names=["tab", "bucket", "vec_id", "is_query", "vector"])
