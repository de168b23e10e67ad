"""Exact ranks, quantiles and false-discovery rates without putting one group into one task.

Everything rests on cumulative counts over distinct values: values are first counted (map-side
combined), split into ordered buckets, ranked inside each bucket and shifted by bucket offsets.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise

TASK_ROWS = 2_000_000  # replicates of ids that a task orders, about


def cumulative_counts(rows: DataFrame, by: Sequence[str], value: str, bucket: Column | None = None) -> DataFrame:
    """(by, value, n, before, total, _b): how many rows hold a value and how many lie strictly below it.

    Without a given bucket the distinct values are range-partitioned by themselves, whatever their type, and a bucket
    is a partition; their number is the session's, so a task stays as large as that setting makes it.
    """
    by = list(by)
    rows = rows.filter(F.col(value).isNotNull()).select(*by, value)
    if not by:
        rows, by = rows.withColumn("_all", F.lit(1)), ["_all"]
    dist = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    if bucket is None:
        dist = materialise(dist.repartitionByRange(*by, value).withColumn("_b", F.spark_partition_id()))
    else:
        dist = materialise(dist).withColumn("_b", bucket)
    whole = W.partitionBy(*by)
    ahead = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = dist.groupBy(*by, "_b").agg(F.sum("n").alias("_bn")).select(
        *by, "_b", F.coalesce(F.sum("_bn").over(ahead), F.lit(0)).alias("_off"), F.sum("_bn").over(whole).alias("total"))
    inside = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (dist.join(offsets, [*by, "_b"])
            .withColumn("before", F.col("_off") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("_off"))


def rank_table(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank of each distinct value."""
    return cumulative_counts(rows, by, value).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return rows.join(rank_table(rows, by, value, out), [*by, value])


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per named probability."""
    table = cumulative_counts(rows, by, value)
    keys = list(by) or ["_all"]
    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(h), F.ceil(h)
        holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
        aggs += [F.max(F.when(holds(low), F.col(value))).alias(f"_lo_{name}"), F.max(F.when(holds(high), F.col(value))).alias(f"_hi_{name}"),
                 F.max(h - low).alias(f"_w_{name}")]
    out = table.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probs]).drop("_all")


def _p_bucket(p: Column) -> Column:
    """At most ~2100 ordered buckets: linear above 2**-10, one per power of two below."""
    small = F.lit(1024) - F.least(F.floor(-F.log2(F.greatest(p, F.lit(1e-300)))), F.lit(1024))
    return F.when(p < 2.0**-10, small).otherwise(F.lit(1025) + F.floor(p * 1024)).cast("int")


def benjamini_hochberg(rows: DataFrame, p: str = "p_value", q: str = "q_value", family: Sequence[str] = (), failed_as_one: bool = False) -> DataFrame:
    """Add q-values. Rows with NULL p stay untested; with ``failed_as_one`` they count as p=1 but keep a NULL q.

    A tie block shares the q of its last rank, so q is a function of the distinct p alone.
    """
    family = list(family)
    scored = materialise(rows.withColumn("_p", F.coalesce(p, F.lit(1.0)) if failed_as_one else F.col(p)))
    table = cumulative_counts(scored, family, "_p", _p_bucket(F.col("_p")))
    keys = family or ["_all"]
    table = table.withColumn("_adj", F.col("_p") * F.col("total") / (F.col("before") + F.col("n")))
    later = W.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    tails = table.groupBy(*keys, "_b").agg(F.min("_adj").alias("_m")).select(*keys, "_b", F.min("_m").over(later).alias("_tail"))
    here = W.partitionBy(*keys, "_b").orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, 0)
    qs = (table.withColumn("_here", F.min("_adj").over(here)).join(tails, [*keys, "_b"])
          .select(*keys, "_p", F.least(F.lit(1.0), F.col("_here"), F.col("_tail")).alias("_q")).drop("_all"))
    matched = scored.join(qs, [*family, "_p"], "left")
    return matched.withColumn(q, F.when(F.col(p).isNotNull(), F.col("_q"))).drop("_p", "_q")


def dense_index(ids: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based position of each distinct id in id order."""
    return cumulative_counts(ids, [], key).select(key, F.col("before").alias(out))


def _replicates(ids: DataFrame, count: int, seed: int, key: str) -> tuple[DataFrame, Column]:
    """(every id once per replicate from 1 to ``count`` with the bucket ``_b`` of its digest, the digest): replicate b orders the ids by
    md5(seed|b|id). Digest prefixes are uniform, so the 256 buckets per replicate are balanced whatever the ids are."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col(key).cast("string")))
    dealt = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # ids are few bytes, often one partition, and their replicates are not
    every = ids.repartition(dealt, key).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return every.withColumn("_b", F.substring(digest, 1, 2)), digest


def permutations(ids: DataFrame, count: int, seed: int, key: str = "cell_id") -> DataFrame:
    """(perm, cell_id, from_id): a declared, reproducible permutation per replicate; perm 0 is the identity.

    Replicate b orders the ids by md5(seed|b|id) and hands the r-th id in that order to the r-th position.
    """
    # A replicate of every id is far more than any size estimate of the ids foresees: no join may send it through the driver.
    # Rows are dealt by the digest's bucket and take the digest itself only where they are ordered.
    hashed, digest = _replicates(ids.select(key), count, seed, key)
    inside = W.partitionBy("perm", "_b").orderBy("_h")
    ahead = W.partitionBy("perm").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = hashed.groupBy("perm", "_b").agg(F.count("*").alias("_bn")).select(
        "perm", "_b", F.coalesce(F.sum("_bn").over(ahead), F.lit(0)).alias("_off"))
    ranked = (hashed.repartition("perm", "_b").withColumn("_h", digest).withColumn("_i", F.row_number().over(inside))
              .join(offsets.hint("shuffle_hash"), ["perm", "_b"])
              .select("perm", F.col(key).alias("from_id"), (F.col("_off") + F.col("_i") - 1).alias("idx")))
    placed = ranked.join(dense_index(ids, key).hint("shuffle_hash"), "idx").select("perm", key, "from_id")
    return placed.unionByName(ids.select(F.lit(0).alias("perm"), key, F.col(key).alias("from_id")))


def _plain(perm: np.ndarray, at: np.ndarray, frm: np.ndarray) -> pa.Table:
    return pa.table([pa.array(perm, pa.int32()), pa.array(at, pa.int64()), pa.array(frm, pa.int64())], names=["perm", "at", "frm"])


def _digest_order(perm: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of rows by replicate and digest (two words each)."""
    by = np.argsort(h[:, 0])
    by = by[np.argsort(perm[by].astype(np.uint16), kind="stable")]
    if ((h[by[1:], 0] == h[by[:-1], 0]) & (perm[by[1:]] == perm[by[:-1]])).any():  # the second word decides
        by = np.lexsort((h[:, 1], h[:, 0], perm))
    return by


def placements(index: DataFrame, count: int, seed: int, key: str = "cell_id", pack: Callable[..., pa.Table] = _plain, schema: str = "perm int, at long, frm long") -> DataFrame:
    """(perm, at, frm): ``permutations`` between the places of ids in their own order, for ``index`` (key, idx) of distinct ids.

    A task orders the buckets it was dealt, and gives what ``pack`` makes of them; the driver holds one number per replicate and bucket.
    """
    hashed, digest = _replicates(index.select(key, F.col("idx").cast("bigint").alias("frm")), count, seed, key)
    sizes = np.zeros((count + 1, 256), np.int64)
    for r in hashed.groupBy("perm", "_b").agg(F.count("*").alias("n")).collect():
        sizes[r["perm"], int(r["_b"], 16)] = r["n"]
    before = np.cumsum(sizes, axis=1) - sizes
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(sizes.sum() / TASK_ROWS))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms, froms, digests = [], [], []
        for batch in batches:
            perms.append(batch["perm"].to_numpy())
            froms.append(batch["frm"].to_numpy())
            fixed = batch["_h"].cast(pa.binary(16))
            digests.append(np.frombuffer(fixed.buffers()[1], ">u8", 2 * len(fixed), 16 * fixed.offset).astype(np.uint64).reshape(-1, 2))
        if not sum(map(len, perms)):
            return
        perm, frm, h = np.concatenate(perms), np.concatenate(froms), np.concatenate(digests)
        by = _digest_order(perm, h)
        perm, frm, bucket = perm[by], frm[by], (h[by, 0] >> np.uint64(56)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (perm[1:] != perm[:-1]) | (bucket[1:] != bucket[:-1])]))
        at = np.arange(len(perm)) - np.repeat(starts, np.diff(np.append(starts, len(perm)))) + before[perm, bucket]
        yield from pack(perm, at, frm).to_batches()

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["idx"].to_numpy()
            if len(at):
                yield from pack(np.zeros(len(at), np.int32), at, at).to_batches()

    ranked = hashed.repartition(tasks, "perm", "_b").select("perm", "frm", F.unhex(digest).alias("_h")).mapInArrow(order, schema)
    return ranked.unionByName(index.select(F.col("idx").cast("bigint").alias("idx")).mapInArrow(same, schema))
