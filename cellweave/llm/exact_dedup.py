"""Exact duplicates through a minimal perfect hash over historical digests."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

SHARD_KEYS = 2048
BUCKET_KEYS = 4
_MASK = (1 << 31) - 1
_STRIDE = 7919
_BLOCK = 4096
INDEX = "shard long, n long, seeds array<int>, digests array<binary>, keeps array<long>, sizes array<long>"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and slot words of digests (rows of 32 bytes): the second, third and fourth 32 bits, cut to 31."""
    words = digests.reshape(len(digests), 32)[:, 4:16].copy().view(">u4").astype(np.int64) & _MASK
    return words[:, 0], words[:, 1], words[:, 2] | 1


def perfect_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each bucket, and the slot of each digest; slots are a permutation of 0..n-1.

    Buckets are placed from the fullest; a bucket's displacement is the first that sends all its keys to free,
    different slots. Digests must be distinct.
    """
    n = len(digests)
    buckets = max(1, -(-n // BUCKET_KEYS))
    f1, f2, f3 = _words(digests)
    bucket = f1 % buckets
    seeds, slots, free = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    members = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(counts) - counts
    for b in np.argsort(-counts, kind="stable"):
        k = counts[b]
        if k == 0:
            break
        own, base = members[starts[b]:starts[b] + k], 0
        while True:
            d = np.arange(base, base + _BLOCK, dtype=np.int64)
            at = ((((f2[own][:, None] + d * _STRIDE) & _MASK) * f3[own][:, None]) >> 15) % n
            good = free[at].all(axis=0)
            if k > 1:
                good &= (np.diff(np.sort(at, axis=0), axis=0) != 0).all(axis=0)
            hit = int(np.argmax(good))
            if good[hit]:
                seeds[b], slots[own] = base + hit, at[:, hit]
                free[at[:, hit]] = False
                break
            base += _BLOCK
    return seeds, slots


def _build(key: tuple, table: pa.Table) -> pa.Table:
    digests = table["digest"].to_pylist()
    flat = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
    seeds, slots = perfect_hash(flat)
    order = np.argsort(slots)
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(digests)], pa.int64()),
        "seeds": pa.array([seeds.tolist()], pa.list_(pa.int32())), "digests": pa.array([[digests[i] for i in order]], pa.list_(pa.binary())),
        "keeps": pa.array([table["keep_id"].take(order).to_pylist()], pa.list_(pa.int64())),
        "sizes": pa.array([table["group_size"].take(order).to_pylist()], pa.list_(pa.int64())),
    })


def _word(digest, at: int):
    return F.conv(F.substring(digest, 1 + 8 * at, 8), 16, 10).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and text_sha256 of every row; a null text counts as empty."""
    return texts_of(docs).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def winners(marked: DataFrame) -> DataFrame:
    """One row per distinct digest: keep_id is the largest doc_id, group_size counts rows (pre-aggregated by Spark)."""
    return marked.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_index(history: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The index over (text_sha256, keep_id, group_size) rows of distinct digests, and its number of shards.

    Digests are dealt to shards of about ``shard_keys`` by their first 32 bits, so a shard is bounded whatever
    the input; a row holds a shard's displacements and slots: full digests and winner locators.
    """
    history = written(history)
    shards = max(1, -(-history.count() // shard_keys))
    keyed = history.select((_word(F.col("text_sha256"), 0) % shards).alias("shard"), F.unhex("text_sha256").alias("digest"), "keep_id", "group_size")
    return written(keyed.groupBy("shard").applyInArrow(_build, INDEX)), shards


def look_up(marked: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``marked`` with the winner's keep_id and group_size where its digest is in the index, else nulls.

    One equi-join on the shard; the slot is found by arithmetic and its full digest compared byte for byte.
    """
    bucket = _word(F.col("text_sha256"), 1).bitwiseAND(_MASK) % F.size("seeds")
    move = F.get("seeds", bucket.cast("int")).cast("long")
    x = (_word(F.col("text_sha256"), 2).bitwiseAND(_MASK) + move * _STRIDE).bitwiseAND(_MASK)
    slot = (F.shiftright(x * _word(F.col("text_sha256"), 3).bitwiseAND(_MASK).bitwiseOR(F.lit(1)), 15) % F.col("n")).cast("int")
    joined = marked.withColumn("shard", _word(F.col("text_sha256"), 0) % shards).join(index, "shard", "left")
    found = joined.withColumn("slot", slot).withColumn("member", F.coalesce(F.get("digests", F.col("slot")) == F.unhex("text_sha256"), F.lit(False)))
    return found.select(*marked.columns, "member", F.when(F.col("member"), F.get("keeps", F.col("slot"))).alias("keep_id"),
                        F.when(F.col("member"), F.get("sizes", F.col("slot"))).alias("group_size"))


def match(marked: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """keep_id and group_size of every row: members take the indexed winner, nonmembers group among themselves."""
    looked = written(look_up(marked, index, shards))
    outside = looked.where(~F.col("member")).drop("member", "keep_id", "group_size")
    own = outside.join(winners(outside), "text_sha256")
    return looked.where("member").drop("member").unionByName(own.select(*marked.columns, "keep_id", "group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``; the largest doc_id of equal texts stays.

    History is every digest met more than once, so the index holds the repeats and texts that occur once come out
    of the byte check as nonmembers. Null texts are empty texts and equal each other. Rows that repeat both id and
    text are one document and carry the same answer; a group of null ids only has keep_id null and is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    marked = written(digests(docs))
    index, shards = build_index(winners(marked).where("group_size > 1"))
    return match(marked, index, shards).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one stays for each text: the one with the largest doc_id."""
    digest, id_ = "__copy_digest", "__copy_id"
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))  # noqa: E731  one key for rows without id
    kept = exact_dedup(docs).where("kept").select(F.col("text_sha256").alias(digest), whole("doc_id").alias(id_)).distinct()
    marked = docs.withColumns({digest: F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), id_: whole("doc_id")})
    return marked.join(kept, [digest, id_], "left_semi").dropDuplicates([digest, id_]).drop(digest, id_)  # dealt by both keys, once
