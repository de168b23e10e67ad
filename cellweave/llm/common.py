"""Shared helpers: written intermediates, Arrow maps over two columns, connected components."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import ensure_checkpoint_dir


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, with its lineage cut there.

    The folder is the one named by ``spark.checkpoint.dir``; a lost executor costs a re-read.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, the shuffle files of a query are removed as soon as it has ended, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` under a shorter name; ``work`` sees one partition as a stream of batches."""
    return df.mapInArrow(work, schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """Only the id and the text of documents, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the component is its smallest node.

    Alternating large-star and small-star rounds: each node's smallest neighbour is a partial aggregate, so a
    hub costs one row per task and not one task. Each round is written to the shared folder. Nodes may be of
    any orderable type; edges with a null end are ignored, self-loops and repeats do no harm.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    loops = now.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    now, seen = now.where("u <> v"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        # large star: neighbours above a node move to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(least, "u")
        now = written(low.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                      .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return tree.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
