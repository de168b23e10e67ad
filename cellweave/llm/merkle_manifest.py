"""Merkle manifest of a dataset: ternary hash trees by source, and proofs that share what neighbouring leaves share."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

ARITY = 3
#: Levels that are computed with one shuffle, in groups of ARITY ** LEVELS nodes at most.
LEVELS = 6
#: Leaves that expand their proofs together.
LEAVES = 8192


def field(c: str) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    value = F.col(c).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(text: str = "text") -> Column:
    return F.sha2(F.concat(*(field(c) for c in ("doc_id", "source", "lang", "n_chars", text))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and shown: the leaf as it is shown for checking, tampered where 2 divides the id's crc32."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    cut = F.translate("text", "\n", "")
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return rows.withColumn("cut", cut).select("doc_id", "source", leaf_hash().alias("leaf"), F.when(changed, leaf_hash("cut")).alias("shown"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``at``, their place (from 0) in the given order: ranges are numbered each by itself and moved by the sizes before."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return own.join(before, "_part").withColumn("at", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def _above(n, level):
    """How many nodes stand ``level`` levels above ``n`` ones."""
    return F.floor((n + F.pow(F.lit(float(ARITY)), level) - 1) / F.pow(F.lit(float(ARITY)), level)).cast("long")


def _parents(below: Column) -> Column:
    """Hashes of the runs of ARITY neighbours of an array of hashes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def tree(base: DataFrame) -> DataFrame:
    """All nodes (tree, n, level, at, hash) over base nodes (tree, n, at, hash): n of them in each tree, at 0 to n - 1.

    A group of neighbouring nodes climbs LEVELS levels in array expressions with one shuffle, so a tree of any size
    takes few rounds and no task holds more than a group.
    """
    out = now = written(base.select("tree", "n", F.lit(0).alias("level"), "at", "hash"))
    low = 0
    while not now.where(_above(F.col("n"), F.lit(low)) > 1).isEmpty():
        wide = ARITY ** LEVELS
        groups = (now.where(_above(F.col("n"), F.lit(low)) > 1).groupBy("tree", "n", F.floor(F.col("at") / wide).alias("g"))
                  .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]).alias("a0")))
        for up in range(1, LEVELS + 1):
            below = F.col(f"a{up - 1}")
            climbs = (_above(F.col("n"), F.lit(low + up - 1)) > 1) & (F.size(below) > 0)
            groups = groups.withColumn(f"a{up}", F.when(climbs, _parents(below)).otherwise(F.array().cast("array<string>")))
        up = F.array(*(F.struct(F.lit(k).alias("up"), F.col(f"a{k}").alias("a")) for k in range(1, LEVELS + 1)))
        rows = groups.select("tree", "n", "g", F.explode(up).alias("u")).select("tree", "n", "g", "u.up", F.posexplode("u.a").alias("i", "hash"))
        first = F.col("g") * F.pow(F.lit(float(ARITY)), LEVELS - F.col("up")).cast("long")
        more = written(rows.select("tree", "n", (F.col("up") + low).alias("level"), (first + F.col("i")).alias("at"), "hash"))
        out, now, low = out.unionByName(more), more.where(F.col("level") == low + LEVELS), low + LEVELS
    return out


def missing(known: DataFrame) -> DataFrame:
    """(part, tree, level, at): the nodes that a part needs beside a run [lo, hi] of a tree's base nodes to derive its root.

    At each level the parents of what is known become known; what they lack are at most ARITY - 1 nodes on either side.
    """
    power = F.pow(F.lit(float(ARITY)), F.col("level")).cast("long")
    height = F.aggregate(F.sequence(F.lit(0), F.lit(40)), F.lit(0), lambda acc, k: acc + (_above(F.col("n"), k) > 1).cast("int"))
    levels = known.withColumn("level", F.explode(F.when(height > 0, F.sequence(F.lit(0), height - 1)).otherwise(F.array().cast("array<int>"))))
    lo, hi = F.floor(F.col("lo") / power), F.floor(F.col("hi") / power)
    first = F.floor(lo / ARITY) * ARITY
    last = F.least(F.floor(hi / ARITY) * ARITY + ARITY - 1, _above(F.col("n"), F.col("level")) - 1)
    some = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    return levels.select("part", "tree", "level", F.explode(F.concat(some(first, lo - 1), some(hi + 1, last))).alias("at"))


def _h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(lo: int, base: list[str], n: int, fetched: dict) -> list[tuple[int, list[str], int]]:
    """Of each level of a tree, from its base: the first place held, the hashes held and the level's size."""
    out = [(lo, base, n)]
    while n > 1:
        first = lo // ARITY * ARITY
        level = len(out) - 1
        last = min((lo + len(base) - 1) // ARITY * ARITY + ARITY, n)
        whole = [fetched[level, i] for i in range(first, lo)] + base + [fetched[level, i] for i in range(lo + len(base), last)]
        out[-1] = (first, whole, n)
        base = [_h(*whole[i:i + ARITY]) for i in range(0, len(whole), ARITY)]
        lo, n = first // ARITY, -(-n // ARITY)
        out.append((lo, base, n))
    return out


def _siblings(levels: list, at: int) -> list[tuple[list[str], list[str]]]:
    """Of each level, the other nodes of the run that holds ``at``: those before it and those after it."""
    out = []
    for first, held, n in levels[:-1]:
        run = at // ARITY * ARITY
        out.append((held[run - first:at - first], held[at - first + 1:min(run + ARITY, n) - first]))
        at //= ARITY
    return out


def _fold(leaf: str, path: list) -> str:
    for before, after in path:
        leaf = _h(*before, leaf, *after)
    return leaf


_PROOF = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                    ("proof", pa.list_(pa.string())), ("folded_root", pa.string()), ("verified", pa.bool_())])


def _expand(key: tuple, rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proofs of one part's leaves: interiors that they share are derived once from the leaves and the fetched nodes."""
    nodes: dict[int, dict] = {}
    for tree_, level, at, digest in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "at", "hash")), strict=True):
        nodes.setdefault(tree_, {})[level, at] = digest
    held: dict[int, list] = {}
    found = sorted(rows.select(["tree", "at", "n", "trees", "doc_id", "source", "leaf", "shown"]).to_pylist(), key=lambda r: (r["tree"], r["at"]))
    for r in found:
        held.setdefault(r["tree"], []).append(r)
    inner = {t: _levels(own[0]["at"], [r["leaf"] for r in own], own[0]["n"], nodes.get(t, {})) for t, own in held.items()}
    top = _levels(min(held), [inner[t][-1][1][0] for t in sorted(held)], found[0]["trees"], nodes.get(-1, {})) if held else []
    out = []
    for t, own in held.items():
        above = _siblings(top, t)
        for r in own:
            path = _siblings(inner[t], r["at"]) + above
            folded, root = _fold(r["shown"] or r["leaf"], path), top[-1][1][0]
            out.append((r["doc_id"], r["source"], r["leaf"], inner[t][-1][1][0], root, [d for before, after in path for d in before + after], folded, folded == root))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PROOF, strict=True)], schema=_PROOF)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof, folded_root, verified of every row of ``docs``.

    A leaf hashes doc_id, source, lang, n_chars and text. Of each source the leaves stand by doc_id (nulls first; rows that share
    an id by their leaves, and equal ones each for itself) and every three neighbours are hashed to one until one is left;
    so are the sources' roots, null source first. ``proof`` lists the siblings on the way up, left to right. folded_root
    folds the leaf as it is shown, tampered or not, with these siblings; verified says whether that is the root.
    Nulls are marked in the leaf and differ from empty texts. Other columns are ignored; an empty table gives no rows.

    Places come from ranges of (source, doc_id), so a source of any size is dealt to many tasks. Each run of LEAVES leaves states
    the nodes that it lacks, at most four a level and tree, gets them with one join and expands its proofs by itself.
    """
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = written(numbered(leaves(docs), *order).withColumnRenamed("at", "place"))
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    trees = written(numbered(sources, F.col("start")).select(F.col("source").alias("_s"), "n", "start", F.col("at").alias("tree")))
    count = trees.count()
    placed = written(rows.join(trees, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "leaf", "shown", "tree", "n", (F.col("place") - F.col("start")).alias("at"), F.floor(F.col("place") / LEAVES).alias("part"), F.lit(count).cast("long").alias("trees")))
    nodes = tree(placed.select("tree", "n", "at", F.col("leaf").alias("hash")))
    roots = nodes.where(_above(F.col("n"), F.col("level")) == 1).groupBy("tree").agg(F.min_by("hash", "level").alias("hash"))
    top = tree(roots.select(F.lit(-1).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("at"), "hash"))
    runs = placed.groupBy("part", "tree", "n").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    above = runs.groupBy("part").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).select("part", F.lit(-1).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), "lo", "hi")
    wanted = missing(runs).unionByName(missing(above))
    fetched = written(wanted.join(nodes.unionByName(top).drop("n"), ["tree", "level", "at"]).select("part", "tree", "level", "at", "hash"))
    schema = "doc_id long, source string, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    return placed.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_expand, schema)
