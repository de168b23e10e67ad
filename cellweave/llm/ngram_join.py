"""Exact n-gram Jaccard join of all documents: candidate classes by shared rare shingles, prefix trees within them."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_batches, texts_of, written
from .prefix_tree import links
from .shingles import shingle_sets, slices, text_buffers

NUM, DEN = 75, 100
#: Share of the hash space whose shingles are counted over the corpus, in eighths; above 1 - NUM/DEN.
SAMPLE_EIGHTHS = 3
#: Sets and shingles of a block, about; larger candidate classes are split.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_500_000
#: Bits of the two filters that are sent to tasks: 8 MB each, whatever the input.
FILTER_BITS = 1 << 26
_HASH = 48
_SAMPLE_END = (SAMPLE_EIGHTHS << _HASH) // 8


def need(n, num: int = NUM, den: int = DEN):
    """The least overlap of a set of n elements with any set it links to."""
    return -(-num * n // den)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def _parts(batch: pa.RecordBatch, texts: int = 1 << 21):
    """Neighbouring rows of at most so many bytes of text; a longer text stands alone."""
    offsets, _ = text_buffers(batch["text"])
    for lo, hi in slices(offsets, texts):
        yield batch.slice(lo, hi - lo)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit signature of the shingle set of every whole text."""
    def work(batches):
        for batch in batches:
            found = [(len(s), _signature(s)) for s in shingle_sets(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([g for _, g in found], pa.binary())],
                                             names=["doc_id", "n_shingles", "sig"])
    return map_batches(texts_of(docs), work, "doc_id long, n_shingles long, sig binary")


def _pack(h: np.ndarray) -> bytes:
    return (h >> np.uint64(64 - _HASH)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def samples(docs: DataFrame, num: int, den: int) -> DataFrame:
    """Per document its size and its lowest shingle hashes: those in the sampled share, and at least a prefix.

    Hashes are cut to 48 bits here: where two meet, candidates are only added.
    """
    end = np.uint64(_SAMPLE_END << (64 - _HASH))

    def work(batches):
        for part in (p for batch in batches for p in _parts(batch)):
            rows = []
            for s in shingle_sets(part["text"]):
                q = int(np.searchsorted(s, end))
                rows.append((len(s), _signature(s), q, _pack(s[:max(q, len(s) - need(len(s), num, den) + 1)])))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n", "sig", "q", "sample"])
    return map_batches(texts_of(docs), work, "doc_id long, n long, sig binary, q long, sample binary")


def bit_filter(keys: DataFrame, slot) -> DataFrame:
    """(block, bits): a bitmap of FILTER_BITS bits with the slots of all keys set; at most FILTER_BITS / 32768 rows."""
    slots = keys.select(F.pmod(slot, F.lit(FILTER_BITS)).alias("slot"))
    return slots.groupBy(F.shiftright("slot", 15).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits"))


def shared_rows(nodes: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """Sampled hashes, likely shared, of the sets that can have a link: all but so many of its sampled hashes must be shared."""
    blocks = {r["block"]: r["bits"] for r in bit_filter(shared, F.col("h")).collect()}  # at most 8 MB
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, body in blocks.items():
        bits[block * 4096:(block + 1) * 4096] = np.frombuffer(body, np.uint8)

    def work(batches):
        for batch in batches:
            at, hashes = [], []
            for i, (n, q, sample) in enumerate(zip(batch["n"].to_pylist(), batch["q"].to_pylist(), batch["sample"], strict=True)):
                h = _unpack(sample.as_py())
                slot = h & (FILTER_BITS - 1)
                hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                if hit.any() and int(hit[:q].sum()) >= q - (n - need(n, num, den)):
                    hashes.append(h[hit])
                    at.append(np.full(len(hashes[-1]), i))
            rows = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in ("node", "s", "n", "q")), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))],
                                             names=["node", "s", "n", "q", "h"])
    return map_batches(nodes, work, "node long, s long, n long, q long, h long")


def _hashes(batches):
    for batch in batches:
        for at in range(0, len(batch), 512):
            some = [_unpack(b.as_py()) for b in batch["sample"][at:at + 512]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some))], names=["h"])


def candidate_classes(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, node, s, n): sets that share a prefix shingle meet under the smallest node of that shingle.

    The global order puts sampled shingles first, the rarest before others, so prefixes hold the shingles that
    fewest sets share; two sets with a link share a prefix shingle, and so a class.
    """
    shared = written(map_batches(nodes.select("sample"), _hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    rows = shared_rows(nodes, shared, num, den).join(shared, "h")
    inside = F.col("h") < _SAMPLE_END
    per_set = rows.groupBy("node", "s", "n", "q").agg(F.sum(inside.cast("long")).alias("c"), F.collect_list(F.struct((~inside).alias("late"), "df", "h")).alias("own"))  # one set's own rows
    spare = F.expr(f"n - cast(ceil({num} * n / {den}) as bigint)")
    prefix = spare + 1
    taken = F.when(F.col("q") >= prefix, F.greatest(prefix - (F.col("q") - F.col("c")), F.lit(0))).otherwise(F.size("own").cast("long"))
    first = (per_set.where(F.col("c") >= F.col("q") - spare)
             .select("node", "s", "n", F.explode(F.slice(F.array_sort("own"), F.lit(1), taken.cast("int"))["h"]).alias("h")))
    first = written(first)
    leaders = (first.groupBy("h").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"))
               .where(f"sets > 2 or sets = 2 and {den} * least >= {num} * most").select("h", "leader"))  # two sets of sizes too far apart have no link
    return written(first.join(leaders, "h").select("leader", "node", "s", "n").distinct())


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, s, body) with the whole shingle sets of the documents in classes, and a few others that the filter lets through."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    blocks = bit_filter(classes.select(F.col("node").alias("doc_id")).distinct(), F.xxhash64("doc_id"))
    place = F.col("slot").bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    kept = (texts_of(docs).withColumn("slot", slot).join(F.broadcast(blocks), F.shiftright("slot", 15).cast("int") == F.col("block"))  # at most 8 MB
            .where(F.call_function("shiftright", byte, place.bitwiseAND(7)).bitwiseAND(1) == 1).select("doc_id", "text"))

    def work(batches):
        for part in (p for batch in batches for p in _parts(batch)):
            rows = [(_short(_signature(s)), s.tobytes()) for s in shingle_sets(part["text"])]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["node", "s", "body"])
    return map_batches(kept, work, "node long, s long, body binary").dropDuplicates(["node", "s"])  # a row may be repeated


def _short(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "big", signed=True)


def _block_links(num: int, den: int):
    def of_block(table: pa.Table) -> pa.Table:
        ids = table["node"].to_numpy()
        found = links(ids, [np.frombuffer(b.as_py(), np.uint64) for b in table["body"]], num, den) if len(ids) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
    return of_block


def set_links(classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between nodes that connect what all links connect.

    A class that is too large is dealt to chunks, each with the class's leader. Chunks are joined within
    themselves first; then the sets that are not yet in the leader's component meet all sets of the other chunks.
    """
    size = classes.groupBy("leader").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("chunks"), F.count(F.lit(1)).alias("sets"))
    dealt = written(classes.join(size.where("sets > 1").drop("sets"), "leader").withColumn("chunk", F.pmod(F.xxhash64("node", "s"), F.col("chunks"))))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    everywhere = dealt.withColumn("chunk", F.explode(F.when(F.col("node") == F.col("leader"), numbers).otherwise(F.array("chunk"))))
    joined = lambda rows, *key: rows.join(sets, ["node", "s"]).select(*key, "node", "body").groupBy(*key).applyInArrow(_block_links(num, den), "a long, b long")
    found = written(joined(everywhere, "leader", "chunk").distinct())
    split = dealt.where("chunks > 1")
    if split.isEmpty():
        return found
    groups = written(connected_components(found))
    label = split.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = label.where("node = leader").groupBy("leader").agg(F.min("component").alias("head"))
    marked = written(label.join(heads, "leader").withColumn("loose", F.col("component") != F.col("head")).drop("component", "head"))
    loose_chunks = marked.where("loose").select("leader", F.col("chunk").alias("i")).distinct()
    left = marked.where("loose").select("leader", "node", "s", F.col("chunk").alias("i"), F.explode(numbers).alias("j")).where("i <> j")
    right = marked.join(loose_chunks, "leader").where("i <> chunk").select("leader", "node", "s", "i", F.col("chunk").alias("j"))
    return written(found.unionByName(joined(left.unionByName(right), "leader", "i", "j")).distinct())


def ngram_join(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when den * intersection >= num * union of their sets of distinct five-word shingles (fewer
    words: the whole sequence as one; null, empty or blank texts: an empty set, linked with nothing). component_id
    is the smallest doc_id reachable by links, the document's own included. Equal sets are joined by signature and
    stand as one set afterwards, so copies cost nothing more. Rows without id get the component of their copies,
    else null; repeated rows are answered as often as they occur. Ids are taken to be unique: rows that share an id
    and not a text are answered each by its text, and texts that have the same smallest id share a component.
    Other columns are ignored; an empty table gives no rows.
    """
    marked = written(signatures(docs))
    copies = written(marked.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("node")).where("node is not null"))
    sampled = samples(docs, num, den).where("n > 0")
    nodes = written(sampled.join(copies.withColumnRenamed("node", "doc_id"), ["sig", "doc_id"]).dropDuplicates(["sig", "doc_id"])
                    .select(F.col("doc_id").alias("node"), F.expr("cast(conv(substring(hex(sig), 1, 16), 16, -10) as bigint)").alias("s"), "n", "q", "sample"))
    classes = candidate_classes(nodes, num, den)
    groups = connected_components(set_links(classes, full_sets(docs, classes), num, den))
    named = copies.join(groups, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    return marked.join(named, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, without those whose component has a smaller doc_id; rows without id stay."""
    key = "__near_copy"
    gone = ngram_join(docs, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(key), "left_anti")
