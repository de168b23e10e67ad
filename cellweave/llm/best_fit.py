"""Bulk-synchronous best-fit packing of all documents into sequences of bounded length."""
from __future__ import annotations

import bisect
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, texts_of, written
from .token_ids import ID, chunk_ids

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def cut(ids: np.ndarray, capacity: int):
    """(start, piece) of a document's ids: only a longer one is cut, and only its last piece may be shorter."""
    for start in range(0, len(ids), capacity):
        yield start, ids[start:start + capacity]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in the same task."""
    def work(batches):
        ids_of, end = chunk_ids(tokenizer), np.array([end_id], dtype=ID).tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.frombuffer(ids_of.of(value.as_py() or "") + end, dtype=ID)
                for n, (start, piece) in enumerate(cut(ids, capacity)):
                    rows.append((doc_id, n, start, len(piece), zlib.crc32(piece.tobytes()), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])
    return map_batches(texts_of(docs), work, PIECES)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the ranked pieces of each length go: runs (length, rank_from, count, sequence_from, offset).

    Pieces and gaps are range-sorted and held as runs of equals. A superstep takes the longest pieces left: a
    successor search finds the smallest gap that takes them, both runs are matched by rank (the lower rank gets the
    lower sequence), the matched gaps shrink and go back into the sorted gaps; pieces without a gap open sequences.
    Runs are split only where pieces or gaps run out and when sequences are opened, so their number is bounded by
    the number of lengths (at most ``capacity``), not by that of documents.
    """
    gaps: dict[int, deque] = defaultdict(deque)
    sizes: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(size: int, first: int, n: int) -> None:
        if size > 0 and n > 0:
            if not gaps[size]:
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                new = -(-left // each)
                last = left - (new - 1) * each
                for layer in range(each):
                    n = new if layer < last else new - 1
                    if n:
                        plan.append((length, rank, n, opened, layer * length))
                        rank += n
                put(capacity - each * length, opened, new - 1)
                put(capacity - last * length, opened + new - 1, 1)
                opened, left = opened + new, 0
                continue
            size = sizes[at]
            first, n = gaps[size].popleft()
            taken = min(left, n)
            plan.append((length, rank, taken, first, capacity - size))
            rank, left = rank + taken, left - taken
            if taken < n:
                gaps[size].appendleft((first + taken, n - taken))
            elif not gaps[size]:
                sizes.pop(at)
            put(size - length, first, taken)
    columns = np.array(plan, dtype=np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return dict(zip(("length", "rank_from", "count", "sequence_from", "offset"), columns.T, strict=True))


def place(ranked: DataFrame, plan: dict[str, np.ndarray]) -> DataFrame:
    """Sequence and offset of every ranked piece, by search in the runs of its length."""
    keys = (plan["length"] << 44) + plan["rank_from"]
    rank_from, sequence_from, offset = plan["rank_from"], plan["sequence_from"], plan["offset"]

    def work(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence_from[run] + rank - rank_from[run]), pa.array(offset[run])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return map_batches(ranked, work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A document is its ids and ``end_id``, so null and empty texts are one token long; longer documents than
    ``capacity`` are cut losslessly. Ranks within a length are task-local counts plus the counts of the tasks
    before, so one very frequent length needs no task of its own. Repeated rows are packed as often as they occur;
    other columns are ignored; an empty table gives no rows.
    """
    cut_up = written(pieces(docs, tokenizer, capacity, end_id))
    per_part = cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = per_part.select("part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    ranked = cut_up.join(before.drop("n"), ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    return place(ranked, sweep(counts, capacity))
