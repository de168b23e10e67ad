"""Packed id matrices: best-fit-decreasing within bounded blocks, by a segment tree over capacities."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cellweave.session import ensure_checkpoint_dir

from .best_fit import CAPACITY, END_ID, cut
from .common import map_batches, texts_of
from .token_ids import ID, chunk_ids

#: Tokens gathered before a block is packed: bounds memory, and the sequences left open are at most a few a block.
BLOCK_TOKENS = 1 << 21
PACKED = ("sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>")


class CapacityTree:
    """A segment tree over remaining capacities 0..n: inner nodes count the open sequences below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.held.setdefault(room, []).append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and give (room, sequence) of the smallest room of at least ``need``, or None."""
        node = need + self.leaves
        while not self.count[node]:
            while node & 1:  # climb while there is nothing to the right below this parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            if node & (node - 1) == 0:
                return None
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of item numbers: longest items first, each into the fullest sequence that takes it."""
    tree, out = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            out.append([i])
            tree.add(capacity - lengths[i], len(out) - 1)
        else:
            out[found[1]].append(i)
            tree.add(found[0] - lengths[i], found[1])
    return out


def _rows(block: list[tuple[int | None, int, np.ndarray]], capacity: int, pad_id: int, dtype: np.dtype) -> Iterator[tuple]:
    for members in best_fit_decreasing([len(x[2]) for x in block], capacity):
        ids, positions, ends = np.full(capacity, pad_id, dtype), np.zeros(capacity, "<u2" if capacity <= 1 << 16 else "<u4"), [0]
        for i in members:
            piece = block[i][2]
            ids[ends[-1]:ends[-1] + len(piece)] = piece
            positions[ends[-1]:ends[-1] + len(piece)] = np.arange(len(piece))
            ends.append(ends[-1] + len(piece))
        yield ends[-1], ids.tobytes(), positions.tobytes(), ends, [block[i][0] for i in members], [block[i][1] for i in members]


def pack_matrices(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0,
                  vocabulary: int = 49408, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per sequence: a padded row of little-endian ids, positions that restart at each segment, segment bounds.

    Ids are 16 bits wide where the vocabulary allows, else 32; ``cu_seqlens`` holds 0 and the end of each segment,
    ``doc_ids`` and ``starts`` say which stretch of which document a segment is. A document is its ids and
    ``end_id`` (null and empty texts: that alone); longer ones than ``capacity`` are split without loss. Each task
    packs its stream in blocks of about ``block_tokens``, so nothing is shuffled and memory is bounded. Sequence ids
    are unique, with gaps. Repeated rows are packed as often as they occur; other columns are ignored.
    """
    dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def work(batches):
        ids_of, end = chunk_ids(tokenizer), np.array([end_id], dtype=ID).tobytes()
        number = TaskContext.get().partitionId() << 40

        def flush(block):
            nonlocal number
            rows = list(_rows(block, capacity, pad_id, dtype))
            for at in range(0, len(rows), 256):
                some = list(zip(*rows[at:at + 256], strict=True))
                ids = pa.array(range(number, number + len(some[0])), pa.int64())
                number += len(some[0])
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(some, kinds, strict=True))],
                                                 names=["sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"])

        block, tokens = [], 0
        for batch in batches:
            for doc_id, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.frombuffer(ids_of.of(value.as_py() or "") + end, dtype=ID)
                block += [(doc_id, start, piece) for start, piece in cut(ids, capacity)]
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from flush(block)
                    block, tokens = [], 0
        if block:
            yield from flush(block)
    return map_batches(texts_of(docs), work, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrix rows as Parquet files in a shared folder; each file is a stack of fixed-width rows."""
    packed.write.parquet(path)


def stored(packed: DataFrame) -> DataFrame:
    """The matrix rows, written once to the shared folder and reread from there."""
    spark = packed.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    write_packed(packed, path)
    return spark.read.schema(packed.schema).parquet(path)
