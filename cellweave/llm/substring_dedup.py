"""Passages that repeat across documents: rolling hashes of every window of words, counted by Spark, merged to intervals."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shuffles_removed, texts_of, written
from .shingles import WORD_KIND, mix, run_hashes, runs, slices, text_buffers

WINDOW = 20
#: Bits of the filter of repeated windows that is sent to tasks: 16 MB at most, whatever the input. Beyond some twenty
#: million distinct repeated windows it lets more and more other windows through; they are grouped like the rest.
FILTER_BITS = 1 << 27
#: Multipliers of the two window hashes.
_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_CUT = np.uint64(16)


def rolled(words: np.ndarray, length: int, step: int) -> np.ndarray:
    """The polynomial of every ``length`` consecutive word hashes modulo 2**64, built by doubling.

    A polynomial of p + q words is that of the first p moved up by q places plus that of the other q.
    """
    out, done, part, width = None, 0, words, 1
    n = max(0, len(words) - length + 1)
    while width <= length:
        if length & width:
            out = part[:n].copy() if out is None else out * np.uint64(pow(step, width, 1 << 64)) + part[done:done + n]
            done += width
        if 2 * width <= length:
            part = part[:len(part) - width] * np.uint64(pow(step, width, 1 << 64)) + part[width:]
        width *= 2
    return mix(out)


class Windows:
    """Words and windows of one slice of texts."""

    def __init__(self, texts: pa.Array, window: int, both: bool = True):
        self.window = window
        self.offsets, self.data = text_buffers(texts)
        self.first, self.last = runs(self.offsets, WORD_KIND[self.data]) if len(self.data) else (np.zeros(0, np.int64),) * 2
        self.at = np.searchsorted(self.first, self.offsets)
        self.hashes = [rolled(run_hashes(self.first, self.last, self.data, lower=False, which=k), window, _STEPS[k]) if len(self.first) >= window else np.zeros(0, np.uint64)
                       for k in range(2 if both else 1)]

    def of(self, i: int, k: int = 0) -> np.ndarray:
        """Window hashes of text ``i`` by start."""
        return self.hashes[k][self.at[i]:max(self.at[i], self.at[i + 1] - self.window + 1)]

    def kept(self, i: int, gone: np.ndarray | None) -> bytes:
        """Words of text ``i`` not marked in ``gone``, joined by one space."""
        a, b = self.at[i], self.at[i + 1]
        first, last = self.first[a:b], self.last[a:b]
        if gone is not None:
            first, last = first[~gone], last[~gone]
        if not len(first):
            return b""
        base = first[0]
        body = self.data[base:last[-1] + 1].copy()
        body[last[:-1] + 1 - base] = 32
        change = np.zeros(len(body) + 1, np.int8)
        change[first - base] += 1
        change[last[:-1] + 2 - base] -= 1  # a word and the blank after it
        return body[np.cumsum(change[:-1], dtype=np.int8) > 0].tobytes()


def texts_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of at most about 2 MB of text; a longer text stands alone."""
    offsets, _ = text_buffers(batch["text"])
    for lo, hi in slices(offsets):
        yield batch.slice(lo, hi - lo)


def repeated_filter(docs: DataFrame, window: int) -> np.ndarray:
    """A bitmap with two bits set for every window that stands in two documents at least (a hash of 48 bits is counted)."""
    def work(batches):
        for batch in batches:
            for part in texts_slices(batch):
                seen = Windows(part["text"], window, both=False)
                own = np.sort(np.concatenate([np.unique(seen.of(i)) for i in range(len(part))]) >> _CUT)
                third = np.zeros(len(own), bool)
                third[2:] = own[2:] == own[:-2]  # two tell all that is asked
                yield pa.RecordBatch.from_arrays([pa.array(own[~third].astype(np.int64))], names=["h"])
    # nearly all hashes differ, so they are dealt as they are: a map-side aggregate would only spill
    shared = map_batches(docs, work, "h long").repartition("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = shared.select(F.explode(F.array(F.col("h").bitwiseAND(FILTER_BITS - 1), F.shiftright("h", 21).bitwiseAND(FILTER_BITS - 1))).alias("slot"))
    blocks = slots.groupBy(F.shiftright("slot", 15).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in blocks.collect():  # FILTER_BITS / 32768 rows of 4 kB at most
        bits[row["block"] * 4096:(row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _hits(bits: np.ndarray, a: np.ndarray) -> np.ndarray:
    h, last, out = a >> _CUT, np.uint64(8 * len(bits) - 1), np.ones(len(a), bool)
    for slot in (h & last, (h >> np.uint64(21)) & last):
        out &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def _firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each window is the first of its hashes in its document."""
    out = np.zeros(len(a), bool)
    out[np.unique(a, return_index=True)[1]] = True
    if out.all():
        return out
    order = np.lexsort((b, a))  # stable: equal ones by start
    change = np.ones(len(a), bool)
    change[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out[:] = False
    out[order[change]] = True
    return out


def first_places(docs: DataFrame, bits: np.ndarray, window: int) -> DataFrame:
    """(doc_id, own): for each doc_id the windows, of those the filter lets through, that stand in no smaller one.

    Windows are compared by 96 bits of two hashes. The least document of a window is a partial aggregate, so one that
    stands in a third of all documents costs a row per task. Rows without id come after all others.
    """
    def work(batches):
        for batch in batches:
            for part in texts_slices(batch):
                seen, rows, found = Windows(part["text"], window), [], []
                for i in range(len(part)):
                    a, b = seen.of(i), seen.of(i, 1)
                    at = np.flatnonzero(_hits(bits, a))
                    at = at[_firsts(a[at], b[at])]
                    rows.append(np.full(len(at), i))
                    found.append((a[at], b[at]))
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"].take(pa.array(np.concatenate(rows))), pa.array(np.concatenate([a for a, _ in found]).view(np.int64)),
                    pa.array((np.concatenate([b for _, b in found]) >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["doc_id", "a", "b"])
    least = map_batches(docs, work, "doc_id long, a long, b int").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    return least.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("own"))  # one document's own windows


def _member(a: np.ndarray, b: np.ndarray, own: pa.StructArray) -> np.ndarray:
    """Whether each window (a, upper half of b) is among a document's own ones."""
    own_a, own_b = own.field("a").to_numpy(zero_copy_only=False).view(np.uint64), own.field("b").to_numpy(zero_copy_only=False).view(np.uint32)
    order = np.argsort(own_a, kind="stable")
    own_a, own_b, half = own_a[order], own_b[order], (b >> np.uint64(32)).astype(np.uint32)
    at, out, shift = np.searchsorted(own_a, a), np.zeros(len(a), bool), 0
    while True:  # more than one turn only where two windows share the first hash
        place = np.minimum(at + shift, len(own_a) - 1)
        out |= (own_a[place] == a) & (own_b[place] == half)
        shift += 1
        if not (own_a[shift:] == own_a[:-shift]).any():
            return out


def merged(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [begin, end) of words covered by the windows at ascending ``starts``."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts) > window) + 1
    return starts[np.concatenate([[0], new])], starts[np.concatenate([new - 1, [len(starts) - 1]])] + window


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, intervals and kept_text of every row of ``docs``.

    Words are runs of characters other than 0x20 and 0x09-0x0D. A word goes if it lies in a window of ``window``
    consecutive words whose sequence also starts earlier: in a smaller doc_id, or before in the same text. ``intervals``
    are the maximal runs of such words, as [begin, end) word numbers; ``kept_text`` are the other words joined by one space.
    Null, empty and blank texts have no words; texts shorter than a window stay whole. Of equal texts the one with the
    smallest doc_id stays. Rows without id come after all others; rows that share an id (or have none) are one
    place, and what stands only among them stays. Other columns are ignored; an empty table gives no rows.
    """
    docs = texts_of(docs)
    with shuffles_removed(docs.sparkSession):
        bits = repeated_filter(docs, window)
        own = written(first_places(docs, bits, window))

    def work(batches):
        for batch in batches:
            for part in texts_slices(batch):
                seen, rows = Windows(part["text"], window), []
                for i in range(len(part)):
                    a, b, n = seen.of(i), seen.of(i, 1), int(seen.at[i + 1] - seen.at[i])
                    late, mine = ~_firsts(a, b), part["own"][i]
                    hit = np.flatnonzero(_hits(bits, a) & ~late)
                    if len(hit):
                        late[hit if not mine.is_valid else hit[~_member(a[hit], b[hit], mine.values)]] = True
                    begin, end = merged(np.flatnonzero(late), window)
                    gone = None
                    if len(begin):
                        gone = np.zeros(n + 1, np.int32)
                        gone[begin] += 1
                        gone[end] -= 1
                        gone = np.cumsum(gone[:-1]) > 0
                    rows.append((n, int((end - begin).sum()), [{"begin": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)], seen.kept(i, gone)))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *arrays[:3], arrays[3].cast(pa.string())], names=["doc_id", "n_words", "n_removed", "intervals", "kept_text"])
    named = own.withColumnRenamed("doc_id", "_id")
    joined = docs.join(named, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "own")
    return map_batches(joined, work, "doc_id long, n_words long, n_removed long, intervals array<struct<begin:long,end:long>>, kept_text string")
