"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network with a calibrated temperature."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of, written
from .shingles import mix, slices, spans_hashes, text_buffers

#: Words fall into this many hashed rows of this many dimensions, so the table has one size (4 MB) for any corpus.
ROWS, DIMS, NONZERO = 1 << 15, 32, 4
BLOCK_ROWS = 1 << 10
FEATURES = 2 * DIMS + 1
THRESHOLD = 0.3
#: At most so many labelled rows, the first by a hash of their id, are brought to the driver for training.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 0.01, 1e-4


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few non-zero entries of each row's random index vector, from a hash of the row."""
    h = mix(np.arange(1, ROWS * NONZERO + 1, dtype=np.uint64)).reshape(ROWS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def word_rows(texts: pa.Array):
    """For slices of texts: table rows of all words in order, and the index of each text's first word (n + 1 long).

    Words are runs of letters, digits and non-ASCII bytes, and runs of ASCII marks, with A-Z lower-cased.
    """
    offsets, data = text_buffers(texts)
    for lo, hi in slices(offsets):
        own = offsets[lo:hi + 1]
        hashes, at = spans_hashes(own - own[0], data[own[0]:own[-1]])
        yield (hashes >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64), at


def context_sums(docs: DataFrame) -> np.ndarray:
    """The sum, over all words of all whole texts, of the index vectors of the words beside them.

    Each task sums into one table of fixed size; blocks of tables are added where they meet, as a stream, and the
    one table (ROWS x DIMS) comes to the driver.
    """
    def gather(batches):
        place, sign = index_vectors()
        total = np.zeros(ROWS * DIMS)
        for batch in batches:
            for rows, at in word_rows(batch["text"]):
                same = np.ones(max(0, len(rows) - 1), bool)
                inner = at[1:-1]
                same[inner[(inner > 0) & (inner < len(rows))] - 1] = False
                left, right = rows[:-1][same], rows[1:][same]
                for word, near in ((left, right), (right, left)):
                    total += np.bincount((word[:, None] * DIMS + place[near]).ravel(), sign[near].ravel(), ROWS * DIMS)
        blocks = total.astype(np.float32).reshape(-1, BLOCK_ROWS * DIMS)
        used = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch["block"].to_pylist(), batch["sums"], strict=True):
                if block not in held:
                    held[block] = np.zeros(BLOCK_ROWS * DIMS)
                held[block] += np.frombuffer(sums.as_py(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "sums"])

    kind = "block int, sums binary"
    merged = map_batches(map_batches(texts_of(docs), gather, kind).repartition(ROWS // BLOCK_ROWS, "block"), add, kind)
    out = np.zeros((ROWS // BLOCK_ROWS, BLOCK_ROWS * DIMS))
    for r in merged.collect():  # one table of fixed size
        out[r["block"]] = np.frombuffer(r["sums"], np.float64)
    return out.reshape(ROWS, DIMS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors of the context sums; rows without context are zero."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(norm > 0, sums / np.maximum(norm, 1e-12), 0.0).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the logarithm of its length in words; zeros without words."""
    out = []
    for rows, at in word_rows(texts):
        n = np.diff(at)
        features = np.zeros((len(n), FEATURES), np.float32)
        full = n > 0
        if full.any():
            found = vectors[rows]
            count = n[full, None].astype(np.float32)
            mean = np.add.reduceat(found, at[:-1][full], axis=0) / count
            square = np.add.reduceat(found * found, at[:-1][full], axis=0) / count
            features[full, :DIMS] = mean
            features[full, DIMS:2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
            features[full, -1] = np.log1p(n[full])
        out.append(features)
    return np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)


@dataclass
class Network:
    """Standardised features, one hidden layer, one logit over a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def constant(rate: float) -> Network:
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss with weight decay; with one label only, or none, the score is the constant (n1 + 1) / (n + 2)."""
    if len(y) == 0 or y.min() == y.max():
        return constant((y.sum() + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    net = Network(x.mean(0), x.std(0) + 1e-3, rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    z, parts = (x - net.centre) / net.scale, [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at:at + BATCH]
            hidden = np.tanh(z[own] @ parts[0] + parts[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3], -40, 40))) - y[own]) / len(own)
            back = np.outer(error, parts[2]) * (1 - hidden ** 2)
            grads = [z[own].T @ back + DECAY * parts[0], back.sum(0), hidden.T @ error + DECAY * parts[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """Sets the temperature (0.25 to 8) of least log loss on rows that the training did not see."""
    if len(y):
        logits = net.logits(x)
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(-1))


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    def work(batches):
        for batch in batches:
            rows = pooled(batch["text"], vectors).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "features"])
    return map_batches(texts_of(docs), work, "doc_id long, features binary")


def training_rows(featured: DataFrame, labels: DataFrame, train_rows: int) -> list:
    """The first ``train_rows`` labelled rows outside the held-out fold by a hash of their id, brought to the driver.

    With more rows than that, those beyond a hash bound that lets about a third more pass are left out first, so
    what tasks send stays bounded.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(_fold() > 0)
    known = known.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    there = featured.select("doc_id").join(known, "doc_id").count()
    if 3 * there > 4 * train_rows:
        known = known.where(F.col("at") < int((1 << 40) * 4 * train_rows / (3 * there)))
    some = featured.join(known, "doc_id").select("at", "doc_id", _fold().alias("fold"), "label", "features").collect()
    return sorted(some)[:train_rows]


def fit(featured: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network:
    """Trains on labelled rows whose crc32 of the id mod 5 is 1 to 3 and calibrates on 4; rows of 0 are never read."""
    some = training_rows(featured, labels, train_rows)
    x = np.array([np.frombuffer(r["features"], "<f4") for r in some], dtype=np.float64).reshape(-1, FEATURES)
    y, fold = np.array([r["label"] for r in some], dtype=np.float64), np.array([r["fold"] for r in some])
    return calibrate(train(x[fold < 4], y[fold < 4]), x[fold == 4], y[fold == 4])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text of ``docs``.

    Word vectors are summed over all texts; only the text is an input of a score. Null and empty texts get the score
    of a text without words. Without labels of both kinds the score is constant. Repeated rows get equal scores;
    rows without id are scored and never held out; other columns are ignored.
    """
    featured = written(features(docs, word_vectors(context_sums(docs))))
    net = fit(featured, labels, train_rows)

    def work(batches):
        for batch in batches:
            x = np.array([np.frombuffer(b.as_py(), "<f4") for b in batch["features"]], dtype=np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(net.scores(x))], names=["doc_id", "score"])
    scored = map_batches(featured, work, "doc_id long, score double")
    return scored.select("doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is at least ``threshold``."""
    vectors = word_vectors(context_sums(docs))
    net = fit(written(features(docs, vectors)), labels, train_rows)

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(net.scores(pooled(batch["text"], vectors)) >= threshold))
    return docs.mapInArrow(work, docs.schema)
