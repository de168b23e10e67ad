import random
import zlib

import numpy as np
import pytest

from cellweave.llm import quality as op

from .conftest import words

LABELS = "doc_id long, quality int, toxic int, score double"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark, make):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(20, 90)) if i % 3 else " ".join(w + rng.choice(["%%%", "***", "$$$"]) for w in words(rng, 50).split()) for i in range(900)]
    return make(texts), spark.createDataFrame([(i, int(i % 3 > 0), 0, 0.1) for i in range(900)], LABELS)


def test_held_out_accuracy(corpus):
    rows = op.score(*corpus).collect()
    assert len(rows) == 900 and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in test) / len(test) > 0.95


def test_held_out_labels_are_never_read(spark, corpus):
    docs, labels = corpus
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if held_out(r.doc_id) else r.quality, 0, 0.1) for r in labels.collect()], LABELS)
    a, b = ({r.doc_id: r.score for r in op.score(docs, x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-12)


def test_training_rows_are_the_first_by_hash(corpus):
    docs, labels = corpus
    featured = op.features(docs, np.zeros((op.ROWS, op.DIMS), np.float32))
    every = op.training_rows(featured, labels, 10_000)
    assert op.training_rows(featured, labels, 100) == every[:100] and len(every) == sum(not held_out(i) for i in range(900))


def test_rejected_rows_go(corpus):
    docs, labels = corpus
    kept = {r.doc_id for r in op.drop_rejected(docs, labels).collect()}
    assert kept == {r.doc_id for r in op.score(docs, labels).collect() if r.predicted}


def test_awkward_rows_and_missing_labels(spark, awkward, nothing, corpus):
    none = spark.createDataFrame([], LABELS)
    rows = op.score(awkward, none).collect()
    assert len(rows) == awkward.count() and {r.score for r in rows} == {0.5} and all(r.held_out is False for r in rows if r.doc_id is None)
    odd = spark.createDataFrame([(3, None, None, None), (None, 1, 0, 0.0), (4, 7, 0, 0.0), (5, 1, 0, 0.0), (5, 1, 0, 0.0)], LABELS)
    assert len({r.score for r in op.score(awkward, odd).collect()}) == 1
    assert op.score(nothing, none).count() == 0
    kept = op.drop_rejected(awkward, none)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_context_sums_cover_every_text(make):
    """Plain sums over neighbours; texts do not touch each other."""
    texts = ["a b a", None, "", "b", "A c!! c"]
    docs = make(texts)
    place, sign = op.index_vectors()
    want = np.zeros((op.ROWS, op.DIMS))
    import pyarrow as pa
    for rows, at in op.word_rows(pa.array(texts)):
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            for i in range(lo, hi):
                for j in (i - 1, i + 1):
                    if lo <= j < hi:
                        np.add.at(want[rows[i]], place[rows[j]], sign[rows[j]])
    assert np.allclose(op.context_sums(docs.repartition(4)), want) and want.any()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, op.FEATURES))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    net = op.train(x[:200], y[:200])
    before = net.logits(x[200:])
    op.calibrate(net, x[200:], y[200:])
    loss = lambda z: np.logaddexp(0, np.where(y[200:] > 0, -z, z)).mean()
    assert loss(before / net.temperature) <= loss(before) + 1e-9
