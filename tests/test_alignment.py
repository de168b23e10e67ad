"""Results that are equal up to signs, a rotation or cluster names, and results that are not."""
from itertools import permutations

import numpy as np
import pytest

from cellweave.operators import alignment as A

VECTORS = "cell_id bigint, embedding array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], VECTORS)


def test_signs_are_chosen_per_component(spark):
    x = np.random.default_rng(1).normal(size=(50, 4))
    flipped = x * [-1, 1, -1, 1]
    assert A.sign_mismatch(frame(spark, flipped), frame(spark, x)).count() == 0
    flipped[7, 2] += 1e-4
    (row,) = A.sign_mismatch(frame(spark, flipped), frame(spark, x)).collect()
    assert (row["cell_id"], row["component"], row["stored"]) == (7, 2, flipped[7, 2]) and row["recomputed"] == -x[7, 2]


def test_rotations_are_undone(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(80, 5)), np.linalg.qr(rng.normal(size=(5, 5)))[0]
    assert A.rotation_mismatch(frame(spark, x @ q), frame(spark, x)).count() == 0
    assert np.allclose(A.rotation(frame(spark, x @ q), frame(spark, x)), q)
    moved = x @ q
    moved[3] += 1e-2
    worst = A.rotation_mismatch(frame(spark, moved), frame(spark, x), 1e-3).collect()
    assert [r["cell_id"] for r in worst] == [3] and worst[0]["residual"] == pytest.approx(1e-2 * 5 ** 0.5, rel=0.1)


def test_rows_that_cannot_be_compared_are_reported(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [0.0, 0.0])], VECTORS)
    b = spark.createDataFrame([(i, [1.0, 2.0]) for i in (1, 2, 3, 4, 5, 7)], VECTORS)
    assert sorted(r["cell_id"] for r in A.sign_mismatch(a, b).collect() if r["component"] is None) == [2, 3, 4, 5, 6, 7]
    assert sorted(r["cell_id"] for r in A.rotation_mismatch(a, b).collect() if r["residual"] is None) == [2, 3, 4, 5, 6, 7]
    assert A.sign_mismatch(a.limit(0), b.limit(0)).count() == A.rotation_mismatch(a.limit(0), b.limit(0)).count() == 0


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3), (1, 1)])
def test_matching_is_the_best_of_all(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        counts = rng.integers(0, 9, shape)
        wide = counts if shape[0] <= shape[1] else counts.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
        got = A.best_matching(counts)
        kept = got[got >= 0]
        assert len(set(kept)) == len(kept) and sum(counts[i, j] for i, j in enumerate(got) if j >= 0) == best


def test_renamed_clusters_match(spark):
    stored = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)] + [(30, None), (31, "z")], "cell_id bigint, cluster string")
    again = spark.createDataFrame([(i, {0: 7, 1: 5, 2: 6}[0 if i == 1 else i % 3]) for i in range(31)], "cell_id bigint, cluster int")
    got = {r["stored"]: (r["recomputed"], r["agreeing"], r["disagreeing"]) for r in A.match_names(stored, again).collect()}
    assert got == {"a": ("7", 10, 0), "b": ("5", 9, 1), "c": ("6", 10, 0), "z": (None, 0, 1), None: (None, 0, 1)}
