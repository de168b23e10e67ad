import numpy as np

from cellweave.llm import ann as op

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score double, bucket int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 9, 0.5, 1) for i, v in rows], SCHEMA)


def brute(rows, every, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted((-float(op.exact_scores(good[q][None], v[None])[0]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def answer(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_small_tables_come_out_whole_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(1).tolist()) for i in range(12)] + [(i, [1.0, 0, 0, 0, 0]) for i in (20, 21, 40, 41)]
    rows += [(60, None), (61, []), (62, [0.0] * 5), (63, [1.0, None, 0, 0, 0]), (64, [float("nan")] * 5), (65, [float("inf"), 0, 0, 0, 0]), (80, [1.0, 2.0]), (None, [1.0] * 5)]
    for k in (3, 50):
        assert answer(op.search(table(spark, rows), query_every=4, k=k)) == {q: v for q, v in brute(rows, 4, k).items() if v}
    assert op.search(table(spark, [])).count() == 0
    assert answer(op.search(table(spark, rows + rows[:3]), query_every=4, k=5)) == {q: v for q, v in brute(rows, 4, 5).items() if v}


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    rows = list(enumerate(x.tolist()))
    got, want = answer(op.search(table(spark, rows), query_every=50, k=20)), brute(rows, 50, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_a_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(op, "BLOCK_QUERIES", 8)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(700)] + [(i, [4.0, float(i % 7), 0.0, 1.0]) for i in range(700, 800)]
    assert answer(op.search(table(spark, rows), query_every=25, k=6)) == brute(rows, 25, 6)


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(3).normal(size=(4, 16))
    assert np.allclose(np.linalg.norm(op.rotated(x, 2)[:, :16], axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(op.hadamard(op.hadamard(x)), x)
