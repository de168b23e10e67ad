import hashlib
from collections import defaultdict

import numpy as np
import pytest

from cellweave.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_against_brute_force(awkward):
    got = sorted((tuple(r) for r in op.exact_dedup(awkward).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()])


def test_empty_table(nothing):
    assert op.exact_dedup(nothing).count() == 0 and op.drop_copies(nothing).columns == nothing.columns


def test_one_row_of_each_text_stays(awkward):
    kept = op.drop_copies(awkward)
    rows, before = kept.collect(), awkward.collect()
    assert kept.columns == awkward.columns and len(rows) == len({r.text or "" for r in before}) == len({r.text or "" for r in rows})
    largest = {}
    for r in before:
        largest[r.text or ""] = max(largest.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert all(r.doc_id == largest[r.text or ""] for r in rows)


@pytest.mark.parametrize("n", [1, 2, 5, 300, 2500])
def test_the_hash_is_minimal_and_perfect(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), dtype=np.uint8).reshape(n, 32)
    _, slots = op.perfect_hash(digests)
    assert sorted(slots) == list(range(n))


def test_a_later_batch_meets_the_history(spark, make):
    """Members of the index get its winner, strangers group among themselves."""
    history = op.winners(op.digests(make(["a", "b", "b", "c"])))
    index, shards = op.build_index(history, shard_keys=2)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in op.match(op.digests(make(["b", "x", "x", None, "c"], first=10)), index, shards).collect()}
    assert got == {10: (2, 2), 11: (12, 2), 12: (12, 2), 13: (13, 1), 14: (3, 1)}


def test_hot_group_over_many_rows(make):
    rows = op.exact_dedup(make(["same"] * 3000 + [f"t{i}" for i in range(1000)])).groupBy("keep_id").count().collect()
    assert max(r["count"] for r in rows) == 3000 and len(rows) == 1001
