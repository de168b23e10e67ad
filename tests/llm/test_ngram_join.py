import random
import re

import numpy as np
import pytest

from cellweave.llm import ngram_join as op
from cellweave.llm.common import connected_components
from cellweave.llm.prefix_tree import links
from cellweave.llm.shingles import word_hashes

from .conftest import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets: dict, num=75, den=100) -> dict:
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def agree(docs):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.ngram_join(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    return want


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at:at + rng.choice([0, 1, 1, 2])] = words(rng, rng.choice([0, 1, 2])).split()
    return " ".join(out)


def test_against_all_pairs(make):
    rng, texts = random.Random(11), []
    for size in (1, 3, 5, 6, 9, 14, 30, 80, 200):
        base = words(rng, size).split()
        texts += [edited(rng, base, rng.randint(0, max(1, size // 12))) for _ in range(12)]
    license_text = words(rng, 40)
    texts += [license_text + " " + words(rng, k) for k in (1, 2, 3, 8, 9, 10, 11, 30, 60)] + [license_text] * 3
    rng.shuffle(texts)
    assert len(set(agree(make(texts)).values())) < len(texts)


def test_awkward_rows(awkward, nothing):
    rows = op.ngram_join(awkward).collect()
    assert len(rows) == awkward.count()
    sets = {r.doc_id: shingles(r.text) for r in awkward.collect() if r.doc_id is not None}
    want = components(sets)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in rows if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in rows if r.doc_id is None] == [(len(sets[6]), want[6])]
    assert op.ngram_join(nothing).count() == 0
    kept = op.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        r.doc_id for r in awkward.collect() if r.doc_id is not None and want[r.doc_id] == r.doc_id)


def test_large_classes_are_split_and_joined_across(make, monkeypatch):
    """Near copies of one text around the threshold, in blocks of a few sets."""
    monkeypatch.setattr(op, "BLOCK_SETS", 6)
    rng = random.Random(5)
    base = words(rng, 70).split()
    agree(make([edited(rng, base, rng.randint(1, 4)) for _ in range(80)] + [words(rng, 50) for _ in range(20)]))


@pytest.mark.parametrize("seed", range(6))
def test_prefix_tree_links_connect_what_all_links_connect(seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(1, 10_000, 60).astype(np.uint64))
    sets = []
    for _ in range(50):
        keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.2])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(1, 10_000, rng.integers(1, 12)).astype(np.uint64)])))
    ids = np.arange(100, 150)
    found = links(ids, sets, 75, 100)
    want = components({int(i): frozenset(s.tolist()) for i, s in zip(ids, sets, strict=True)})
    root = {int(i): int(i) for i in ids}
    for a, b in found:
        x, y = frozenset(sets[a - 100].tolist()), frozenset(sets[b - 100].tolist())
        assert 100 * len(x & y) >= 75 * len(x | y)
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {i: new if r == old else r for i, r in root.items()}
    assert root == want and len(found) < len(sets)


def test_words_are_what_the_pattern_takes():
    data = "A\x0bb c d　e  é\x1cF\t".encode()
    found, at = word_hashes(np.array([0, 3, 3, len(data)]), np.frombuffer(data, np.uint8))
    assert at.tolist() == [0, 2, 2, 2 + len(re.findall(r"[^\x20\x09-\x0D]+", data[3:].decode()))] and len(found) == at[-1]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (7, None), (300, 299), (299, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
