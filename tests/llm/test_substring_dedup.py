import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import shingles
from cellweave.llm import substring_dedup as op

from .conftest import words


def by_definition(rows, window):
    """(doc_id, text) rows -> words, removed words and kept text, from every earlier start of every window."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - window + 1):
            place = (i is None, i or 0)
            key = tuple(w[s:s + window])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, w in split:
        gone, own = [False] * len(w), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in own or first[key] != (i is None, i or 0):
                gone[s:s + window] = [True] * window
            own.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def agree(docs, window):
    found = op.remove_repeats(docs, window).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=repr) == by_definition(rows, window)
    for r in found:
        spans = [(x.begin, x.end) for x in r.intervals]
        assert sum(e - b for b, e in spans) == r.n_removed and all(b - a > 0 for (_, a), (b, _) in zip(spans, spans[1:]))
    return found


@pytest.mark.parametrize("window", [1, 3, 20])
def test_against_definition(make, window):
    rng = random.Random(window)
    passages = [words(rng, n).split() for n in (window, window + 1, 2 * window, 30)]
    texts = []
    for _ in range(40):
        body = words(rng, rng.randint(0, 30)).split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n", "\t "]).join(body))
    texts += [texts[3], texts[3], "a a a a " * 30, "a " * 25]
    found = agree(make(texts, first=5), window)
    assert any(r.n_removed for r in found)


def test_awkward_rows(awkward, nothing):
    assert len(agree(awkward, 20)) == awkward.count()
    assert op.remove_repeats(nothing).collect() == []


def test_a_filter_that_is_full_changes_nothing(make, monkeypatch):
    """Few bits: all windows pass, and those that occur once stay."""
    monkeypatch.setattr(op, "FILTER_BITS", 1 << 15)
    rng = random.Random(2)
    passage = words(rng, 25)
    agree(make([words(rng, 900) for _ in range(40)] + [f"{words(rng, 5)} {passage} {words(rng, 5)}" for _ in range(5)]), 20)


def test_windows_that_share_their_first_hash_are_told_apart():
    own = pa.array([{"a": 7, "b": 1}, {"a": 7, "b": 2}, {"a": 9, "b": 3}], pa.struct([("a", pa.int64()), ("b", pa.int32())]))
    a, b = np.array([7, 7, 7, 9, 10], np.uint64), np.array([2, 1, 5, 3, 3], np.uint64) << np.uint64(32)
    assert op._member(a, b, own).tolist() == [True, True, False, True, False]
    assert op._firsts(np.array([1, 1, 1, 2], np.uint64), np.array([5, 6, 5, 5], np.uint64)).tolist() == [True, True, False, True]


def test_rolled_is_the_polynomial():
    w = np.random.default_rng(1).integers(0, 1 << 63, 60).astype(np.uint64)
    for n in (1, 2, 5, 20, 60):
        want = [sum(int(x) * pow(11, n - 1 - k, 1 << 64) for k, x in enumerate(w[i:i + n])) % (1 << 64) for i in range(61 - n)]
        assert op.rolled(w, n, 11).tolist() == shingles.mix(np.array(want, np.uint64)).tolist()
    assert len(op.rolled(w, 61, 11)) == 0


def test_runs_that_cross_pieces_hash_alike(monkeypatch):
    rng = random.Random(4)
    text = " ".join("x" * rng.randint(1, 90) + rng.choice("abc") for _ in range(300))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = shingles.word_hashes(np.array([0, len(data)]), data)[0]
    monkeypatch.setattr(shingles, "PIECE", 37)
    assert shingles.word_hashes(np.array([0, len(data)]), data)[0].tolist() == whole.tolist()


def test_memory_of_a_very_long_text():
    """50 MB as one text: under 1 GB, and nothing of that size is kept."""
    text = pa.array([b"some words and others " * 2_300_000], pa.binary()).cast(pa.string())
    tracemalloc.start()
    sizes = [len(s) for s in shingles.shingle_sets(text)]
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sizes == [4] and peak < 1_000_000_000 and now < 50_000_000
