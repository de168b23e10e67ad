import random
import zlib
from hashlib import sha256

import pytest

from cellweave.llm import merkle_manifest as op

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1:run + 3]))
        at //= 3
    return out


def by_definition(rows):
    key = lambda v: (v is not None, v if v is not None else "")
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x for _, x in sorted(((key(r[0]), leaf(*r)) for r in rows if r[1] == s))]) for s in sources]
    top = climb([t[-1][0] for t in trees])
    out = []
    for number, s in enumerate(sources):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (key(r[0]), leaf(*r)))
        for at, r in enumerate(own):
            path = way(trees[number], at) + way(top, number)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(*r[:4], r[4].replace("\n", "")) if tampered else leaf(*r)
            for before, after in path:
                folded = h(*before, folded, *after)
            out.append((r[0], s, leaf(*r), trees[number][-1][0], top[-1][0], [d for b, a in path for d in b + a], folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def agree(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = op.manifest(docs)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == by_definition(rows)
    return got


@pytest.mark.parametrize("leaves", [1, 4, 50, 8192])
def test_against_definition(spark, monkeypatch, leaves):
    """Parts of any size give the same proofs; sources of one to hundreds of leaves, one of them holding most."""
    monkeypatch.setattr(op, "LEAVES", leaves)
    rng = random.Random(leaves)
    rows = [(3 * i, rng.choice(["hot"] * 9 + [None, "é", "z", "a", "ab", f"s{i % 40}"]), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", "a\nb", f"text {i}\n", "x"])) for i in range(400 if leaves > 1 else 60)]
    got = agree(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, count):
    agree(spark.createDataFrame([(i, "s", None, None, "t") for i in range(count)], SCHEMA))


def test_levels_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(op, "LEVELS", 2)
    agree(spark.createDataFrame([(i, "s" if i else "t", None, None, f"\n{i}") for i in range(300)], SCHEMA))


def test_awkward_rows(awkward, nothing):
    assert len(agree(awkward)) == awkward.count()
    assert op.manifest(nothing).collect() == []


def test_a_part_asks_for_no_more_than_it_lacks(spark):
    """Leaves 10 to 19 of 30 lack 9 and 20; of their parents 3 to 6 the runs lack 7 and 8; then 0 beside 1 and 2 of four; then 1 of two."""
    known = spark.createDataFrame([(0, 0, 30, 10, 19), (1, 0, 30, 0, 29), (2, 1, 1, 0, 0)], "part long, tree long, n long, lo long, hi long")
    want = {}
    for r in op.missing(known).collect():
        want.setdefault(r.part, set()).add((r.level, r.at))
    assert want == {0: {(0, 9), (0, 20), (1, 7), (1, 8), (2, 0), (3, 1)}}
