import hashlib
import itertools
import random
import re

import pytest

from cellweave.llm import conversation_repair as op

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        trimmed = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows):
    """Every audit of a few rows with up to two insertions in a gap: its cost and what it leaves."""
    marks = faults(rows)
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and x != "D" for x, f in zip(letters, marks)):
            continue
        cost = sum({"K": 0, "R": 2, "D": 3}[x] + (x != "D" and f == "truncated") for x, f in zip(letters, marks))
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, [*letters, ""]))
            left, at, good = [], 0, True
            for x in audit:
                row = rows[at] if x != "I" else None
                at += x != "I"
                if x == "D":
                    continue
                if x == "K" and not left and row[0][:1] == "s":
                    left.append(row)
                    continue
                want = ("user", "assistant")[(len(left) - bool(left and left[0][0][:1] == "s")) % 2]
                good &= x != "K" or row[0][:1] == want[:1]
                left.append(row if x == "K" else (want, row[1] if row else ""))
            if good and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in left)):
                yield cost + 2 * sum(gaps), audit, left


def forward(rows):
    """Least (cost, audit) of long conversations, row by row over what may come next."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(states):
        for _ in range(2):
            for p, (c, a) in list(states.items()):
                q = step.get((p, "u")) or step[p, "a"]
                states[q] = min(states.get(q, (9e9, "")), (c + 2, a + "I"))
        return states

    states = {0: (0, "")}
    for (role, _), fault in zip(rows, faults(rows)):
        new = {}
        for p, (c, a) in inserted(states).items():
            ways = [(p, 3, "D")]
            if fault in ("", "truncated"):
                t = fault == "truncated"
                ways.append((step.get((p, "u")) or step[p, "a"], 2 + t, "R"))
                if (p, role[:1]) in step:
                    ways.append((step[p, role[:1]], t, "K"))
            for q, more, x in ways:
                new[q] = min(new.get(q, (9e9, "")), (c + more, a + x))
        states = new
    return min(v for p, v in inserted(states).items() if p in (0, 3))


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " "]), rng.choice(["a.", "b!", "c", "", " \n", "d?", f"{rng.random()}.", f"{rng.random()}"])) for _ in range(n)]


def got(spark, conversations, **how):
    rows = [(c, t, r, x) for c, turns in conversations.items() for t, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return {r.conv_id: r for r in op.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}


def test_against_all_repairs(spark):
    rng = random.Random(8)
    conversations = {i: random_rows(rng, 1 + i % 4) for i in range(60)}
    found = got(spark, conversations)
    for i, rows in conversations.items():
        cost, audit, left = min(all_repairs(rows))
        want = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        marks, r = faults(rows), found[i]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, want), rows
        assert (r.blank, r.duplicate, r.truncated, r.gaps) == (marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), 0)
        assert r.illegal == sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))


def test_long_conversations_are_parsed_in_parts(spark):
    """Thousands of turns, dealt to several tasks, beside short ones."""
    rng = random.Random(9)
    conversations = {1: random_rows(rng, 1), 2: random_rows(rng, 3000), 3: [("user", "same.")] * 500, 4: [("user", "")] * 40, 5: random_rows(rng, 700)}
    found = got(spark, conversations)
    for i, rows in conversations.items():
        assert (found[i].cost, found[i].audit) == forward(rows)
    assert op.map_batches(op.marked(spark.createDataFrame([(2, t, r, x) for t, (r, x) in enumerate(conversations[2])], SCHEMA))
                          .repartitionByRange(4, *op._order()).sortWithinPartitions(*op._order()), op._segments, op._SEGMENT).count() == 4


def test_wherever_a_span_is_cut_its_cells_are_the_same():
    rng = random.Random(10)
    for _ in range(30):
        cells = [op.row_cells(rng.choice("uasx"), rng.randint(0, 1)) if rng.random() < 0.8 else op.gone_cells(rng.randint(1, 3)) for _ in range(9)]

        def span(lo, hi, cut):
            if hi - lo == 1:
                return cells[lo]
            at = cut(lo + 1, hi - 1)
            return op.join(span(lo, at, cut), span(at, hi, cut))

        assert len({span(0, 9, rng.randint) for _ in range(6)} | {span(0, 9, min), span(0, 9, max)}) == 1


def test_nulls_repeats_ties_and_extra_columns(spark):
    rows = [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (7, None, "system", "s."), (7, 3, None, "x."), (7, 3, "user", None), (7, 9, "user", "u."), (7, 9, "user", "u."), (8, 1, "user", None)]
    docs = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], SCHEMA + ", copies long, later string, d int")
    found = {r.conv_id: r for r in op.repair(docs).collect()}
    assert (found[None].cost, found[None].audit) == (0, "KK")
    want = [("system", "s."), (" ", "x."), ("user", " "), ("user", "u."), ("user", "u.")]
    assert (found[7].cost, found[7].audit) == min((c, a) for c, a, _ in all_repairs(want)) and found[7].gaps == 5 and found[7].duplicate == 1 and found[7].blank == 1
    assert (found[8].cost, found[8].audit, found[8].repaired_sha256) == (3, "D", hashlib.sha256(b"").hexdigest())
    assert op.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_conversations_without_rows_and_damage(spark):
    import zlib
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}!") for c in range(80) for t in range(4)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text or " ") if f == 2 else text or " "
        want += [(c, t, "user" if f == 4 else role or " ", text)] * (0 if f == 0 else 2 if f == 3 else 1)
    made = op.damaged(table)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    found = {r.conv_id: r for r in op.repair(table, made.where("conv_id is null or conv_id > 2")).collect()}
    assert len(found) == 81 and tuple(found[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("text", ["x" * 3_000_000 + ".", "é" * 500_000])
def test_very_long_texts(spark, text):
    found = op.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "b.")], SCHEMA)).first()
    cut = text[-1] != "."
    assert (found.cost, found.audit, found.truncated) == (int(cut), "KK", int(cut))
    assert found.repaired_sha256 == hashlib.sha256(f"user:{text}\nassistant:b.".encode()).hexdigest()
