"""Least-cost repair of conversations: interval parsing with a weighted repair grammar in Chomsky normal form."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

_BLANKS = " \t\n\x0b\x0c\r"
#: Nonterminals: nothing left (E), a leading system turn (S), turns that alternate from the first letter to the last one,
#: and the same behind a system turn. Every part of a right conversation is one of them, so a span has one cell
#: for each, and a span's cells follow from those of its two parts wherever it is cut.
NAMES = ("E", "S", "uu", "ua", "au", "aa", "su", "sa")
#: Whole conversations.
GOALS = ("E", "ua", "sa")


def _rules() -> list[tuple[int, int, int]]:
    """X -> Y Z as (Y, Z, X): what two neighbouring parts make together."""
    found = [("E", "E", "E")] + [r for x in NAMES[1:] for r in (("E", x, x), (x, "E", x))]
    turns = NAMES[2:]
    found += [(y, z, y[0] + z[1]) for y in turns for z in turns[:4] if y[1] != z[0]]
    found += [("S", z, "s" + z[1]) for z in turns[:4] if z[0] == "u"]
    return [tuple(NAMES.index(n) for n in rule) for rule in found]


RULES = _rules()
#: Cells: for each nonterminal the least (cost, audit), or None. Least audits of equal cost never are a beginning of one
#: another (they would differ in inserted turns alone, and so in cost), so the least of a span is made of the least of its parts.
Cells = tuple


def join(left: Cells, right: Cells) -> Cells:
    out: list = [None] * len(NAMES)
    for y, z, x in RULES:
        a, b = left[y], right[z]
        if a is not None and b is not None:
            cost, now = a[0] + b[0], out[x]
            if now is None or cost < now[0]:
                out[x] = (cost, a[1] + b[1])
            elif cost == now[0]:
                out[x] = min(now, (cost, a[1] + b[1]))
    return tuple(out)


def _cells(**found) -> Cells:
    return tuple(found.get(n) for n in NAMES)


#: The empty span: turns that are only inserted.
NOTHING = _cells(E=(0, ""), uu=(2, "I"), aa=(2, "I"), ua=(4, "II"), au=(4, "II"))


@lru_cache(maxsize=64)
def row_cells(initial: str, truncated: int) -> Cells:
    """A turn that may stay: kept, with another role or deleted; insertions before and after it are closed in."""
    found = {"E": (3, "D"), "uu": (2 + truncated, "R"), "aa": (2 + truncated, "R")}
    name = {"s": "S", "u": "uu", "a": "aa"}.get(initial)
    if name:
        found[name] = (truncated, "K")
    return join(join(NOTHING, _cells(**found)), NOTHING)


def gone_cells(n: int) -> Cells:
    """``n`` turns in a row that must go; of equal cost, insertions behind them have the least audit."""
    return join(join(NOTHING, _cells(E=(3 * n, "D" * n))), NOTHING)


class Spans:
    """Cells of a growing span, combined bottom-up: two neighbouring spans of one length become one of twice that length."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Cells]] = []

    def add(self, cells: Cells, length: int = 1) -> None:
        while self.parts and self.parts[-1][0] <= length:
            n, before = self.parts.pop()
            length, cells = length + n, join(before, cells)
        self.parts.append((length, cells))

    def whole(self) -> Cells:
        cells = self.parts[-1][1] if self.parts else NOTHING
        for _, before in reversed(self.parts[:-1]):
            cells = join(before, cells)
        return cells


def legal(x: str, y: str) -> bool:
    return x + y in ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text,
    2 removes its marks, 3 repeats it and 4 makes its role user. Null ids, turns, roles and texts count as one space there."""
    rows = turns_of(conversations)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.withColumn("fault", fault).where("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
            .drop("copy"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """Only the four columns, whatever others there are."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def _order(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", *more, "turn", "role", "d")]


def marked(rows: DataFrame) -> DataFrame:
    """One row for equal (conv_id, turn, role, text), without the text: its copies, and whether it is blank, said earlier or cut off."""
    end = F.rtrim("text", F.lit(_BLANKS))
    slim = (rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("d"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*".!?")).alias("cut"))
            .groupBy("conv_id", "turn", "role", "d", "blank", "cut").agg(F.count(F.lit(1)).alias("copies")))
    slim = written(slim)
    said = (slim.groupBy("conv_id", "role", "d").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("null_turn"), F.min("turn").alias("least"))
            .where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("d").alias("e"), "null_turn", "least"))
    later = F.when(F.col("null_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    joined = slim.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("d") == F.col("e")), "left")
    return joined.select(*slim.columns, F.coalesce(later, F.lit(False)).alias("later"))


_SEGMENT = "conv_id long, part int, costs array<long>, audits array<string>, first string, last string, illegal long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each conversation's rows in this partition, which come in order."""
    part = TaskContext.get().partitionId()
    now, out, spans, first, last, illegal = None, [], Spans(), "", "", 0

    def close() -> None:
        if now is not None:
            cells = spans.whole()
            out.append((now[0], part, [c and c[0] for c in cells], [c and c[1] for c in cells], first, last, illegal))

    for batch in batches:
        for conv, role, blank, cut, copies, later in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "blank", "cut", "copies", "later")), strict=True):
            x = role[:1]
            if now != (conv,):
                close()
                now, spans, first, illegal = (conv,), Spans(), x, 0
            else:
                illegal += not legal(last, x)
            forced = copies if blank or later else copies - 1
            if forced < copies:
                spans.add(row_cells(x, int(cut)))
            if forced:
                spans.add(gone_cells(forced), forced)
            last, illegal = x, illegal + copies - 1
        if len(out) > 4096:
            yield _table(out, _SEGMENT)
            out.clear()
    close()
    if out:
        yield _table(out, _SEGMENT)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cost, audit and illegal of each conversation from its segments, which come in order."""
    now, out, cells, last, illegal = None, [], NOTHING, "", 0

    def close() -> None:
        if now is not None:
            cost, audit = min(cells[NAMES.index(n)] for n in GOALS if cells[NAMES.index(n)] is not None)
            out.append((now[0], cost, audit, illegal))

    for batch in batches:
        for conv, costs, audits, first, end, more in zip(*(batch[c].to_pylist() for c in ("conv_id", "costs", "audits", "first", "last", "illegal")), strict=True):
            own = tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))
            if now != (conv,):
                close()
                now, cells, illegal = (conv,), own, more
            else:
                cells, illegal = join(cells, own), illegal + more + (not legal(last, first))
            last = end
        if len(out) > 4096:
            yield _table(out, _PARSE)
            out.clear()
    close()
    if out:
        yield _table(out, _PARSE)


_PARSE = "conv_id long, cost long, audit string, illegal long"
_REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def parse(rows: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """conv_id, cost, audit, illegal of every conversation of ``rows``.

    Rows are dealt by ranges of (conv_id, turn), so that a conversation of any size is parsed by several tasks; what
    leaves a task are the cells of its part, eight costs and audits, and these are joined in order.
    """
    marks = marked(rows) if marks is None else marks
    parts = map_batches(marks.repartitionByRange(*_order()).sortWithinPartitions(*_order()), _segments, _SEGMENT)
    return map_batches(parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part"), _combined, _PARSE)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns: a conversation's audit comes first, then its rows in order, one letter each."""
    audit, at, place, system = "", 0, 0, False
    out: list[tuple] = []
    for batch in batches:
        size = 0
        for conv, kind, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "turn", "role", "text")), strict=True):
            if kind == 0:
                audit, at, place, system = text, 0, 0, False
            turns = lambda: ("user", "assistant")[(place - system) % 2]
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", None, turns(), ""))
                at, place = at + 1, place + 1
            if kind == 0:
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                system = system or place == 0 and role[:1] == "s"
                out.append((conv, place, "K", turn, role, text))
            elif edit == "R":
                out.append((conv, place, "R", turn, turns(), text))
            if edit != "D":
                place, size = place + 1, size + len(text)
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", None, turns(), ""))
                at, place = at + 1, place + 1
            if size > 1 << 22:
                yield _table(out, _REPAIRED)
                size, out = 0, []
    if out:
        yield _table(out, _REPAIRED)


def repaired(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K, R or I), turn, role, text; in order within a partition."""
    heads = parsed.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("binary").alias("d"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("d"), "text")
    dealt = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*_order("kind"))
    return map_batches(dealt.select("conv_id", "kind", "turn", "role", "text"), _follow, _REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, out = None, None, []
    for batch in batches:
        for conv, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if now is not None:
                    out.append((now[0], digest.hexdigest()))
                now, digest = (conv,), hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if now is not None:
        out.append((now[0], digest.hexdigest()))
    if out:
        yield _table(out, "conv_id long, repaired_sha256 string")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the sha256 of the ``role:text`` of its turns, joined by newlines; the turns are taken as a stream where they are."""
    return map_batches(turns, _digests, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of ``conversations``.

    ``rows`` are the turns to be repaired, by default those of ``conversations``; see ``damaged``. Turns stand in the order of turn
    (nulls first), then role and the digest of the text. A turn's first fault counts: blank, duplicate (role and text stand
    earlier in the conversation), truncated (the last character that is no blank is none of ``.!?``). Kept turns cost 0, with another
    role 2, deleted ones 3 (blank and duplicate ones must go), inserted ones 2, and each truncated one that is not deleted 1 more.
    What is left is an optional system turn followed by one or more pairs of user and assistant, or nothing; of the cheapest
    edits those with the least audit. Null roles and texts are one space (so such a text is blank); rows without conv_id are one
    conversation; conversations without rows have zeros, an empty audit and the hash of an empty text. Repeated
    rows are duplicates. Other columns are ignored; an empty table gives no rows.

    A conversation's digest is taken in one stream, as sha256 must; what a task holds of it are its audit and one batch of turns.
    """
    every = turns_of(conversations).select("conv_id").distinct()
    rows = turns_of(conversations if rows is None else rows).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marks = written(marked(rows))
    parsed = written(parse(rows, marks))
    one = lambda c: F.when(c, F.col("copies")).otherwise(0)
    live = ~F.col("blank") & ~F.col("later")
    faults = marks.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(one(F.col("blank"))).alias("blank"),
        F.sum(one(~F.col("blank")) - live.cast("long")).alias("duplicate"), F.sum((live & F.col("cut")).cast("long")).alias("truncated"))
    out = every
    for part in (faults, parsed, digests(repaired(rows, parsed))):
        out = out.join(part.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
