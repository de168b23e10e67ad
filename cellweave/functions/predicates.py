"""Predicates as data: typed comparisons and three-valued clauses compiled to Columns."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

OPS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}
ATTRIBUTE_TYPE = "map<string,struct<kind:string,num:double,str:string,bool:boolean>>"


def attribute(value: Column | None, kind: str) -> Column:
    """One typed attribute scalar; kind is num, str, bool or null."""
    def put(name: str, type_: str) -> Column:
        return (value.cast(type_) if kind == name else F.lit(None).cast(type_)).alias(name)
    return F.struct(F.lit(kind).alias("kind"), put("num", "double"), put("str", "string"), put("bool", "boolean"))


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num"
    if isinstance(value, str):
        return "str"
    return "null"


def typed_compare(actual: Column, op: str, value: object) -> Column:
    """Compare a typed attribute; absent, null or incompatible gives NULL, also for ``ne``."""
    kind = _kind(value)
    if kind == "null" or op not in OPS or (op not in ("eq", "ne") and kind != "num"):
        raise ValueError("attribute comparisons need a finite number, text or boolean and a matching operator")
    return F.when(actual["kind"] == kind, OPS[op](actual[kind], F.lit(value)))


def clause(field: str, op: str, value: object, count_columns: Mapping[str, Column | None] | None = None) -> Column:
    """One clause as a nullable boolean. ``count_columns`` maps feature ids to columns, None if off-panel."""
    if op not in (*OPS, "in"):
        raise ValueError("unsupported operator")
    if op in ("lt", "le", "gt", "ge") and _kind(value) != "num":
        raise ValueError("ordered comparisons need a number")
    null = F.lit(None).cast("boolean")
    if field.startswith("attributes."):
        actual = F.col("attributes")[field[len("attributes."):]]
        typed = lambda v: (F.when(actual["kind"] == _kind(v), actual[_kind(v)] == F.lit(v)) if _kind(v) != "null" else null)
        ordered = lambda: F.when(actual["kind"] == "num", OPS[op](actual["num"], F.lit(value)))
    else:
        if field.startswith("counts."):
            column, own = (count_columns or {}).get(field[len("counts."):]), "num"
            if column is None:
                return null
        elif field in ("label", "region", "included"):
            column, own = F.col(field), "bool" if field == "included" else "str"
        else:
            raise ValueError("unknown predicate field")
        typed = lambda v: (column == F.lit(v)) if _kind(v) == own else null
        ordered = lambda: OPS[op](column, F.lit(value)) if own == "num" else null
    if op == "in":
        hits = [typed(v) for v in value]  # SQL OR already gives: true if any true, else NULL if any NULL, else false
        return reduce(lambda a, b: a | b, hits)
    if op == "eq":
        return typed(value)
    if op == "ne":
        return ~typed(value)
    return ordered()


def all_of(clauses: Sequence[Mapping[str, object]], count_columns: Mapping[str, Column | None] | None = None) -> Column:
    """Kleene conjunction: false dominates, NULL marks observations that cannot be decided."""
    return reduce(lambda a, b: a & b, [clause(c["field"], c["op"], c["value"], count_columns) for c in clauses])
