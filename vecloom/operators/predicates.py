"""Two-valued predicates: a comparison with NULL is false, so its negation is true.

A predicate is a small tree that gives a Column (``column``), a match score (``score``) and its conjuncts, from which
the planner takes those that an index answers.  ``&``, ``|`` and ``~`` combine predicates with each other and with Columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.col(x)


@dataclass(frozen=True)
class Predicate:
    """``op``: and, or, not, or that of a leaf; a leaf on a plain column has its name and literal values."""

    op: str
    made: Column
    parts: tuple[Predicate, ...] = ()
    name: str | None = None
    values: tuple = ()

    def column(self) -> Column:
        return self.made

    def score(self) -> Column:
        """1 where it holds, else 0; OR is the mean of its sides, AND the smaller."""
        if self.op == "or" and self.parts:
            return sum((p.score() for p in self.parts[1:]), self.parts[0].score()) / F.lit(float(len(self.parts)))
        if self.op == "and" and self.parts:
            return F.least(*(p.score() for p in self.parts)) if len(self.parts) > 1 else self.parts[0].score()
        return F.when(self.made, 1.0).otherwise(0.0)

    def conjuncts(self) -> list[Predicate]:
        return [x for p in self.parts for x in p.conjuncts()] if self.op == "and" else [self]

    def __and__(self, other: Any) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Any) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return negate(self)


def of(x: Any) -> Predicate:
    """A predicate from a predicate, a Column or a (left, op, right) triple."""
    if isinstance(x, Predicate):
        return x
    return Predicate("column", _sure(x)) if isinstance(x, Column) else compare(*x)


def column(x: Any) -> Column:
    return of(x).column()


def _leaf(op: str, made: Column, left: Any, *values: Any) -> Predicate:
    plain = isinstance(left, str) and not any(isinstance(v, Column) for v in values)
    return Predicate(op, _sure(made), name=left if plain else None, values=values if plain else ())


def compare(left: Any, op: str, right: Any) -> Predicate:
    """``left`` is a column or its name, ``right`` a column or a literal."""
    a, b = _col(left), right if isinstance(right, Column) else F.lit(right)
    made = {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}
    if op not in made:
        raise ValueError(f"no comparison {op}")
    return _leaf(op, made[op], left, right)


def like(left: Any, pattern: str, compat: bool = False) -> Predicate:
    """SQL LIKE; plain prefixes and suffixes reach the scan. ``compat``: ``_`` is zero or one character."""
    if compat:
        return _leaf("rlike", _col(left).rlike("(?s)^" + re.sub("_", ".?", re.sub("%", ".*", re.escape(pattern).replace("\\%", "%").replace("\\_", "_"))) + "$"), left, pattern)
    body = pattern.strip("%")
    if not set(body) & set("%_\\"):
        if pattern == body + "%":
            return _leaf("prefix", _col(left).startswith(body), left, body)
        if pattern == "%" + body:
            return _leaf("suffix", _col(left).endswith(body), left, body)
    return _leaf("like", _col(left).like(pattern), left, pattern)


def match(left: Any, query: str) -> Predicate:
    """The text in ``left`` matches a fulltext query (``functions.fulltext``)."""
    from vecloom.functions import fulltext

    return _leaf("match", fulltext.matches(_col(left), query), left, query)


def between(left: Any, a: Any, b: Any) -> Predicate:
    """Bounds in either order."""
    low, high = sorted((a, b))
    return _leaf("between", _col(left).between(low, high), left, low, high)


def isin(left: Any, values: list) -> Predicate:
    return _leaf("in", _col(left).isin(*values) if values else F.lit(False), left, *values)


def isnull(left: Any) -> Predicate:
    return _leaf("null", _col(left).isNull(), left)


def all_of(*parts: Any) -> Predicate:
    parts = tuple(map(of, parts))
    return Predicate("and", reduce(lambda a, b: a & b, (p.made for p in parts), F.lit(True)), parts)


def any_of(*parts: Any) -> Predicate:
    parts = tuple(map(of, parts))
    return Predicate("or", reduce(lambda a, b: a | b, (p.made for p in parts), F.lit(False)), parts)


def negate(part: Any) -> Predicate:
    part = of(part)
    return Predicate("not", ~part.made, (part,))


def in_query(table: DataFrame, column: str, sub: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in the first column of ``sub``."""
    return table.join(sub.select(F.col(sub.columns[0]).alias(column)), column, "left_semi").select(*table.columns)
