"""Index selection and translation of a query into a DataFrame. All general optimisation is Catalyst's.

A query has a scan and, for each index that answers a part of it, another plan: a filter conjunct by a sorted or text
index, the fulltext score by postings, the nearest rows by codes of their vectors.  An index of vectors knows the whole table
only, so it answers a query without filters.  Plans are ranked by their cost: bytes read, operations, memory and the
share of answers that may be missing, each as a share of the dearest plan's, weighted.
"""

from __future__ import annotations

import contextlib
import io
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vecloom.functions import fulltext
from vecloom.operators import predicates as P
from vecloom.plans.query import Query, _frame, ordered, project, with_functions

#: Weights of io, cpu, memory and accuracy, and the share of rows that a condition keeps (fixed values).
WEIGHTS = (0.6, 0.3, 0.1, 0.0)
SELECTIVITY = {"between": 1 / 6, "<": 1 / 3, "<=": 1 / 3, ">": 1 / 3, ">=": 1 / 3}
OTHERWISE = 0.33


@dataclass(frozen=True)
class Step:
    name: str
    rows: float
    io: float = 0.0
    cpu: float = 0.0
    memory: float = 0.0
    accuracy: float = 0.0


@dataclass(frozen=True)
class Plan:
    name: str
    steps: tuple[Step, ...]
    index: Any = None
    part: Any = None  # what the index answers: a predicate, a function or None for the neighbours

    def cost(self) -> tuple[float, ...]:
        return tuple(sum(getattr(s, k) for s in self.steps) for k in ("io", "cpu", "memory", "accuracy"))


def width(field: T.StructField) -> float:
    """Bytes of a value, roughly."""
    kind = field.dataType
    if isinstance(kind, T.ArrayType):
        return field.metadata.get("dim", 64) * width(T.StructField("", kind.elementType))
    if isinstance(kind, T.StructType):
        return sum(map(width, kind))
    return {"boolean": 1, "byte": 1, "tinyint": 1, "short": 2, "smallint": 2, "integer": 4, "float": 4, "string": 32, "binary": 256}.get(kind.typeName(), 8)


def selectivity(p: P.Predicate, distinct: dict[str, float]) -> float:
    """The share of rows that a predicate keeps, from the stored statistics where there are any."""
    many = distinct.get(p.name or "")
    if p.op in ("=", "in"):
        return min(1.0, len(p.values) / many) if many else OTHERWISE
    if p.op == "not":
        return 1 - selectivity(p.parts[0], distinct)
    if p.op in ("and", "or"):
        out = 1.0
        for part in p.parts:
            out *= selectivity(part, distinct) if p.op == "and" else 1 - selectivity(part, distinct)
        return out if p.op == "and" else 1 - out
    return SELECTIVITY.get(p.op, OTHERWISE)


def _usable(q: Query) -> list:
    use = q.hints.get("use_index", True)
    indexes = None if isinstance(q.source, DataFrame) else getattr(q.source, "indexes", None)
    if not indexes or use is False:
        return []
    return [i for i in indexes() if i.clean() and (use is True or use in (i.name, i.kind)) and (i.exact or q.hints.get("approx", False))]


def _counted(source: Any) -> bool:
    """A table of the catalogue, which knows its size and statistics."""
    return not isinstance(source, DataFrame | Query) and hasattr(source, "meta")


def plans(q: Query) -> list[Plan]:
    """All plans, the best first."""
    counted = _counted(q.source)  # of any other source the size is not known
    schema, rows = _frame(q.source).schema, float(q.source.count() if counted else 1e6)
    distinct = q.source.distinct() if counted else {}
    wide = {f.name: width(f) for f in schema}
    whole = sum(wide.values())
    kept = 1.0
    for f in q.filters:
        kept *= selectivity(f, distinct)
    text = [f for f in q.functions if f[0] == "fulltext"]
    work = sum(wide.get(a, 8) / 2 for f in q.functions for a in f[1] if isinstance(a, str))
    out = rows * kept
    after = [Step("filter", out, cpu=rows * len(q.filters))] if q.filters else []
    after += [Step("function", out, cpu=out * work)] if q.functions else []
    after += [Step("top-k" if q.limit_rows else "sort", min(out, q.limit_rows or out), cpu=out, memory=(q.limit_rows or out) * whole)] if q.order else []
    found = [Plan("scan", (Step("scan", rows, io=rows * whole), *after))]
    for index in _usable(q):
        label = f"{index.kind}:{index.name}"
        for f in q.filters if not text else ():  # the score's counts cover the whole table
            for p in f.conjuncts():
                if index.answers(p):
                    hit = rows * selectivity(p, distinct)
                    read = hit * whole if index.kind != "lucene" else hit * (32 + whole)
                    found.append(Plan(label, (Step("index scan", hit, io=read, cpu=hit), *after), index, p))
        for f in text:
            if index.kind == "lucene" and index.column == f[1][0]:
                hit = rows * OTHERWISE
                found.append(Plan(label, (Step("index scan", hit, io=hit * 32, cpu=hit), Step("fetch", hit, io=hit * whole), *after), index, f))
        if q.functions and not (q.filters or q.semi or text) and q.order and q.limit_rows:
            name, args, alias = q.functions[0]
            if len(args) == 2 and args[0] == index.column and isinstance(args[1], list | tuple) and index.supports(name) and q.order[0][0] == alias:
                code, hit = len(args[1]) / (1 if index.kind == "vaf" else 4), rows * index.reads
                missing = 0.0 if index.exact else 0.1
                steps = (Step("index scan", rows, io=rows * code, cpu=rows * code, accuracy=missing), Step("fetch", hit, io=hit * wide[index.column]), Step("function", hit, cpu=hit * work), Step("top-k", q.limit_rows, cpu=hit))
                found.append(Plan(label, steps, index))
    costs = [p.cost() for p in found]
    most = [max(c) or 1.0 for c in zip(*costs, strict=True)]
    weights = q.hints.get("policy", WEIGHTS)
    ranked = sorted(range(len(found)), key=lambda k: (score(costs[k], most, weights), k))
    return [found[k] for k in ranked]


def score(cost: tuple, most: list[float], weights: tuple) -> float:
    return sum(w * c / m for w, c, m in zip(weights, cost, most, strict=True))


def plan(q: Query) -> DataFrame:
    bare = not (q.filters or q.semi or q.functions or q.limit_rows or q.skip_rows)
    if q.mode == "count" and bare and _counted(q.source):  # the table's own count
        return SparkSession.active().createDataFrame([(q.source.count(),)], f"`{q.columns[0]}` long")
    best = plans(q)[0] if _usable(q) else Plan("scan", ())
    index, part, df = best.index, best.part, _frame(q.source)
    filters = q.filters
    if isinstance(part, P.Predicate):
        df = index.rows(part, df)
        if index.decides(part):  # else the texts would be tokenised again, and before the join
            filters = [p for f in q.filters for p in f.conjuncts() if p is not part]
    if q.hints.get("parallelism"):
        df = df.coalesce(int(q.hints["parallelism"]))
    rest = tuple(f for f in q.functions if f[0] != "fulltext")
    for f in q.functions:
        if f[0] == "fulltext":
            if index is not None and f is part:
                df = df.join(index.scores(f[1][1], f[2]), index.key)
            else:
                df = fulltext.scored(df, *f[1], f[2])
    for column, sub in q.semi:
        df = P.in_query(df, column, _frame(sub))
    if index is not None and part is None:
        name, args, _ = rest[0]
        df = index.candidates(df, args[1], name, q.limit_rows + q.skip_rows, q.order[0][1].lower().startswith("desc"))
    df = with_functions(df, rest)
    for f in filters:
        df = df.where(f.column())
    if q.order:
        df = ordered(df, q.order)
    if q.skip_rows:
        df = df.offset(q.skip_rows)
    if q.limit_rows:
        df = df.limit(q.limit_rows)
    return project(df, q)


def explained(q: Query) -> DataFrame:
    """rank, score, position, name, output_size, the four costs and the plan, one row per step of each plan."""
    found = plans(q)
    most = [max(c) or 1.0 for c in zip(*(p.cost() for p in found), strict=True)]
    weights = q.hints.get("policy", WEIGHTS)
    rows = [
        (r + 1, float(score(p.cost(), most, weights)), k + 1, s.name, int(s.rows), float(s.io), float(s.cpu), float(s.memory), float(s.accuracy), p.name)
        for r, p in enumerate(found)
        for k, s in enumerate(p.steps)
    ]
    return SparkSession.active().createDataFrame(rows, "rank int, score double, position int, name string, output_size long, cost_io double, cost_cpu double, cost_memory double, cost_accuracy double, plan string")


def explain(q: Query, mode: str = "formatted") -> str:
    """The ranked plans and Spark's plan of the first. No job runs."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        plan(q).explain(mode)
    ranked = "\n".join(f"{k + 1}. {p.name} (io {p.cost()[0]:.3g} bytes, cpu {p.cost()[1]:.3g})" for k, p in enumerate(plans(q)))
    return ranked + "\n" + out.getvalue()
