"""The query builder.

Clauses apply in a fixed order whatever order they are called in: FROM, functions, WHERE, ORDER, SKIP, LIMIT,
projection.  So WHERE and ORDER may use function aliases and columns that are not projected, and aggregates and
DISTINCT see what LIMIT has left.  A limit of 0 is none.  The builder is a small plan; ``frame`` turns it into one
DataFrame, after the planner has put an index under it where one answers the query.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import predicates as P


@dataclass(frozen=True)
class Query:
    source: Any
    functions: tuple = ()
    filters: tuple = ()
    semi: tuple = ()
    order: tuple = ()
    skip_rows: int = 0
    limit_rows: int = 0
    columns: tuple = ()
    mode: str = "select"
    hints: dict = field(default_factory=dict)

    # FROM
    def sample(self, p: float, seed: int = 0) -> Query:
        return replace(self, source=_frame(self.source).sample(False, p, seed))

    # functions
    def function(self, name: str, *args: Any, alias: str | None = None) -> Query:
        """Append a computed column; un-aliased ones take the function's name."""
        return replace(self, functions=(*self.functions, (name, args, alias or name)))

    def distance(self, column: str, query: list[float], kind: str, alias: str = "distance", *more: Any) -> Query:
        return self.function(kind, column, query, *more, alias=alias)

    def fulltext(self, column: str, text: str, alias: str = "score") -> Query:
        return self.function("fulltext", column, text, alias=alias)

    # WHERE
    def where(self, predicate: P.Predicate | Column | tuple) -> Query:
        return replace(self, filters=(*self.filters, P.of(predicate)))

    def match(self, column: str, query: str) -> Query:
        """Rows whose text matches a fulltext query."""
        return self.where(P.match(column, query))

    def where_in_query(self, column: str, sub: Query | DataFrame) -> Query:
        return replace(self, semi=(*self.semi, (column, sub)))

    def range(self, alias: str, radius: float) -> Query:
        """All rows within a distance."""
        return self.where(P.compare(alias, "<=", radius))

    # ORDER, SKIP, LIMIT
    def order_by(self, *keys: str | tuple[str, str]) -> Query:
        return replace(self, order=(*self.order, *((k, "asc") if isinstance(k, str) else k for k in keys)))

    def limit(self, n: int) -> Query:
        return replace(self, limit_rows=n)

    def skip(self, n: int) -> Query:
        return replace(self, skip_rows=n)

    def nearest(self, column: str, query: list[float], kind: str, k: int, key: str, alias: str = "distance") -> Query:
        return self.distance(column, query, kind, alias).order_by(alias, key).limit(k)

    def farthest(self, column: str, query: list[float], kind: str, k: int, key: str, alias: str = "distance") -> Query:
        return self.distance(column, query, kind, alias).order_by((alias, "desc"), key).limit(k)

    # projection
    def select(self, *columns: Any) -> Query:
        """Names, (name, alias) pairs, ``*`` or columns."""
        return replace(self, columns=columns)

    def distinct(self, *columns: str) -> Query:
        return replace(self, mode="distinct", columns=columns)

    def count(self, alias: str = "count") -> Query:
        return replace(self, mode="count", columns=(alias,))

    def count_distinct(self, *columns: str, alias: str = "count") -> Query:
        return replace(self, mode="count_distinct", columns=(columns, alias))

    def exists(self, alias: str = "exists") -> Query:
        return replace(self, mode="exists", columns=(alias,))

    def aggregate(self, kind: str, *columns: str) -> Query:
        if kind not in ("sum", "min", "max", "mean"):
            raise ValueError(f"no aggregate {kind}")
        return replace(self, mode=kind, columns=columns)

    def hint(self, **hints: Any) -> Query:
        """use_index: False, True, a name or a type; approx: allow approximate indexes; parallelism: most partitions;
        policy: weights of (io, cpu, memory, accuracy) by which plans are ranked."""
        return replace(self, hints=self.hints | hints)

    def frame(self) -> DataFrame:
        from vecloom.plans import planner

        return planner.plan(self)

    def explain(self, mode: str = "formatted") -> str:
        from vecloom.plans import planner

        return planner.explain(self, mode)

    def explain_plans(self) -> DataFrame:
        """The plans that were considered, ranked, with the cost of each of their steps."""
        from vecloom.plans import planner

        return planner.explained(self)


def _frame(source: Any) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    return source.frame()


def with_functions(df: DataFrame, functions: tuple) -> DataFrame:
    for name, args, alias in functions:
        types = {f.name: V.kind_of(f.dataType) for f in df.schema}
        known = [types.get(a) if isinstance(a, str) else V.kind_of(df.select(a).schema[0].dataType) if isinstance(a, Column) else None for a in args]
        for a, kind in zip(args, known, strict=True):
            if isinstance(a, str) and kind is None:
                raise ValueError(f"no column {a}")
        other = next((k for k in known if k), "")
        kinds = [k or V.literal_kind(a, other) for k, a in zip(known, args, strict=True)]
        # the builders take vectors by name and as lists
        columns = [a if isinstance(a, Column | list | tuple) or k.endswith("[]") else F.col(a) if isinstance(a, str) else V.number(a) for a, k in zip(args, kinds, strict=True)]
        df = df.withColumn(alias, V.resolve(name, kinds)(*columns))
    return df


def ordered(df: DataFrame, order: tuple) -> DataFrame:
    """NULL first ascending and last descending, as Spark does by default; ties by the hidden row id if there is one."""
    keys = [F.col(c).desc() if d.lower().startswith("desc") else F.col(c).asc() for c, d in order]
    if "_tid" in df.columns and all(c != "_tid" for c, _ in order):
        keys.append(F.col("_tid").desc() if len(order) == 1 and order[0][1].lower().startswith("desc") else F.col("_tid").asc())
    return df.orderBy(*keys)


def project(df: DataFrame, q: Query) -> DataFrame:
    shown = [c for c in df.columns if c != "_tid"]
    if q.mode == "count":
        return df.agg(F.count(F.lit(1)).alias(q.columns[0]))
    if q.mode == "count_distinct":  # a NULL is a value
        return df.select(*q.columns[0]).distinct().agg(F.count(F.lit(1)).alias(q.columns[1]))
    if q.mode == "exists":
        return df.limit(1).agg((F.count(F.lit(1)) > 0).alias(q.columns[0]))
    if q.mode in ("sum", "min", "max", "mean"):
        made = {"sum": lambda c: F.sum(F.col(c).cast("double")), "min": F.min, "max": F.max, "mean": F.avg}[q.mode]
        kinds = {f.name: V.kind_of(f.dataType) for f in df.schema}
        out = []
        for c in q.columns:
            if kinds[c].startswith("complex") and not kinds[c].endswith("[]") and q.mode in ("sum", "mean"):
                out.append(F.struct(*((F.sum if q.mode == "sum" else F.avg)(F.col(c)[x].cast("double")).alias(x) for x in ("re", "im"))))
            elif kinds[c] in ("int", "real"):
                out.append(made(c))
            else:
                raise ValueError(f"{c} is not numeric")
        return df.agg(*(x.alias(f"{q.mode}_{c}") for x, c in zip(out, q.columns, strict=True)))
    picked = []
    for c in q.columns or ("*",):
        if c == "*":
            picked += [F.col(x) for x in shown]
        elif isinstance(c, tuple):
            if c[0] == "*":
                raise ValueError("* takes no alias")
            picked.append(F.col(c[0]).alias(c[1]))
        else:
            if isinstance(c, str) and sum(x.lower() == c.lower() for x in df.columns) != 1:
                raise ValueError(f"{c} is {'ambiguous' if c in df.columns else 'no column'}")
            picked.append(c if isinstance(c, Column) else F.col(c))
    out = df.select(*picked)
    if len({x.lower() for x in out.columns}) < len(out.columns):
        raise ValueError("a projection needs distinct names")
    return out.distinct() if q.mode == "distinct" else out
