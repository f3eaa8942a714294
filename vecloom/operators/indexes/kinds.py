"""The seven index kinds.

``build`` makes an index's side table with one Spark job over all rows and, given a path, stores table and model there, from
where ``load`` takes them again.  The side tables of vectors hold a row key and a code; the vectors of the few rows that
the codes leave are fetched by key (late materialisation).  Those of ``btree`` hold the rows in the order of the column, so a
look-up reads the row groups of its range alone; those of ``lucene`` hold postings in segments, each in the order of the term.

Models (marks, code books, hyperplanes) are small driver-side arrays, fitted on a bounded sample where they are learned.
Exact kinds never lose an answer.  ``reads`` is the share of the vectors that a query for ten neighbours has to read,
measured on the sample when the index is built.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import fulltext
from vecloom.functions import vectors as V
from vecloom.operators.predicates import Predicate

#: Least share of the rows that are re-ranked by exact distance after a look-up by codes; with the defaults of LSH and IVFPQ
#: below it is chosen for a recall of 0.9 or more on vectors without clusters (64 dimensions).
RERANK = 0.1

KINDS = ("btree", "btree_uq", "lucene", "vaf", "pq", "ivfpq", "lsh")
#: What each kind of index on a scalar column answers.
ANSWERS = {"btree": ("=", "in", "between", "<", "<=", ">", ">=", "prefix"), "btree_uq": ("=", "in"), "lucene": ("=", "match", "prefix")}


@dataclass
class Index:
    kind: str
    name: str
    column: str
    key: str
    table: DataFrame
    model: dict[str, Any] = field(default_factory=dict)
    exact: bool = True
    reads: float = 1.0
    clean: Any = lambda: True

    def supports(self, function: str) -> bool:
        return function in {"vaf": ("manhattan", "euclidean", "squaredeuclidean"), "pq": (self.model.get("distance"),), "ivfpq": (self.model.get("distance"),), "lsh": ("cosine",)}.get(self.kind, ())

    # Boolean and fulltext look-ups
    def answers(self, p: Predicate) -> bool:
        if self.kind == "lucene" and p.op != "=" and self.model["analyser"] != "standard":
            return False  # MATCH and LIKE mean standard words
        return p.name == self.column and p.op in ANSWERS.get(self.kind, ()) and all(v is not None for v in p.values)

    def decides(self, p: Predicate) -> bool:
        """Does the predicate hold for all of ``rows``? Postings tell it by the key, so not where rows share one."""
        return self.kind == "lucene" and p.op == "match" and bool(self.model.get("unique"))

    def rows(self, p: Predicate, df: DataFrame) -> DataFrame:
        """The rows of ``df`` that the predicate may hold for; the planner applies the predicate to them again, unless it ``decides``."""
        if self.kind != "lucene":
            return self.table.where(p.column())
        if p.op == "match":
            hits = self.scores(p.values[0], "_score").select(self.key)
        else:  # a prefix of the text begins with its first word
            term = F.col("term") == fulltext.verbatim(F.lit(p.values[0])) if p.op == "=" else ~F.col("term").startswith("\x00")
            first = fulltext.parse(p.values[0])[0][:1]
            if p.op == "prefix" and first:
                term = F.col("term").startswith(first[0].rstrip("*"))
            hits = self.table.where(term).select(self.key)
        return df.join(hits, self.key, "left_semi")

    def lookup(self, values: list) -> DataFrame:
        """The side table's rows for the given keys or terms."""
        found = self.table.where(F.col("term" if self.kind == "lucene" else self.column).isin(*values))
        if self.kind == "lucene" and not self.model.get("unique"):  # texts of one key count as one
            found = found.groupBy("term", self.key).agg(F.max("len").alias("len"), F.sum("tf").alias("tf"))
        return found

    def between(self, low: Any, high: Any) -> DataFrame:
        return self.table.where(F.col(self.column).between(*sorted((low, high))))

    def scores(self, query: str, alias: str) -> DataFrame:
        """key and score of all texts that match."""
        return fulltext.search(self.table, self.key, self.model, query, alias, self.model["analyser"])

    # neighbours
    def candidates(self, df: DataFrame, query: list[float], function: str, k: int, farthest: bool = False) -> DataFrame:
        """The rows of ``df`` among which its ``k`` nearest (or farthest) are; for kinds that are not exact, most of them.

        ``df`` must be the indexed table, whole.
        """
        make = {"vaf": self._vaf, "pq": self._codes, "ivfpq": self._codes, "lsh": self._lsh}[self.kind]
        return df.join(make(np.asarray(query, float), function, k, farthest), self.key, "left_semi")

    def distances(self, query: list[float], function: str) -> DataFrame:
        """key and approximate distance of every row, from the codes alone (PQ, IVFPQ: of the probed cells)."""
        q, tables = np.asarray(query, float), self.table
        if self.kind not in ("pq", "ivfpq"):
            raise ValueError(f"{self.kind} does not approximate distances")
        if self.kind == "ivfpq":
            tables = tables.where(F.col("_cell").isin(*self._probed(q, False)))
        return self._approximate(tables, q, function).withColumn("_approx", F.sqrt("_approx") if function == "euclidean" else F.col("_approx"))

    def _vaf(self, query, function, k, farthest):
        """Keys of the rows whose bounds reach the k-th best bound of their task, which the k-th best of all tasks is within."""
        low, step, marks = self.model["low"], self.model["step"], self.model["marks"]
        edge = low + step * np.arange(marks)[:, None]  # marks x dimensions
        below, above = edge[:-1], edge[1:]
        near = np.maximum(np.maximum(below - query, query - above), 0)
        far = np.maximum(np.abs(below - query), np.abs(above - query))
        power = 1 if function == "manhattan" else 2
        near, far = near**power * (1 - 1e-6), far**power * (1 + 1e-6)  # bounds and distances round differently
        if farthest:
            near, far = -far, -near
        dims = np.arange(len(query))

        def run(batches):
            held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            for batch in batches:
                cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                new = (np.asarray(batch.column(0), np.int64), near[cells, dims].sum(axis=1), far[cells, dims].sum(axis=1))
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                if len(held[0]) > k:
                    stay = held[1] <= np.partition(held[2], k - 1)[k - 1]
                    held = tuple(x[stay] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(held[0])], [key])

        key = self.key
        return self.table.select(key, "_cells").mapInArrow(run, f"`{key}` long")

    def _probed(self, q, farthest) -> list[int]:
        order = np.argsort(((self.model["coarse"] - q) ** 2).sum(1))
        return [int(c) for c in (order[::-1] if farthest else order)[: self.model["probes"]]]

    def _approximate(self, table, q, function) -> DataFrame:
        books = self.model["books"]
        parts, cost = np.array_split(np.arange(len(q)), len(books)), []
        for book, dims in zip(books, parts, strict=True):
            x = q[dims]
            cost.append({"manhattan": np.abs(book - x).sum(1), "innerproduct": book @ x}.get(function, ((book - x) ** 2).sum(1)))
        key, at = self.key, np.arange(len(books))
        wide = np.zeros((len(books), max(map(len, cost))))
        for s, c in enumerate(cost):
            wide[s, : len(c)] = c

        def run(batches):
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide[at, codes].sum(axis=1))], [key, "_approx"])

        return table.select(key, "_codes").mapInArrow(run, f"`{key}` long, _approx double")

    def _codes(self, query, function, k, farthest):
        """Keys of the best rows by table-looked-up distance, over-fetched for the exact re-ranking that follows."""
        table, read = self.table, 1.0
        if self.kind == "ivfpq":
            table, read = table.where(F.col("_cell").isin(*self._probed(query, farthest))), self.model["probes"] / len(self.model["coarse"])
        approx = self._approximate(table, query, function)
        share = max(RERANK, max(k * 10, 100) / max(1, self.model["rows"] * read)) + 0.001  # more than the percentile's error
        if share >= 1:
            return approx.select(self.key)
        level = approx.agg(F.percentile_approx("_approx", 1 - share if farthest else share).alias("_level"))  # one row
        keep = F.col("_approx") >= F.col("_level") if farthest else F.col("_approx") <= F.col("_level")
        return approx.crossJoin(F.broadcast(level)).where(keep).select(self.key)

    def _lsh(self, query, function, k, farthest):
        """Keys of rows that share a bucket with the query (for the farthest: with its opposite) in at least one stage."""
        marks = signatures(query[None, :] * (-1 if farthest else 1), self.model["planes"], self.model["stages"], self.model["buckets"])[0]
        return self.table.where(reduce(lambda a, b: a | b, [F.get("_buckets", F.lit(s)) == F.lit(int(b)) for s, b in enumerate(marks)])).select(self.key)


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm with spread-out seeding on a bounded sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    centre = [x[rng.integers(len(x))]]
    gap = ((x - centre[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centre.append(x[rng.choice(len(x), p=gap / gap.sum()) if gap.sum() else rng.integers(len(x))])
        gap = np.minimum(gap, ((x - centre[-1]) ** 2).sum(1))
    c = np.array(centre)
    for _ in range(rounds):
        near = nearest(x, c)
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (((c**2).sum(1)[None, :]) - 2 * x @ c.T).argmin(1)


def signatures(x: np.ndarray, planes: np.ndarray, stages: int, buckets: int) -> np.ndarray:
    bits = (x @ planes.T >= 0).reshape(len(x), stages, -1)
    weight = (1 << np.arange(bits.shape[2], dtype=np.int64)) % 433494437  # (fixed value)
    return (bits @ weight) % buckets


def subspaces(d: int, wanted: int = 8) -> int:
    """The next divisor of ``d`` from ``wanted`` up to 32, else the next below."""
    return next((s for s in range(wanted, min(32, d) + 1) if d % s == 0), next(s for s in range(min(wanted, d), 0, -1) if d % s == 0))


def cells_of(x: np.ndarray, low: np.ndarray, step: np.ndarray, marks: int) -> np.ndarray:
    return np.clip(np.floor((x - low) / np.where(step == 0, 1, step)), 0, marks - 2).astype(np.uint8)


def encoded(df: DataFrame, key: str, column: str, name: str, code: Any, extra: Any = None) -> DataFrame:
    """key, the bytes ``code`` makes of each vector and, with ``extra``, a number per vector as _cell."""

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            x = np.asarray(v.flatten(), float).reshape(batch.num_rows, -1)
            out = [batch.column(0), pa.array([r.tobytes() for r in code(x)], pa.binary())]
            if extra is not None:
                out.append(pa.array(extra(x).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, [key, name, "_cell"][: len(out)])

    return df.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"`{key}` long, {name} binary" + (", _cell int" if extra is not None else ""))


def sampled(df: DataFrame, column: str, most: int) -> np.ndarray:
    """About ``most`` vectors at most."""
    some = df.select(column).sample(min(1.0, most / max(1, df.count())), seed=1).limit(2 * most).toPandas()[column]
    return np.array([np.asarray(v, float) for v in some]).reshape(len(some), -1)


def share_read(x: np.ndarray, low: np.ndarray, step: np.ndarray, marks: int, k: int = 10) -> float:
    """Share of the sample whose bounds reach the k-th best bound, over some of its vectors as queries (L2)."""
    if len(x) <= k:
        return 1.0
    edge, cells, dims, read = low + step * np.arange(marks)[:, None], cells_of(x, low, step, marks), np.arange(x.shape[1]), []
    for q in x[:: max(1, len(x) // 20)]:
        near = np.maximum(np.maximum(edge[:-1] - q, q - edge[1:]), 0)[cells, dims]
        far = np.maximum(np.abs(edge[:-1] - q), np.abs(edge[1:] - q))[cells, dims]
        read.append(((near**2).sum(1) <= np.partition((far**2).sum(1), k)[k]).mean())
    return float(np.mean(read))


def build(df: DataFrame, kind: str, name: str, column: str, key: str = "_tid", path: str | None = None, **params: Any) -> Index:
    """Build an index of ``df``, whose rows ``key`` (a long) tells apart; with ``path``, store it there.

    Learned models are fitted on about ``sample`` rows (default 20,000); every row is indexed.
    """
    kind = kind.lower()
    if kind not in KINDS:
        raise ValueError(f"no index kind {kind}")
    if kind in ("btree", "btree_uq"):
        if kind == "btree_uq" and df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").limit(1).count():
            raise ValueError(f"{column} is not unique")
        return stored(Index(kind, name, column, key, df.orderBy(column)), path)
    if kind == "lucene":
        analyser = params.get("analyzer_type", "standard").lower()
        unique = not df.groupBy(key).count().where("count > 1").limit(1).count()
        return stored(Index(kind, name, column, key, fulltext.postings(df, key, column, analyser), {"analyser": analyser, "unique": unique}), path)
    usable = df.where(F.col(column).isNotNull())
    dim = usable.agg(F.max(F.size(column))).first()[0] or 0
    usable = usable.where(F.size(column) == dim)
    x = sampled(usable, column, int(params.get("sample", 20_000)))
    if kind == "vaf":
        marks = int(params.get("marks_per_dimension", 32))
        if not 3 < marks <= 256:
            raise ValueError("a vector approximation needs more than 3 marks, and 256 at most")
        ends = usable.agg(*(f(F.col(column)[j]).cast("double").alias(f"{n}{j}") for n, f in (("a", F.min), ("b", F.max)) for j in range(dim))).first()
        low, high = np.array([e or 0.0 for e in ends[:dim]], float), np.array([e or 0.0 for e in ends[dim:]], float)
        step = (high - low) / (marks - 3)
        low = low - step  # one step of slack on either side
        table = encoded(usable, key, column, "_cells", lambda v: cells_of(v, low, step, marks))
        return stored(Index(kind, name, column, key, table, {"low": low, "step": step, "marks": marks}, reads=share_read(x[:2000], low, step, marks)), path)
    if kind == "lsh":
        stages, buckets = int(params.get("stages", 20)), int(params.get("buckets", 50))
        per = max(1, min(stages * buckets // 2 // stages, 62, int(params.get("bits", 4))))
        rng, rows = np.random.default_rng(params.get("seed", 0)), []
        while len(rows) < stages * per and dim:  # orthogonal groups of at most dim planes
            rows.extend(np.linalg.qr(rng.standard_normal((dim, dim)))[0].T)
        planes = np.array(rows[: stages * per]).reshape(-1, dim)

        @F.pandas_udf("array<long>")
        def mark(v):
            return __import__("pandas").Series(list(signatures(np.array(v.tolist(), float), planes, stages, buckets)))

        known = signatures(x[:2000], planes, stages, buckets) if len(x) else np.zeros((0, stages))
        reads = float(np.mean([(known == known[i]).any(axis=1).mean() for i in range(0, len(known), max(1, len(known) // 20))])) if len(known) else 1.0
        table = usable.select(F.col(key).cast("long").alias(key), mark(column).alias("_buckets"))
        return stored(Index(kind, name, column, key, table, {"planes": planes, "stages": stages, "buckets": buckets}, exact=False, reads=reads), path)
    parts = np.array_split(np.arange(dim), subspaces(dim, int(params.get("subspaces", 8))))
    books = [kmeans(x[:, p], int(params.get("centroids", 256 if kind == "pq" else 512)), seed=int(params.get("seed", 0))) for p in parts]
    model: dict[str, Any] = {"books": books, "distance": params.get("distance", "euclidean"), "rows": usable.count()}
    code = lambda v: np.stack([nearest(v[:, p], b) for p, b in zip(parts, books, strict=True)], axis=1).astype("<u2")
    reads, cell = RERANK, None
    if kind == "ivfpq":
        coarse = kmeans(x, int(params.get("coarse", 64)), seed=1)
        model |= {"coarse": coarse, "probes": int(params.get("probes", max(1, -(-len(coarse) * 3 // 4))))}
        cell = lambda v: nearest(v, coarse)
        reads = RERANK * model["probes"] / len(coarse)
    table = encoded(usable, key, column, "_codes", code, cell)
    if cell is not None:
        table = table.orderBy("_cell")  # a probe reads the row groups of its cells
    return stored(Index(kind, name, column, key, table, model, exact=False, reads=reads), path)


# storing
def _packed(x: Any) -> Any:
    if isinstance(x, np.ndarray):
        return {"array": base64.b64encode(np.ascontiguousarray(x, float).tobytes()).decode(), "shape": x.shape}
    return [_packed(v) for v in x] if isinstance(x, list) else x


def _unpacked(x: Any) -> Any:
    if isinstance(x, dict) and "array" in x:
        return np.frombuffer(base64.b64decode(x["array"]), float).reshape(x["shape"]).copy()
    return [_unpacked(v) for v in x] if isinstance(x, list) else x


def stored(index: Index, path: str | None) -> Index:
    """The index with its side table and model written to ``path``; the model last, so a half-written index is none."""
    spark, schema = index.table.sparkSession, index.table.schema
    if path is not None:
        index.table.write.parquet(f"{path}/table")
        index.table = spark.read.schema(schema).parquet(f"{path}/table")
    index.table = opened(index.kind, index.table, index.key)
    if index.kind == "lucene":
        index.model |= fulltext.totals(index.table)
    if path is None:
        return index
    told = {"kind": index.kind, "name": index.name, "column": index.column, "key": index.key, "exact": index.exact, "reads": index.reads, "schema": schema.jsonValue(), "model": {k: _packed(v) for k, v in index.model.items()}}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/model")
    return index


def opened(kind: str, table: DataFrame, key: str) -> DataFrame:
    """The side table as look-ups read it; an index of texts that an earlier version has stored has its postings as rows."""
    return fulltext.unlisted(table, key) if kind == "lucene" and "keys" in table.columns else table


def load(spark: SparkSession, path: str) -> Index:
    told = json.loads(spark.read.text(f"{path}/model", wholetext=True).first()[0])
    table = spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(f"{path}/table")
    return Index(told["kind"], told["name"], told["column"], told["key"], opened(told["kind"], table, told["key"]), {k: _unpacked(v) for k, v in told["model"].items()}, told["exact"], told["reads"])


def enn(df: DataFrame, column: str, query: list[float], function: str, radius: float) -> DataFrame:
    """All rows within ``radius``."""
    return df.withColumn("distance", V.lookup(function)(column, query)).where(F.col("distance") <= radius)
