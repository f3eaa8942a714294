"""Exact top-k inner product search with a vector-approximation file.

``build`` stores each vector as one byte per dimension (the cell of an equidistant grid between the column's least
and greatest value).  ``search`` scans those cells only: every query keeps the rows whose upper bound reaches its
k-th best lower bound, first within a task, then over all tasks.  The exact vectors of the few rows left are read
and visited in order of their bound until the k-th score is certain; a query with many rows left (ties) is visited in
parts, whose best rows meet at the end.  Of equal vectors, a task passes on the k with the smallest ids, since no other
can be an answer.  Scores are exact integers; bounds are doubles widened by more than their rounding.

Queries are taken in blocks of ``block`` vectors, one after the other, and what a block leaves is written before the
next begins: neither a task nor the driver holds more than one block and a slice of cells, whatever the size.

Edge cases: vectors that are null or hold a null or non-finite component take no part (nor do those that are not finite
once multiplied by 1024), nor do rows without an id; a shorter vector counts as one with zeros behind; a score beyond a
long is given as the nearest long.  Equal scores go to the smaller id.  Rows are told apart by a number of their own: a
query leaves out its own row only, rows that repeat an id are separate candidates, and queries that repeat an id are
answered each on its own.  Fewer candidates than k give fewer rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm import scratch

SCALE = 1024
CELLS = 256
LONG = (1 << 63) - 1
OUT = "query_id long, rank int, vec_id long, score long"


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v array<double>: floor(1024 * x) of every usable vector; a double holds these whole numbers exactly."""
    scaled = F.transform(F.col(column), lambda e: e.cast("double") * SCALE)
    usable = F.forall(F.col("v"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    table = vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("vec_id"), scaled.alias("v")).where(usable)
    # FLOOR gives a long, which cannot hold large ones; beyond 2**52 every double is whole
    whole = F.transform("v", lambda e: F.when(F.abs(e) < float(1 << 52), F.floor(e).cast("double")).otherwise(e))
    return table.select("vec_id", whole.alias("v"))


def build(table: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The approximation file (row, vec_id, cells, hash of v, v), the least value and the cell width of each dimension."""
    dim = table.agg(F.max(F.size("v"))).first()[0] or 0
    at = lambda j: F.coalesce(F.get("v", F.lit(j)), F.lit(0.0))
    ends = table.select(*(f(at(j)).alias(f"{n}{j}") for n, f in (("a", F.min), ("b", F.max)) for j in range(dim))).first() if dim else []
    low, high = (np.array([x or 0.0 for x in part], float) for part in (ends[:dim], ends[dim:]))
    width = np.maximum(1.0, np.ceil((high / CELLS - low / CELLS) * (1 + 1e-12)))  # the grid of each dimension

    def cells(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                v = part.column(2)
                size = np.diff(np.asarray(v.offsets))
                full = np.zeros((part.num_rows, dim))
                full[np.arange(dim) < size[:, None]] = np.asarray(v.flatten())
                code = np.clip(np.floor(full / width - low / width), 0, CELLS - 1).astype(np.uint8)
                same = [xxhash.xxh3_128_digest((r + 0.0).tobytes()) for r in full]  # 0.0 and -0.0 are one number
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(same, pa.binary()), v], ["row", "vec_id", "cells", "same", "v"])

    return table.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInArrow(cells, "row long, vec_id long, cells binary, same binary, v array<double>"), low, width


def score(q: np.ndarray, v: np.ndarray) -> int:
    """The exact inner product of whole numbers, at most a long."""
    n = min(len(q), len(v))
    q, v = q[:n], v[:n]
    if np.abs(q) @ np.abs(v) < float(1 << 53):  # no partial sum is rounded
        return int(q @ v)
    return max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(q.tolist(), v.tolist(), strict=True))))


def search(table: DataFrame, queries: Column, k: int = 10, block: int = 4096, visit: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score. ``table``: vec_id, v as ``integers`` makes them; ``queries``: which of its rows are queries."""
    spark = table.sparkSession
    stored, low, width = build(table)
    dim = len(low)
    stored = scratch.save(stored, "cells")  # the row ids hold in the stored table only
    asked = stored.where(queries).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):  # a block is about `block` query vectors
        some = asked.where(F.pmod(F.xxhash64("query_row"), F.lit(blocks)) == b).toPandas()
        q = np.zeros((len(some), dim))
        for i, v in enumerate(some["q"]):
            q[i, : len(v)] = v
        one = stored.select("row", "vec_id", "cells", "same").mapInArrow(bounds(some["query_row"].to_numpy(np.int64), q, low, width, k), "query_row long, row long, vec_id long, most double, least double")
        one = scratch.save(one, "found")
        found = one if found is None else found.unionByName(one)
    # the k-th best lower bound over all tasks
    w = Window.partitionBy("query_row").orderBy(F.desc("least"), "vec_id")
    level = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_row").agg(F.min("least").alias("level"), F.count("*").alias("n"))
    left = found.join(level, "query_row").where((F.col("n") < k) | (F.col("most") >= F.col("level"))).select("query_row", "row", "vec_id", "most")
    parts = left.groupBy("query_row").agg(F.ceil(F.count(F.lit(1)) / visit).cast("int").alias("parts"))
    exact = left.join(parts, "query_row").join(stored.select("row", "v"), "row").join(asked, "query_row")

    def best_of(batches):
        """Rows come by query in the order of their bounds; few stay."""
        at, best, out = None, [], ([], [], [], [])

        def close():
            for s, vec in best:
                for column, value in zip(out, (*at[1:], vec, -s), strict=True):
                    column.append(value)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_row", "query_id", "vec_id", "score"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            part, row, ident, most, vec = (batch.column(j).to_pylist() for j in range(5))
            v, q = batch.column(5), batch.column(6)
            for i in range(batch.num_rows):
                if at != (part[i], row[i], ident[i]):
                    close()
                    at, best, sure = (part[i], row[i], ident[i]), [], False
                    query = np.asarray(q[i].values, float)
                if sure:
                    continue
                if len(best) == k and most[i] < -best[-1][0]:
                    sure = True  # no later row can reach the k-th score
                    continue
                best = sorted([*best, (-score(query, np.asarray(v[i].values, float)), vec[i])])[:k]
            yield flush()
        close()
        yield flush()

    dealt = exact.select(F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), "query_row", "query_id", "most", "vec_id", "v", "q")
    some = dealt.repartition("query_row", "part").sortWithinPartitions("query_row", "part", F.desc("most"), "vec_id")
    some = some.mapInArrow(best_of, "query_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bounds(query_rows: np.ndarray, q: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    """Scan cells: upper and lower bound of every score, keeping what can be among a query's best k of this task."""
    scaled = (q * width).T.copy()
    shift = q @ low
    up, down = shift + np.maximum(q, 0) @ (width - 1), shift + np.minimum(q, 0) @ (width - 1)
    margin = np.abs(q) @ (np.abs(low) + width * (CELLS + 1)) * 1e-12 + 1  # rounding of the sums in double
    number = len(query_rows)
    vast = not np.isfinite(margin).all()  # sums beyond a double bound nothing

    def thin(kept):
        """Of all rows kept so far, those that can still be among the best k of their query."""
        i, row, vec, most, least, same = kept
        order = np.lexsort((-least, i))
        i, least = i[order], least[order]
        at = np.searchsorted(i, np.arange(number)) + k - 1
        full = (at < len(i)) & (np.take(i, np.minimum(at, len(i) - 1)) == np.arange(number)) if len(i) else np.zeros(number, bool)
        level = np.where(full, np.take(least, np.minimum(at, max(len(i) - 1, 0))) if len(i) else 0, -np.inf)
        order = order[kept[3][order] >= level[i]]
        if len(order) > 2 * k * number:  # there may be equal vectors: the k smallest ids of each will do
            order = order[np.lexsort((row[order], vec[order], same[order, 1], same[order, 0], kept[0][order]))]
            what = np.column_stack([kept[0][order].astype(np.uint64), same[order]])
            first = np.concatenate([[True], (what[1:] != what[:-1]).any(axis=1)])
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            order = order[place < k]
        return tuple(x[order] for x in kept)

    def run(batches):
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((0, 2), np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, vec = np.asarray(part.column(0), np.int64), np.asarray(part.column(1), np.int64)
                cell = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(vec), -1).astype(float)
                same = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint64).reshape(-1, 2)
                new = []
                for a in range(0, number, 256):  # bounds the score matrix
                    s = (cell @ scaled[:, a : a + 256]).T
                    least, most = s + (down - margin)[a : a + 256, None], s + (up + margin)[a : a + 256, None]
                    if vast:
                        least, most = np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)
                    own = query_rows[a : a + 256, None] == row[None, :]
                    least[own] = -np.inf
                    level = np.partition(least, len(vec) - k, axis=1)[:, len(vec) - k, None] if len(vec) > k else -np.inf
                    i, j = np.nonzero((most >= level) & ~own)
                    new.append((i + a, row[j], vec[j], most[i, j], least[i, j], same[j]))
                if new:
                    kept = thin(tuple(np.concatenate(x) for x in zip(kept, *new, strict=True)))
        i, row, vec, most, least, _ = kept
        yield pa.RecordBatch.from_arrays([pa.array(query_rows[i]), pa.array(row), pa.array(vec), pa.array(most), pa.array(least)], ["query_row", "row", "vec_id", "most", "least"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH t AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
      FROM t q JOIN t c ON q.vec_id % 100 = 0 AND q.n <> c.n),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
