"""The registered queries of the engine's own operators and their DuckDB text.

Every query runs over its whole tables. Floating-point results are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions import fulltext
from vecloom.functions import vectors as V
from vecloom.operators import predicates as P
from vecloom.operators import stats
from vecloom.operators.indexes import kinds
from vecloom.plans.query import Query
from vecloom.sources import files
from vecloom.sources.catalog import Catalog, Entity
from vecloom.sources.shared import shared_dir
from vecloom.types import ColumnDef

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The query vector of the distance queries (fixed values): 64 steps of an eighth, alternating in sign.
POINT = [((-1) ** i) * (i % 9) / 8 for i in range(64)]
WEIGHTS = [(i % 4 + 1) / 4 for i in range(64)]
SQL_POINT = "[" + ", ".join(f"{x!r}::DOUBLE" for x in POINT) + "]"
SQL_WEIGHTS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in WEIGHTS) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def simple(name: str, source: str, build: Callable[[Query], Query], oracle: str) -> None:
    register(name, oracle)(lambda spark, sf_dir: build(Query(table(spark, sf_dir, source))).frame())


# sources and projections
simple("select_star", "nation", lambda q: q, "SELECT * FROM nation")
simple("scan_project", "orders", lambda q: q.select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders")
simple("alias", "nation", lambda q: q.select(("n_name", "name"), ("n_nationkey", "key")), "SELECT n_name AS name, n_nationkey AS key FROM nation")
register("subselect_from", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') WHERE o_totalprice > 1000")(
    lambda spark, d: Query(Query(table(spark, d, "orders")).where(("o_orderstatus", "=", "F")).select("o_orderkey", "o_totalprice")).where(("o_totalprice", ">", 1000)).select("o_orderkey").frame()
)
register("sample")(lambda spark, d: Query(table(spark, d, "orders")).sample(0.1, 7).select("o_orderkey").frame())
simple("count_pushdown", "lineitem", lambda q: q.count("n"), "SELECT count(*) AS n FROM lineitem")

# predicates; the table has NULLs where a value is even, so that two-valued logic shows
OPS = {"eq": "=", "neq": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
for _name, _op in OPS.items():
    simple(f"filter_{_name}", "lineitem", lambda q, o=_op: q.where(("l_quantity", o, 24.0)).select("l_orderkey", "l_linenumber"), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity {_op} 24")
simple(
    "filter_and_or_not", "orders",
    lambda q: q.where((P.compare("o_orderstatus", "=", "F") & P.negate(P.compare("o_totalprice", "<", 50000.0))) | P.compare("o_orderpriority", "=", "1-URGENT")).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND NOT coalesce(o_totalprice < 50000, false)) OR o_orderpriority = '1-URGENT'",
)
register("filter_not_null_two_valued", "SELECT p_partkey FROM (SELECT p_partkey, nullif(p_size % 5, 0) AS x FROM part) WHERE NOT coalesce(x = 3, false)")(
    lambda spark, d: Query(table(spark, d, "part").withColumn("x", F.nullif(F.col("p_size") % 5, F.lit(0)))).where(P.negate(P.compare("x", "=", 3))).select("p_partkey").frame()
)
simple("filter_between_swapped", "part", lambda q: q.where(P.between("p_size", 20, 10)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
simple("filter_in", "customer", lambda q: q.where(P.isin("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
register("filter_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(
    lambda spark, d: Query(table(spark, d, "orders")).where_in_query("o_custkey", Query(table(spark, d, "customer")).where(("c_acctbal", ">", 5000.0)).select("c_custkey")).select("o_orderkey").frame()
)
for _name, _pattern in {"prefix": "P%", "suffix": "%1", "regex": "%a_t%"}.items():
    simple(f"filter_like_{_name}", "part", lambda q, p=_pattern: q.where(P.like("p_name", p)).select("p_partkey"), f"SELECT p_partkey FROM part WHERE p_name LIKE '{_pattern}'")
register("filter_is_null", "SELECT p_partkey FROM part WHERE p_size % 5 = 0")(
    lambda spark, d: Query(table(spark, d, "part").withColumn("x", F.nullif(F.col("p_size") % 5, F.lit(0)))).where(P.isnull("x")).select("p_partkey").frame()
)
simple("filter_column_to_column", "lineitem", lambda q: q.where(("l_tax", ">", F.col("l_discount"))).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount")
simple("filter_literal", "nation", lambda q: q.where(F.lit(True)).where(P.any_of()).select("n_name"), "SELECT n_name FROM nation WHERE false")

# aggregates
simple("agg_sum", "lineitem", lambda q: q.aggregate("sum", "l_quantity"), "SELECT sum(l_quantity::DOUBLE) AS sum_l_quantity FROM lineitem")
simple("agg_min", "lineitem", lambda q: q.aggregate("min", "l_extendedprice", "l_quantity"), "SELECT min(l_extendedprice) AS min_l_extendedprice, min(l_quantity) AS min_l_quantity FROM lineitem")
simple("agg_max", "customer", lambda q: q.aggregate("max", "c_acctbal", "c_custkey"), "SELECT max(c_acctbal) AS max_c_acctbal, max(c_custkey) AS max_c_custkey FROM customer")
simple("agg_count", "orders", lambda q: q.where(("o_orderstatus", "=", "O")).count(), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O'")
simple("agg_count_distinct", "lineitem", lambda q: q.count_distinct("l_returnflag", "l_linestatus"), "SELECT count(*) AS count FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
simple("exists", "orders", lambda q: q.where(("o_totalprice", "<", 0.0)).exists(), 'SELECT count(*) > 0 AS "exists" FROM orders WHERE o_totalprice < 0')
register("agg_mean", "SELECT round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_linenumber), 6) AS mean_l_linenumber FROM lineitem")(
    lambda spark, d: (lambda f: f.select(*(F.round(c, 6).alias(c) for c in f.columns)))(Query(table(spark, d, "lineitem")).aggregate("mean", "l_quantity", "l_linenumber").frame())
)
register("aggregate_after_limit", "SELECT round(sum(o_totalprice), 2) AS s FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")(
    lambda spark, d: Query(table(spark, d, "orders")).order_by(("o_totalprice", "desc"), "o_orderkey").limit(100).aggregate("sum", "o_totalprice").frame().select(F.round("sum_o_totalprice", 2).alias("s"))
)
simple("distinct_single", "lineitem", lambda q: q.distinct("l_returnflag"), "SELECT DISTINCT l_returnflag FROM lineitem")
simple("distinct_multi", "customer", lambda q: q.distinct("c_mktsegment", "c_nationkey"), "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")

# order, skip, limit: a unique last key makes the row set definite
simple("sort_multi", "customer", lambda q: q.order_by("c_mktsegment", ("c_acctbal", "desc"), "c_custkey").select("c_custkey"), "SELECT c_custkey FROM customer")
# the order itself: the place of each row in the result
register("sort_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer")(
    lambda spark, d: Query(table(spark, d, "customer")).order_by("c_mktsegment", ("c_acctbal", "desc"), "c_custkey").select("c_custkey").frame()
    .withColumn("_k", F.monotonically_increasing_id()).select("c_custkey", F.row_number().over(Window.orderBy("_k")).cast("long").alias("place"))
)
register("topk_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 25")(
    lambda spark, d: Query(table(spark, d, "orders")).order_by(("o_totalprice", "desc"), "o_orderkey").limit(25).select("o_orderkey").frame()
    .withColumn("_k", F.monotonically_increasing_id()).select("o_orderkey", F.row_number().over(Window.orderBy("_k")).cast("long").alias("place"))
)
simple("topk", "orders", lambda q: q.order_by(("o_totalprice", "desc"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
simple("skip_limit", "orders", lambda q: q.order_by("o_orderkey").skip(50).limit(20).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 50")
register("sort_nulls", "SELECT p_partkey FROM (SELECT p_partkey, nullif(p_size % 5, 0) AS x FROM part) ORDER BY x ASC NULLS FIRST, p_partkey LIMIT 30")(
    lambda spark, d: Query(table(spark, d, "part").withColumn("x", F.nullif(F.col("p_size") % 5, F.lit(0)))).order_by("x", "p_partkey").limit(30).select("p_partkey").frame()
)

# scalar and vector functions
for _fn, _sql in {"add": "l_quantity + l_tax", "sub": "l_quantity - l_tax", "mul": "l_quantity * l_tax", "div": "l_extendedprice / l_quantity", "max": "greatest(l_discount, l_tax)", "min": "least(l_discount, l_tax)"}.items():
    _a, _b = ("l_extendedprice", "l_quantity") if _fn == "div" else ("l_discount", "l_tax") if _fn in ("max", "min") else ("l_quantity", "l_tax")
    register(f"fn_{_fn}", f"SELECT l_orderkey, l_linenumber, {_sql} AS x FROM lineitem")(
        lambda spark, d, f=_fn, a=_a, b=_b: Query(table(spark, d, "lineitem")).function(f, a, b, alias="x").frame().select("l_orderkey", "l_linenumber", "x")
    )
register("fn_intdiv", "SELECT l_orderkey, l_linenumber, l_partkey // l_linenumber AS x FROM lineitem")(
    lambda spark, d: Query(table(spark, d, "lineitem")).function("div", "l_partkey", "l_linenumber", alias="x").frame().select("l_orderkey", "l_linenumber", "x")
)
for _fn, _sql in {"abs": "abs(l_discount - 0.05)", "sqrt": "sqrt(l_tax)", "exp": "exp(l_tax)", "ln": "ln(l_quantity)", "sin": "sin(l_quantity)", "cos": "cos(l_quantity)", "tan": "tan(l_tax)", "atan": "atan(l_quantity)"}.items():
    _a = "x" if _fn == "abs" else _sql[len(_fn) + 1 : -1]
    register(f"fn_{_fn}", f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS y FROM lineitem")(
        lambda spark, d, f=_fn, a=_a: Query(table(spark, d, "lineitem").withColumn("x", F.col("l_discount") - 0.05)).function(f, a, alias="y").frame().select("l_orderkey", "l_linenumber", F.round("y", 6).alias("y"))
    )
register("fn_pow", "SELECT l_orderkey, l_linenumber, round(pow(l_tax, 3), 6) AS y FROM lineitem")(
    lambda spark, d: Query(table(spark, d, "lineitem")).function("pow", "l_tax", 3, alias="y").frame().select("l_orderkey", "l_linenumber", F.round("y", 6).alias("y"))
)
simple("filter_function", "lineitem", lambda q: q.function("mul", "l_quantity", "l_tax", alias="t").where(("t", ">", 2.0)).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_tax > 2")
_PAIR = f"list_zip(embedding, {SQL_POINT})"
_VEC = {
    "vadd": (lambda: V.vadd(F.col("embedding"), POINT), "p[1]::DOUBLE + p[2]"),
    "vsub": (lambda: V.vsub(F.col("embedding"), POINT), "p[1]::DOUBLE - p[2]"),
    "vmax": (lambda: V.vmax(F.col("embedding"), POINT), "greatest(p[1]::DOUBLE, p[2])"),
    "vmin": (lambda: V.vmin(F.col("embedding"), POINT), "least(p[1]::DOUBLE, p[2])"),
    "vmul": (lambda: V.vmul(F.transform("embedding", lambda x: x.cast("double")), F.col("label")), "p[1]::DOUBLE * label"),
}
for _fn, (_make, _sql) in _VEC.items():
    register(f"vec_{_fn}", f"SELECT vec_id, round(list_sum(list_transform({_PAIR}, lambda p: {_sql})), 4) AS x FROM embeddings")(
        lambda spark, d, m=_make: table(spark, d, "embeddings").select("vec_id", F.round(V.vsum(m()), 4).alias("x"))
    )
register("vec_vsum", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS x FROM embeddings")(lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(V.vsum("embedding"), 4).alias("x")))
# the overloads of scalar names
for _fn, _op in {"add": "+", "sub": "-"}.items():
    register(f"vec_{_fn}", f"SELECT vec_id, round(list_sum(list_transform({_PAIR}, lambda p: p[1]::DOUBLE {_op} p[2])), 4) AS x FROM embeddings")(
        lambda spark, d, f=_fn: Query(table(spark, d, "embeddings")).function(f, "embedding", POINT, alias="v").function("vsum", "v", alias="s").frame().select("vec_id", F.round("s", 4).alias("x"))
    )
register("vec_mul", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * label)), 4) AS x FROM embeddings")(
    lambda spark, d: Query(table(spark, d, "embeddings")).function("mul", "embedding", "label", alias="v").function("vsum", "v", alias="s").frame().select("vec_id", F.round("s", 4).alias("x"))
)
register("vec_norm2", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS x FROM embeddings")(
    lambda spark, d: Query(table(spark, d, "embeddings")).function("norm2", "embedding", alias="s").frame().select("vec_id", F.round("s", 4).alias("x"))
)
register("vec_lp", f"SELECT vec_id, round(pow(list_sum(list_transform({_PAIR}, lambda p: pow(abs(p[1]::DOUBLE - p[2]), 3))), 1.0 / 3), 4) AS x FROM embeddings")(
    lambda spark, d: Query(table(spark, d, "embeddings")).function("lp", "embedding", POINT, 3.0, alias="s").frame().select("vec_id", F.round("s", 4).alias("x"))
)
register("vec_slice", "SELECT vec_id, round(list_sum(list_transform(embedding[9:16], lambda x: x::DOUBLE)), 4) AS x FROM embeddings")(
    lambda spark, d: Query(table(spark, d, "embeddings")).function("slice", "embedding", 8, 8, alias="v").function("vsum", "v", alias="s").frame().select("vec_id", F.round("s", 4).alias("x"))
)

# distances
_SUM = lambda term: f"list_sum(list_transform({_PAIR}, lambda p: {term}))"
_NORM = f"sqrt(list_sum(list_transform({SQL_POINT}, lambda x: x * x)))"
DISTANCES = {
    "manhattan": _SUM("abs(p[1]::DOUBLE - p[2])"),
    "euclidean": f"sqrt({_SUM('(p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])')})",
    "squaredeuclidean": _SUM("(p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])"),
    "hamming": _SUM("CASE WHEN p[1]::DOUBLE <> p[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "cosine": f"1 - {_SUM('p[1]::DOUBLE * p[2]')} / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * {_NORM})",
    "innerproduct": _SUM("p[1]::DOUBLE * p[2]"),
}
for _fn, _sql in DISTANCES.items():
    register(f"dist_{_fn}", f"SELECT vec_id, round({_sql}, 4) AS distance FROM embeddings")(
        lambda spark, d, f=_fn: table(spark, d, "embeddings").select("vec_id", F.round(V.lookup(f)("embedding", POINT), 4).alias("distance"))
    )
register("dist_chisquared", f"SELECT vec_id, round({_SUM('CASE WHEN abs(p[1]::DOUBLE) + abs(p[2]) = 0 THEN 0 ELSE power(abs(p[1]::DOUBLE) - abs(p[2]), 2) / (abs(p[1]::DOUBLE) + abs(p[2])) END')}, 4) AS distance FROM embeddings")(
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(V.chisquared(F.transform("embedding", lambda x: F.abs(x.cast("double"))), [abs(x) for x in POINT]), 4).alias("distance"))
)
register("dist_hyperplane", f"SELECT vec_id, round(({_SUM('p[1]::DOUBLE * p[2]')} + 0.5) / {_NORM}, 4) + 0.0 AS distance FROM embeddings")(
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", (F.round(V.hyperplane(F.col("embedding"), POINT, 0.5), 4) + F.lit(0.0)).alias("distance"))
)
register("dist_manhattanw", f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {SQL_POINT}, {SQL_WEIGHTS}), lambda p: p[3] * abs(p[1]::DOUBLE - p[2]))), 4) AS distance FROM embeddings")(
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(V.manhattanw(F.col("embedding"), POINT, WEIGHTS), 4).alias("distance"))
)
register(
    "dist_haversine",
    "SELECT c_custkey, round(2 * 6371000.0 * asin(least(1.0, sqrt(power(sin((radians(c_nationkey * 3.0) - radians(47.5)) / 2), 2) + cos(radians(c_nationkey * 3.0)) * cos(radians(47.5)) * power(sin((radians(c_acctbal / 100) - radians(7.6)) / 2), 2)))), 2) AS distance FROM customer",
)(lambda spark, d: table(spark, d, "customer").select("c_custkey", F.round(V.haversine(F.array(F.col("c_nationkey") * F.lit(3.0), F.col("c_acctbal") / 100), [47.5, 7.6]), 2).alias("distance")))


# complex vectors: the components of an embedding taken in pairs
COMPLEX = [complex(POINT[2 * i], POINT[2 * i + 1]) for i in range(32)]


def paired(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = F.col("embedding")
    pair = lambda i: F.struct(F.get(e, i * 2).cast(kind).alias("re"), F.get(e, i * 2 + 1).cast(kind).alias("im"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), pair).alias("z"))


_HALVES = "list_transform(range(0, 32), lambda i: {'a': embedding[2 * i + 1]::DOUBLE, 'b': embedding[2 * i + 2]::DOUBLE, 'c': " + SQL_POINT + "[2 * i + 1], 'd': " + SQL_POINT + "[2 * i + 2]})"
_OVER = lambda term: f"list_sum(list_transform({_HALVES}, lambda p: {term}))"
_SQUARE = "pow(p.a - p.c, 2) + pow(p.b - p.d, 2)"
_DOT = f"sqrt(pow({_OVER('p.a * p.c + p.b * p.d')}, 2) + pow({_OVER('p.b * p.c - p.a * p.d')}, 2))"
for _name, _fn, _kind, _sql in [
    ("manhattan", "manhattan", "float", _OVER(f"sqrt({_SQUARE})")), ("euclidean", "euclidean", "float", f"sqrt({_OVER(_SQUARE)})"), ("squaredeuclidean", "squaredeuclidean", "double", _OVER(_SQUARE)),
    ("innerproduct32", "innerproduct", "float", _DOT), ("innerproduct64", "innerproduct", "double", f"1 - {_DOT}"),
]:
    register(f"dist_complex_{_name}", f"SELECT vec_id, round({_sql}, 4) AS distance FROM embeddings")(
        lambda spark, d, f=_fn, k=_kind: Query(paired(spark, d, k)).function(f, "z", COMPLEX, alias="distance").frame().select("vec_id", F.round("distance", 4).alias("distance"))
    )
register("agg_sum_complex", "SELECT round(sum(l_tax), 4) AS re, round(sum(l_discount), 4) AS im FROM lineitem")(
    lambda spark, d: Query(table(spark, d, "lineitem").select(F.struct(F.col("l_tax").alias("re"), F.col("l_discount").alias("im")).alias("z"))).aggregate("sum", "z").frame().select(F.round("sum_z.re", 4).alias("re"), F.round("sum_z.im", 4).alias("im"))
)
register("agg_mean_complex", "SELECT round(avg(l_tax), 6) AS re, round(avg(l_discount), 6) AS im FROM lineitem")(
    lambda spark, d: Query(table(spark, d, "lineitem").select(F.struct(F.col("l_tax").alias("re"), F.col("l_discount").alias("im")).alias("z"))).aggregate("mean", "z").frame().select(F.round("mean_z.re", 6).alias("re"), F.round("mean_z.im", 6).alias("im"))
)


# neighbours
def _knn(name: str, kind: str, order: str = "ASC", where: str = "", k: int = 10) -> str:
    return f"SELECT vec_id, round(d, 4) AS distance FROM (SELECT vec_id, label, {DISTANCES[kind]} AS d FROM embeddings) {where} ORDER BY d {order}, vec_id LIMIT {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("distance", 4).alias("distance"))


for _fn in ("manhattan", "euclidean", "squaredeuclidean", "cosine", "innerproduct"):
    register(f"knn_{_fn}", _knn("knn", _fn))(lambda spark, d, f=_fn: _rounded(Query(table(spark, d, "embeddings")).nearest("embedding", POINT, f, 10, "vec_id").frame()))
    register(f"fns_{_fn}", _knn("fns", _fn, "DESC"))(lambda spark, d, f=_fn: _rounded(Query(table(spark, d, "embeddings")).farthest("embedding", POINT, f, 10, "vec_id").frame()))
register("knn_filtered", _knn("knn", "euclidean", where="WHERE label IN (1, 3, 5)"))(
    lambda spark, d: _rounded(Query(table(spark, d, "embeddings")).where(P.isin("label", [1, 3, 5])).nearest("embedding", POINT, "euclidean", 10, "vec_id").frame())
)
register("range_search", f"SELECT vec_id, round(d, 4) AS distance FROM (SELECT vec_id, {DISTANCES['euclidean']} AS d FROM embeddings) WHERE d <= 8")(
    lambda spark, d: _rounded(Query(table(spark, d, "embeddings")).distance("embedding", POINT, "euclidean").range("distance", 8.0).frame())
)


# indexes answer as the scan does
class _Indexed:
    def __init__(self, df: DataFrame, index: kinds.Index):
        self.df, self.index = df, index

    def frame(self) -> DataFrame:
        return self.df

    def indexes(self) -> list[kinds.Index]:
        return [self.index]


#: Indexes that this session has stored, by what they index.
_stored: dict[tuple, kinds.Index] = {}


def indexed(spark: SparkSession, sf_dir: str, kind: str, name: str = "embeddings", column: str = "embedding", key: str = "vec_id", **params) -> Query:
    """The table with an index, which is built and stored when it is first asked for."""
    what = (spark.sparkContext.applicationId, sf_dir, kind, name, column, *sorted(params.items()))
    df = table(spark, sf_dir, name)
    if what not in _stored:
        _stored[what] = kinds.build(df, kind, kind, column, key, f"{shared_dir(spark)}/vecloom/index-{uuid.uuid4().hex}", **params)
    return Query(_Indexed(df, _stored[what]))


for _fn in ("manhattan", "euclidean", "squaredeuclidean"):
    register(f"index_vaf_{_fn}", _knn("knn", _fn))(lambda spark, d, f=_fn: _rounded(indexed(spark, d, "vaf").nearest("embedding", POINT, f, 10, "vec_id").frame()))
register("index_vaf_farthest", _knn("fns", "euclidean", "DESC"))(lambda spark, d: _rounded(indexed(spark, d, "vaf").farthest("embedding", POINT, "euclidean", 10, "vec_id").frame()))
for _kind, _fn in {"pq": "euclidean", "ivfpq": "euclidean", "lsh": "cosine"}.items():
    register(f"index_{_kind}")(lambda spark, d, k=_kind, f=_fn: _rounded(indexed(spark, d, k).hint(approx=True).nearest("embedding", POINT, f, 10, "vec_id").frame()))

    @register(f"index_{_kind}_recall", "SELECT true AS enough")
    def _(spark, d, k=_kind, f=_fn):
        found = indexed(spark, d, k).hint(approx=True).nearest("embedding", POINT, f, 10, "vec_id").frame().select("vec_id")
        right = Query(table(spark, d, "embeddings")).nearest("embedding", POINT, f, 10, "vec_id").frame().select("vec_id")
        return right.join(found, "vec_id", "left_semi").agg((F.count(F.lit(1)) >= 9).alias("enough"))


# the planner answers conditions from the sorted copy
def _ordered(spark: SparkSession, d: str, kind: str = "btree", name: str = "orders", column: str = "o_orderkey") -> Query:
    return indexed(spark, d, kind, name, column, column)


register("index_btree_in", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 33, 100, 4242)")(lambda spark, d: _ordered(spark, d).where(P.isin("o_orderkey", [7, 33, 100, 4242])).select("o_orderkey", "o_totalprice").frame())
register("index_btree_eq_and_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey = 33 AND o_totalprice > 0")(
    lambda spark, d: _ordered(spark, d).where(P.compare("o_orderkey", "=", 33) & P.compare("o_totalprice", ">", 0.0)).select("o_orderkey").frame()
)
register("index_btree_range", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")(lambda spark, d: _ordered(spark, d).where(P.between("o_orderkey", 900, 100)).select("o_orderkey").frame())
register("index_btree_prefix", "SELECT p_partkey FROM part WHERE p_name LIKE 'P%'")(lambda spark, d: indexed(spark, d, "btree", "part", "p_name", "p_partkey").where(P.like("p_name", "P%")).select("p_partkey").frame())
register("index_btree_uq", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5)")(lambda spark, d: _ordered(spark, d, "btree_uq", "customer", "c_custkey").where(P.isin("c_custkey", [5])).select("c_custkey", "c_name").frame())
register("index_lucene_postings", r"SELECT term, doc_id, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents)) WHERE term IN ('that', 'para') GROUP BY term, doc_id")(
    lambda spark, d: indexed(spark, d, "lucene", "documents", "text", "doc_id").source.index.lookup(["that", "para"])
)

# fulltext
_TERMS = r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents"


def _bm25(hits: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda t: {h})) AS tf{k}" for k, h in enumerate(hits))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(hits)))
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} / (tf{k} + 1.2 * (1 - 0.75 + 0.75 * len / mean))" for k in range(len(hits)))
    return f"WITH t AS ({_TERMS}), f AS (SELECT doc_id, len(w) AS len, {tf} FROM t), s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM f) SELECT doc_id, round({score}, 4) AS score FROM f, s WHERE (" + " OR ".join(f"tf{k} > 0" for k in range(len(hits))) + ")"


def _texts(spark: SparkSession, d: str) -> Query:
    return indexed(spark, d, "lucene", "documents", "text", "doc_id")


def _scored(q: Query) -> DataFrame:
    return q.frame().select("doc_id", F.round("score", 4).alias("score"))


register("fulltext_match", _bm25(["t = 'that'", "t = 'para'"]))(lambda spark, d: _scored(_texts(spark, d).fulltext("text", "that para")))
register("fulltext_prefix", _bm25(["starts_with(t, 'ber')"]))(lambda spark, d: _scored(_texts(spark, d).fulltext("text", "ber*")))
register("fulltext_and", _bm25(["t = 'that'", "t = 'when'"]).replace(" OR ", " AND "))(lambda spark, d: _scored(_texts(spark, d).fulltext("text", "that AND when")))
register("fulltext_index_not", _bm25(["t = 'that'"]) + " AND doc_id NOT IN (SELECT doc_id FROM t WHERE list_contains(w, 'when'))")(lambda spark, d: _scored(_texts(spark, d).fulltext("text", "that NOT when")))
register("fulltext_scan", _bm25(["t = 'that'", "t = 'para'"]))(lambda spark, d: _scored(Query(table(spark, d, "documents")).fulltext("text", "that para")))
for _name, _from in {"index": _texts, "scan": lambda spark, d: Query(table(spark, d, "documents"))}.items():
    register(f"filter_match_{_name}", f"SELECT doc_id FROM ({_TERMS}) WHERE (list_contains(w, 'that') OR len(list_filter(w, lambda t: starts_with(t, 'ber'))) > 0) AND NOT list_contains(w, 'when')")(
        lambda spark, d, f=_from: f(spark, d).match("text", "that ber* -when").select("doc_id").frame()
    )
register("index_lucene_equals", "SELECT doc_id FROM documents WHERE text = (SELECT min(text) FROM documents WHERE length(text) > 10)")(
    lambda spark, d: _texts(spark, d).where(("text", "=", table(spark, d, "documents").where("length(text) > 10").agg(F.min("text")).first()[0])).select("doc_id").frame()
)
register("match_score", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN o_totalprice > 100000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 2 AS score FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", (P.compare("o_orderstatus", "=", "F") | P.compare("o_totalprice", ">", 100000.0)).score().alias("score"))
)
register("fulltext_not", _bm25(["t = 'that'"]) + " AND doc_id NOT IN (SELECT doc_id FROM t WHERE list_contains(w, 'when'))")(
    lambda spark, d: fulltext.scored(table(spark, d, "documents"), "text", "that NOT when").select("doc_id", F.round("score", 4).alias("score"))
)

# statistics
register(
    "stats_scalar",
    "SELECT count(*) AS entries, count(*) FILTER (l_tax IS NULL) AS nulls, count(DISTINCT l_tax) AS n_distinct, min(l_tax) AS min, max(l_tax) AS max, round(sum(l_tax), 3) AS sum, round(avg(l_tax), 4) AS mean, round(var_samp(l_tax), 4) AS variance FROM lineitem",
)(
    lambda spark, d: (lambda m: table(spark, d, "lineitem").agg(*(F.round(m[k], r).alias(a) if r else m[k].alias(a) for k, a, r in (("entries", "entries", 0), ("nulls", "nulls", 0), ("distinct", "n_distinct", 0), ("min", "min", 0), ("max", "max", 0), ("sum", "sum", 3), ("mean", "mean", 4), ("variance", "variance", 4)))))(
        {k: x for c, k, x in stats.measures(table(spark, d, "lineitem").select("l_tax"), exact_distinct=True)}
    )
)
register("stats_string", "SELECT min(length(c_name)) AS min_width, max(length(c_name)) AS max_width, round(avg(length(c_name)), 6) AS avg_width FROM customer")(
    lambda spark, d: (lambda m: table(spark, d, "customer").agg(m["min_width"].cast("long").alias("min_width"), m["max_width"].cast("long").alias("max_width"), F.round(m["avg_width"], 6).alias("avg_width")))({k: x for c, k, x in stats.measures(table(spark, d, "customer").select("c_name"))})
)
register("stats_vector", "SELECT i AS component, count(x) AS n, min(x::DOUBLE) AS min, max(x::DOUBLE) AS max, round(sum(x::DOUBLE), 4) AS sum, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM embeddings) GROUP BY i")(
    lambda spark, d: stats.vector_stats(table(spark, d, "embeddings"), "embedding").select("component", "n", "min", "max", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"))
)
register("analyze")(lambda spark, d: stats.analyze(table(spark, d, "orders")))
register("stats_boolean_vector", "SELECT i AS component, count(*) FILTER (x > 0) AS \"true\", count(*) FILTER (NOT x > 0) AS \"false\" FROM (SELECT unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM embeddings) GROUP BY i")(
    lambda spark, d: stats.boolean_vector_stats(table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x > 0).alias("b")), "b")
)
register("stats_complex_vector", "SELECT CAST(i AS INTEGER) AS component, count(*) AS n, round(sum(a), 4) AS sum_re, round(sum(b), 4) AS sum_im, round(avg(a), 6) AS mean_re, round(avg(b), 6) AS mean_im FROM (SELECT i, embedding[2 * i + 1]::DOUBLE AS a, embedding[2 * i + 2]::DOUBLE AS b FROM embeddings, (SELECT unnest(range(32)) AS i)) GROUP BY i")(
    lambda spark, d: stats.complex_vector_stats(paired(spark, d, "double"), "z").select("component", "n", *(F.round(f"sum_{k}", 4).alias(f"sum_{k}") for k in ("re", "im")), *(F.round(f"mean_{k}", 6).alias(f"mean_{k}") for k in ("re", "im")))
)


# data manipulation, transactions, dumps: on a catalogue of its own, filled from the tables
def catalogue(spark: SparkSession) -> Catalog:
    made = Catalog(spark, f"{shared_dir(spark)}/vecloom/catalog-{uuid.uuid4().hex}")
    made.create_schema("s")
    return made


def nations(spark: SparkSession, d: str, catalog: Catalog) -> Entity:
    catalog.create_entity("s.nation", [ColumnDef("n_nationkey", "INT", nullable=False), ColumnDef("n_name", "STRING"), ColumnDef("n_regionkey", "INT")])
    return catalog.entity("s.nation").insert(table(spark, d, "nation"))


def _nation(entity: Entity) -> DataFrame:
    return entity.frame().select("n_nationkey", "n_name", "n_regionkey")


MORE = [{"n_nationkey": 100, "n_name": "NOWHERE", "n_regionkey": 9}, {"n_nationkey": 101, "n_name": None, "n_regionkey": None}]
_MORE = "SELECT * FROM nation UNION ALL SELECT 100::INTEGER, 'NOWHERE', 9::INTEGER UNION ALL SELECT 101::INTEGER, NULL, NULL"


@register("dml_insert", _MORE)
def _(spark, d):
    return _nation(nations(spark, d, catalogue(spark)).insert(MORE))


@register("dml_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'MOVED' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation")
def _(spark, d):
    return _nation(nations(spark, d, catalogue(spark)).update(("n_regionkey", "=", 2), n_name="MOVED", n_regionkey=F.col("n_nationkey"))[0])


@register("dml_delete", f"SELECT * FROM ({_MORE}) WHERE NOT coalesce(n_regionkey < 3, false)")
def _(spark, d):
    return _nation(nations(spark, d, catalogue(spark)).insert(MORE).delete(("n_regionkey", "<", 3))[0])


@register("dml_truncate", "SELECT * FROM nation WHERE false")
def _(spark, d):
    catalog = nations(spark, d, catalogue(spark)).catalog
    catalog.truncate_entity("s.nation")
    return _nation(catalog.entity("s.nation"))


@register("tx_commit", "SELECT * FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 100::INTEGER, 'NOWHERE', 9::INTEGER UNION ALL SELECT 101::INTEGER, NULL, NULL")
def _(spark, d):
    catalog = nations(spark, d, catalogue(spark)).catalog
    transaction = catalog.begin()
    transaction.stage("s.nation", "insert", MORE)
    transaction.stage("s.nation", "delete", ("n_regionkey", "=", 1))
    transaction.commit()
    return _nation(catalog.entity("s.nation"))


@register("tx_rollback", "SELECT * FROM nation")
def _(spark, d):
    catalog = nations(spark, d, catalogue(spark)).catalog
    transaction = catalog.begin()
    transaction.stage("s.nation", "delete")
    transaction.rollback()
    return _nation(catalog.entity("s.nation"))


@register("tx_conflict", _MORE)
def _(spark, d):
    """Of two writers on one version the second fails, and all of what it has changed elsewhere with it."""
    catalog = nations(spark, d, catalogue(spark)).catalog
    catalog.create_entity("s.other", [ColumnDef("x", "INT")])
    transaction = catalog.begin()
    transaction.stage("s.other", "insert", [{"x": 1}])
    transaction.stage("s.nation", "delete")
    catalog.entity("s.nation").insert(MORE)
    try:
        transaction.commit()
    except ValueError:
        return _nation(catalog.entity("s.nation")).where(F.lit(catalog.entity("s.other").count() == 0))
    return _nation(catalog.entity("s.nation"))


for _form, _end in {"json": "", "csv": ".zip", "parquet": ""}.items():

    @register(f"dump_restore_{_form}", _MORE)
    def _(spark, d, form=_form, end=_end):
        entity = nations(spark, d, catalogue(spark)).insert(MORE)
        path = f"{entity.catalog.root}-dump{end}"
        files.dump(entity, path, form)
        return _nation(files.restore(entity.catalog, path, "t.back"))


register("count_metadata", "SELECT count(*) AS n FROM nation")(lambda spark, d: nations(spark, d, catalogue(spark)).query().count("n").frame())


@register("entity_statistics", "SELECT 's.nation.n_regionkey' AS dbo, 'nulls' AS key, '0' AS value UNION ALL SELECT 's.nation.n_regionkey', 'distinct', CAST(count(DISTINCT n_regionkey) AS VARCHAR) FROM nation UNION ALL SELECT 's.nation.n_name', 'max_width', CAST(max(length(n_name)) AS VARCHAR) FROM nation")
def _(spark, d):
    entity = nations(spark, d, catalogue(spark))
    entity.analyze(exact_distinct=True)
    return entity.statistics().where("(dbo LIKE '%n_regionkey' AND key IN ('nulls', 'distinct')) OR (dbo LIKE '%n_name' AND key = 'max_width')")


# SQL text with the vector functions; joins, groups, windows and sets are Spark's own
def sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    V.register_sql(spark)
    for name in tables:
        table(spark, d, name).createOrReplaceTempView(f"vecloom_{name}")
    return spark.sql(text)


_TEXT_POINT = "array(" + ", ".join(V.literal(x) for x in POINT) + ")"
for _fn in ("manhattan", "euclidean", "squaredeuclidean", "hamming", "cosine", "innerproduct"):
    register(f"sql_{_fn}", f"SELECT vec_id, round({DISTANCES[_fn]}, 4) AS distance FROM embeddings")(
        lambda spark, d, f=_fn: sql(spark, d, f"SELECT vec_id, round({f}(embedding, {_TEXT_POINT}), 4) AS distance FROM vecloom_embeddings", "embeddings")
    )
for _name, (_text, _used) in {
    "join": ("SELECT c_custkey, count(*) AS n FROM {0}customer JOIN {0}orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) > 5", ("customer", "orders")),
    "window": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {0}orders", ("orders",)),
    "sets": ("SELECT n_regionkey AS k FROM {0}nation INTERSECT SELECT r_regionkey FROM {0}region EXCEPT SELECT 3", ("nation", "region")),
}.items():
    register(f"sql_passthrough_{_name}", _text.format(""))(lambda spark, d, t=_text, u=_used: sql(spark, d, t.format("vecloom_"), *u))
