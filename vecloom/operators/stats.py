"""ANALYZE: one aggregate over all columns, as (dbo, key, value) rows. Vectors of a declared dimension are measured component by component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def measures(df: DataFrame, exact_distinct: bool = False) -> list[tuple[str, str, object]]:
    """(column, key, aggregate) for every column by its type."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        out += [(f.name, "entries", F.count(F.lit(1))), (f.name, "nulls", F.count_if(c.isNull())), (f.name, "non_nulls", F.count(c))]
        if not isinstance(f.dataType, T.ArrayType | T.StructType | T.BinaryType):
            out.append((f.name, "distinct", F.count_distinct(c) if exact_distinct else F.approx_count_distinct(c, 0.01)))
        if isinstance(f.dataType, T.NumericType):
            x = c.cast("double")
            out += [(f.name, k, g(x)) for k, g in (("min", F.min), ("max", F.max), ("sum", F.sum), ("mean", F.avg), ("variance", F.var_samp), ("skewness", F.skewness), ("kurtosis", F.kurtosis))]
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType) and f.metadata.get("dim"):
            x = lambda j, c=c: F.get(c, F.lit(j)).cast("double")
            out += [(f.name, k, F.array(*(g(x(j)) for j in range(f.metadata["dim"])))) for k, g in (("min", F.min), ("max", F.max), ("sum", F.sum), ("mean", F.avg))]
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.BooleanType) and f.metadata.get("dim"):
            out += [(f.name, k, F.array(*(F.count_if(F.get(c, F.lit(j)) == v) for j in range(f.metadata["dim"])))) for k, v in (("true", True), ("false", False))]
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and f.metadata.get("dim"):
            x = lambda j, r, c=c: F.get(c, F.lit(j))[r].cast("double")
            out += [(f.name, f"{k}_{r}", F.array(*(g(x(j, r)) for j in range(f.metadata["dim"])))) for k, g in (("sum", F.sum), ("mean", F.avg)) for r in ("re", "im")]
        elif isinstance(f.dataType, T.StructType):
            out += [(f.name, f"{k}_{r}", g(c[r].cast("double"))) for k, g in (("sum", F.sum), ("mean", F.avg)) for r in ("re", "im")]
        elif isinstance(f.dataType, T.BooleanType):
            out += [(f.name, "true", F.count_if(c)), (f.name, "false", F.count_if(~c))]
        elif isinstance(f.dataType, T.StringType | T.BinaryType):
            w = F.length(c)
            out += [(f.name, "min_width", F.min(w)), (f.name, "max_width", F.max(w)), (f.name, "avg_width", F.avg(w))]
        elif isinstance(f.dataType, T.TimestampType | T.DateType):
            out += [(f.name, "min", F.min(c)), (f.name, "max", F.max(c))]
    return out


def analyze(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """All metrics of all columns in one pass over the table."""
    found = measures(df, exact_distinct)
    row = df.agg(*(m.cast("string").alias(f"m{k}") for k, (_, _, m) in enumerate(found)))
    pairs = F.array(*(F.struct(F.lit(c).alias("dbo"), F.lit(key).alias("key"), F.col(f"m{k}").alias("value")) for k, (c, key, _) in enumerate(found)))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def vector_stats(df: DataFrame, column: str) -> DataFrame:
    """Component-wise count, min, max, sum and mean of a real vector column."""
    parts = df.select(F.posexplode(column).alias("component", "x"))
    x = F.col("x").cast("double")
    return parts.groupBy("component").agg(F.count("x").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.avg(x).alias("mean"))


def boolean_vector_stats(df: DataFrame, column: str) -> DataFrame:
    """How often each component is true and false."""
    parts = df.select(F.posexplode(column).alias("component", "x"))
    return parts.groupBy("component").agg(F.count_if("x").alias("true"), F.count_if(~F.col("x")).alias("false"))


def complex_vector_stats(df: DataFrame, column: str) -> DataFrame:
    """Component-wise count, sum and mean of a complex vector column, real and imaginary."""
    parts = df.select(F.posexplode(column).alias("component", "x"))
    sums = [g(F.col(f"x.{k}").cast("double")).alias(f"{name}_{k}") for name, g in (("sum", F.sum), ("mean", F.avg)) for k in ("re", "im")]
    return parts.groupBy("component").agg(F.count("x").alias("n"), *sums)
