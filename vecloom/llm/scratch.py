"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster; only where it is unset and the master is local (tests, a
laptop) is a temporary one made.  Tables are Parquet, so that losing an executor never loses an intermediate result.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources.shared import shared_dir

#: Paths of the tables written since ``owned`` was last entered in this thread.
_owned: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owned", default=None)


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _owned.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fewest(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``key`` (unique in ``df``); few more than those reach the one task that picks."""
    share = min(1.0, 4 * most / max(1, df.count()))
    h = F.pmod(F.xxhash64(key), F.lit(1 << 32))
    return df.where(h < int(share * (1 << 32))).orderBy(h, key).limit(most)


def delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def owned(paths: list[str]) -> Iterator[None]:
    """Tables saved inside are added to ``paths``, so that the caller can delete them when they are used up."""
    before = _owned.set(paths)
    try:
        yield
    finally:
        _owned.reset(before)
