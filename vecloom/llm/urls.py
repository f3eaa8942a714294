"""URL filters as a sort-merge range join.

The host is turned round (``www.example.com`` -> ``com.example.www.``), so that a host rule is the interval
``[com.example., com.example/)`` of keys ('/' follows '.' in byte order) and the rules of one host nest in those of
its parents.  URLs are dealt to key ranges cut at the quantiles of a sample of about ``sample`` keys, which are shortened
to 200 characters (cuts need not be keys); a rule is copied to the ranges that its interval meets; each range is sorted and swept once with a stack of the open rule hosts.  The path is part
of the key, so one hot host spreads over many ranges, and sorting spills.

``judge`` defines: host = what stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path = from
there up to ``? #`` or the end; a null url or one without ``://`` has neither.  The fitting rule with the longest
host + path wins, then the one with the longer host, then block before allow.  Repeated rows are judged each on its own;
an empty rule table gives everything the default; a rule with an empty host fits every host, so it goes to all ranges;
rules with null host or path are ignored, a null verdict is "block".
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict): the fixed rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def reversed_key(host: Column) -> Column:
    """``a.b.c`` -> ``c.b.a.``; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Sweep:
    """State of one range: the stack of open rule hosts and, for each, its path rules by length."""

    def __init__(self, default: str):
        self.default, self.stack, self.cache = default, [], (None, None, None)

    def rule(self, key: str, path: str, text: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        paths, was = self.stack[-1][1], None
        was = paths.get(path)
        if was is None or was[1] == "allow" and verdict == "block":
            paths[path] = (text, verdict)
        self.cache = (None, None, None)

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def url(self, key: str, path: str) -> tuple[str | None, str]:
        if self.cache[:2] == (key, path):
            return self.cache[2]
        self.close(key)
        best = (-1, -1, None, self.default)
        for host, paths in self.stack:
            for size in sorted({*map(len, paths)}, reverse=True):
                if size <= len(path) and (hit := paths.get(path[:size])):
                    best = max(best, (len(host) - 1 + size, len(host), *hit), key=lambda x: x[:2])
                    break  # a longer path of the same host is longer
        self.cache = (key, path, best[2:])
        return best[2:]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None, sample: int = 10_000) -> DataFrame:
    """page_id, host, path, rule, verdict for every row. ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).na.fill("", ["host", "path"])
    # '\x00' sorts before '.', so a host's own urls come after its rules and before those of its subdomains
    full = F.concat(reversed_key(F.col("host")), F.lit("\x00"), F.col("path"), F.lit("\x00"), F.hex(F.xxhash64("page_id")))
    urls = urls.withColumn("key", full)
    # the cuts decide where a url is judged, not how, so any sample will do; about `sample` keys reach the driver
    picked = urls.sample(min(1.0, sample / max(1, pages.count())), seed=3).select(F.substring("key", 1, 200).alias("key"))
    keys = sorted(r.key for r in picked.collect())
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    @F.pandas_udf("int")
    def bucket(key):
        import numpy as np

        return __import__("pandas").Series(np.searchsorted(np.array(cuts, object), key.to_numpy(object), side="right").astype("int32")) if cuts else key.map(lambda _: 0).astype("int32")

    ruled = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", F.coalesce("verdict", F.lit("block")).alias("verdict"))
        .select(reversed_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("text"), "verdict")
        .withColumn("first", bucket("key"))
        .withColumn("last", F.when(F.col("key") == "", F.lit(len(cuts))).otherwise(bucket(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")))))
        .withColumn("bucket", F.explode(F.sequence("first", "last")))
    )
    nothing = F.lit(None).cast("string")
    both = ruled.select("bucket", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), nothing.alias("host"), "path", "text", "verdict").unionByName(
        urls.select(bucket("key").alias("bucket"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", nothing.alias("text"), nothing.alias("verdict"))
    )

    def run(batches):
        sweep, at = Sweep(default), None
        for batch in batches:
            out = ([], [], [], [], [])
            for b, key, kind, page, host, path, text, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at:
                    sweep, at = Sweep(default), b
                if kind == 0:
                    sweep.rule(key, path, text, verdict)
                else:
                    for column, value in zip(out, (page, host, path, *sweep.url(key.partition("\x00")[0], path)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], ["page_id", "host", "path", "rule", "verdict"])

    return (
        both.repartitionByRange(ranges, "bucket")
        .sortWithinPartitions("bucket", "key", "kind", "path", "page_id")
        .mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
      FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rverdict, 'allow') AS verdict FROM j WHERE k = 1
"""
