"""Cross-site boilerplate: lines that stand on many sites are removed, but for one copy.

Everything is DataFrame work inside the JVM.  Each line becomes a pair of 64-bit hashes; per pair the sites are
collected in a HyperLogLog sketch that merges by aggregation, so a line that a third of all rows hold is reduced
before it is shuffled.  A sketch is sure far from the threshold; lines near it get an exact distinct count.  The
removed positions of each document come back as one short array, and the text is put together from the slices between.

A line is compared without spaces, tabs and returns at its ends, and may be of any length.  Blank lines are never
removed.  The first occurrence (smallest doc_id, then position) of a removed line stays; of rows that share an id and
differ, the one whose text has the smaller hash comes first.  Null sources count as one site, the same as the empty
one; null texts stay null and have no lines; a null doc_id is an id like others, before all; repeated rows lose the same
lines; an empty table gives no rows.  Other columns pass through, whatever their names, but those named in ``counts``,
which give way to the operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import scratch

#: A sketch with 2**12 registers is off by 1.6 % (one deviation); six deviations and one count more are "near".
LOG_REGISTERS, NEAR = 12, 0.1


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, k (hash of the text), site, pos, a, b: a row per line that can be boilerplate."""
    clean = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    hashed = F.transform(clean, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(hashed).alias("pos", "h"))
    return rows.where(F.col("h").isNotNull()).select("doc_id", "k", "site", "pos", "h.a", "h.b")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """a, b, first (doc_id, k, pos of the copy that stays) of each line on at least ``min_sites`` sites."""
    sketched = lines.groupBy("a", "b").agg(
        F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("doc_id", "k", "pos")).alias("first"),
    ).where(F.col("n") >= min_sites)
    told = sketched.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    told = scratch.save(told.where(F.col("sites") >= min_sites * (1 - NEAR) - 1), "told")
    sure = F.col("sites") > min_sites * (1 + NEAR) + 1
    near = told.where(~sure)
    exact = lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
    enough = exact.groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return told.where(sure).select("a", "b", "first").unionByName(near.join(enough.select("a", "b"), ["a", "b"]).select("a", "b", "first"))


def remove(docs: DataFrame, site: str = "source", min_sites: int = 10, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` cleaned, and under the names ``counts`` the lines that it had and those removed."""
    lines = scratch.save(line_table(docs, site), "lines")
    bad = scratch.save(boilerplate(lines, min_sites), "boilerplate")
    stays = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.k") == F.col("k")) & (F.col("first.pos") == F.col("pos"))
    hits = lines.join(bad, ["a", "b"]).where(~stays)
    cuts = hits.groupBy("doc_id", "k").agg(F.array_sort(F.collect_set("pos")).alias("cut"))
    # the two sides are told apart by struct, so that no column name of the input can clash
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("k")).alias("l")
    joined = left.join(cuts.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.k") == F.col("r.k")), "left").select("row", "cut")
    parts = F.split("row.text", "\n", -1)
    marks = F.concat(F.array(F.lit(-1)), F.col("cut"), F.array(F.size(parts)))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(marks) - 1), lambda i: F.slice(parts, F.element_at(marks, i) + 2, F.element_at(marks, i + 1) - F.element_at(marks, i) - 1)))
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    n_removed = F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.size("cut")).cast("long")
    own = [c for c in docs.columns if c.lower() not in {x.lower() for x in counts}]
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own), n_lines.alias(counts[0]), n_removed.alias(counts[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = """
WITH parts AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS p FROM documents),
l AS (SELECT doc_id, source, unnest(p) AS raw, unnest(range(len(p))) AS pos FROM parts),
c AS (SELECT doc_id, coalesce(source, '') AS source, raw, pos, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
spread AS (SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM c WHERE line <> ''
           GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT c.doc_id, c.pos, c.raw, s.line IS NOT NULL AND NOT (s.first.d = c.doc_id AND s.first.p = c.pos) AS cut
      FROM c LEFT JOIN spread s ON c.line = s.line),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed,
             coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text FROM m GROUP BY doc_id)
SELECT p.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed,
       CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(t.text, p.text) END AS text FROM parts p LEFT JOIN t ON p.doc_id = t.doc_id
"""
