"""A training corpus from ``documents``: quality rules, line deduplication, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its caller writes that to Parquet and hands the table as
read back to the next stage.  All but the last return the columns they were given.

Null and empty texts fail the quality rules.  Repeated rows are kept or dropped together by the first two stages; the
third keeps one of them, as of all near copies, and tells rows that share an id apart by their texts.  An empty table
gives an empty one.  Columns that are not read pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import jaccard, lines, mixing, packing, quality, scratch

_tables: list[str] = []


def _stage(work):
    """Delete what the stage before has left in the shared folder: its result is written when this one starts."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.delete(spark, _tables)
        _tables.clear()
        with scratch.owned(_tables):
            return work(spark, docs, sf_dir)

    return run


def fresh(docs: DataFrame, n: int) -> list[str]:
    """Names that no column of ``docs`` has."""
    longest = max(map(len, docs.columns))
    return ["_" * (longest + 1 + k) for k in range(n)]


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or that the trees reject go."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), quality.KEEP_AT)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, and documents that consisted of nothing else; ``n_chars`` follows the text."""
    before, gone = fresh(docs, 2)
    left = lines.remove(docs, counts=(before, gone))
    empty = (F.col(gone) > 0) & (F.trim("text") == "")
    n_chars = F.when(F.col(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return left.where(~F.coalesce(empty, F.lit(False))).select(*(n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays (of rows with that id, the one whose text has the smaller hash)."""
    groups = scratch.save(jaccard.join(docs, width=5, percent=80).drop("n_shingles"), "groups")
    first = groups.where("component_id IS NOT NULL").groupBy("component_id").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("x"))
    key, th = fresh(docs, 2)
    stay = first.select(F.col("x.doc_id").alias(key), F.col("x.th").alias(th))
    # a row is named by its id and text; rows that have both in common are copies
    known = docs.where("doc_id IS NOT NULL").withColumns({key: F.col("doc_id"), th: F.xxhash64("text")})
    known = known.join(stay, [key, th], "left_semi").dropDuplicates([key, th]).drop(key, th)
    # rows without an id: those whose component has an id are copies of what stays, of the others one stays per text
    lone = docs.where("doc_id IS NULL").withColumn(th, F.xxhash64("text"))
    bare = groups.where("doc_id IS NULL AND component_id IS NULL").select(F.col("th").alias(th)).distinct()
    return known.select(docs.columns).unionByName(lone.join(bare, th, "left_semi").dropDuplicates([th]).drop(th).select(docs.columns))


@_stage
def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped so that the domains' expected tokens match the target weights."""
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, filled with lexical neighbours."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing_to_weights),
    ("packing", packed),
]

#: The trees, the classifier and the packing have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, "stage")
    return docs
