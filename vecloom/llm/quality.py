"""Quality rules: exact document statistics, fixed base rules, and boosted trees for the rest.

``statistics`` measures whole texts.  ``fit`` trains on a bounded sample of labelled rows (``most`` rows, those
with the smallest hash of their id, so the choice is the same on every run); ``score`` applies the flattened trees
to every document in Arrow batches.  Nothing is shuffled but the labelled sample.

Edge cases: a null text has no words; a document with no words fails the base rules; repeated rows are scored each
on its own; labels that are null or refer to no document are ignored; without usable labels the trees abstain and
the base rules alone decide; other columns of the input pass through unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import gbt, scratch
from vecloom.llm.text import SPACES, rows

SYMBOLS = b"#*$%&|<>"

#: Feature name and the direction in which it may move the score (fixed values).
FEATURES = [
    ("log_words", 0),
    ("mean_word", 0),
    ("symbol_rate", -1),
    ("dup_line_rate", -1),
    ("repeat_rate", -1),
    ("distinct_rate", 1),
    ("function_word_rate", 0),
    ("words_per_line", 0),
    ("digit_rate", 0),
    ("ends_rate", 0),
    ("capital_rate", 0),
]

#: Frequent function words of the four languages of the corpus (fixed values).
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on with as by this be at from or an "
    b"de la que el en y los se del las un por con una su para es al lo no "
    b"le les des et une du dans est pas pour qui au sur ce il elle "
    b"der die und das von zu den mit sich des auf ist im dem nicht ein eine".split()
)


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """Exact counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(FEATURES)
    solid = raw.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = 0
    if n >= 4:
        # word ids are below n, so a window is one exact integer while n**3 fits; else two exact steps
        pair = code[:-1] * len(ids) + code[1:]
        if n >= 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * len(ids) + code[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        often = np.zeros(n, bool)
        hit = np.zeros(n - 2, bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        often[:-2] |= hit
        often[1:-1] |= hit
        often[2:] |= hit
        repeat = int(often.sum())
    function = sum(int(k) for w, k in zip(ids, np.bincount(code, minlength=len(ids)), strict=True) if w.lower() in FUNCTION_WORDS)
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ends = sum(x.rstrip(SPACES)[-1:] in b".!?" for x in lines)
    return [n, chars, symbols, dup, repeat], [
        math.log1p(n), chars / n, symbols / n, dup / len(lines), repeat / n, len(ids) / n,
        function / n, n / len(lines), digits / n, ends / len(lines), capitals / n,
    ]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five exact counts, and the feature vector, for every row of ``docs``."""

    def run(batches):
        for ids, texts in rows(batches, "doc_id", "text"):
            counts, features = zip(*map(measure, texts), strict=True) if texts else ([], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(5)), pa.array(list(features), pa.list_(pa.float64()))],
                ["doc_id", *COUNTS, "features"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, STATS)


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000) -> gbt.Forest:
    """Train on at most ``most`` labelled documents; quality 1 is the class to keep."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    picked = scratch.fewest(usable.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", most)
    # the sample is bounded by `most` rows, so broadcasting it is bounded too
    got = statistics(docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"))
    table = got.join(F.broadcast(picked), "doc_id").select("doc_id", "features", "quality").toPandas()
    table = table.drop_duplicates("doc_id").sort_values("doc_id")
    x = np.array(table["features"].tolist(), float).reshape(-1, len(FEATURES))
    return gbt.train(x, table["quality"].to_numpy(float), [s for _, s in FEATURES])


def score(docs: DataFrame, forest: gbt.Forest, threshold: float = 0.5) -> DataFrame:
    """Every row's counts and the verdict: ``base_failed``, ``score`` (probability of quality) and ``kept``."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"

    def run(batches):
        for ids, texts in rows(batches, "doc_id", "text"):
            measured = [measure(t) for t in texts]
            counts = np.array([c for c, _ in measured], np.int64).reshape(-1, 5)
            prob = 1 / (1 + np.exp(-forest.score(np.array([f for _, f in measured]).reshape(-1, len(FEATURES)))))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(prob), pa.array(~failed & (prob >= threshold))],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep(docs: DataFrame, forest: gbt.Forest, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; text and verdict travel in the same batch."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                measured = [measure(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                counts = np.array([c for c, _ in measured], np.int64).reshape(-1, 5)
                prob = 1 / (1 + np.exp(-forest.score(np.array([f for _, f in measured]).reshape(-1, len(FEATURES)))))
                failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
                yield part.filter(pa.array(~failed & (prob >= threshold)))

    return docs.mapInArrow(run, docs.schema)


#: Kept if the trees give at least this probability; low, so that doubtful documents stay.
KEEP_AT = 0.35


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels), KEEP_AT)
