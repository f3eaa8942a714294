"""Mixing sources to target weights with soft domain membership.

A softmax classifier, trained on a bounded sample of the labelled table, gives every document its domain posteriors.
Document rates r >= 0 are then fitted by projected-gradient least squares: the expected domain token totals
S_k(r) = sum_d r_d n_d p_dk are to match the targets T_k.  The gradient at a document is its posterior vector times the
residual, so a document's rate after t steps follows from its posteriors and the t step vectors alone: each step is
one pass over the table of posteriors that adds up k + k*k numbers per task and tried length, and nothing is shuffled or
joined.  Steps are scaled by the inverse of the active documents' second-moment matrix, or not, and their length is
searched, whichever comes nearest to the targets.  A rate's whole part is the number of copies, its
fraction the chance (by a hash of the id) of one more.

Tokens are the ids that packing counts (its tokeniser, without the end id); the classifier's features are their damped
counts, hashed.  Domains come from ``labels``: toxic if toxic = 1, else good or poor by quality.  Unlabelled rows (null
quality) are not trained on; with no usable labels all posteriors are equal.  Null or empty texts have no tokens, and their rate is
the fitted function of their posteriors like any other's.  Repeated rows get the same rate, and so do rows with one id
and equal texts; an empty table gives no rows.  Other columns pass through, whatever their names.  A target whose domain has no
tokens cannot be met; the fit then gets as near as it can, and warns with the part that is missing.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import scratch, tokens
from vecloom.llm.text import mix as scramble
from vecloom.llm.text import rows

DOMAINS = ["good", "poor", "toxic"]
DIM = 4096


#: The feature of each token id.
PLACE = (scramble(np.arange(tokens.VOCABULARY, dtype=np.uint64)) % np.uint64(DIM)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Softmax weights (DIM + 1, domains) and the factor of each feature."""

    weights: np.ndarray
    scale: np.ndarray


def counts(text: str | None) -> tuple[np.ndarray, int]:
    """Damped counts of hashed token ids, and the number of ids."""
    ids = tokens.ids(text)
    return np.log1p(np.bincount(PLACE[ids], minlength=DIM)), len(ids)


def features(found: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows of unit vectors of scaled counts; the last entry is 1."""
    x = np.ones((len(found), DIM + 1))
    x[:, :DIM] = found * scale
    x[:, :DIM] /= np.maximum(1e-12, np.sqrt((x[:, :DIM] ** 2).sum(axis=1, keepdims=True)))
    return x


def classifier(docs: DataFrame, labels: DataFrame, most: int = 4000, steps: int = 300) -> Model:
    """Fitted on at most ``most`` labelled documents; a feature's factor is the log of its rarity among them."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    picked = scratch.fewest(usable.groupBy("doc_id").agg(F.max(domain).alias("domain")), "doc_id", most)
    # both sides of these joins are bounded by `most` rows
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batches):
        for ids, texts, kinds in rows(batches, "doc_id", "text", "domain"):
            found = [counts(t)[0].astype("<f4") for t in texts]
            at = [np.flatnonzero(x).astype("<u2") for x in found]
            packed = ([a.tobytes() for a in at], [x[a].tobytes() for x, a in zip(found, at, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.binary()) for x in packed), pa.array(kinds, pa.int32())], ["doc_id", "at", "x", "domain"])

    table = got.mapInArrow(run, "doc_id long, at binary, x binary, domain int").toPandas().sort_values(["doc_id", "at", "x"]).drop_duplicates("doc_id")
    w, scale = np.zeros((DIM + 1, len(DOMAINS))), np.ones(DIM)
    if len(table):
        found = np.zeros((len(table), DIM))
        for k, (at, x) in enumerate(zip(table["at"], table["x"], strict=True)):
            found[k, np.frombuffer(at, "<u2")] = np.frombuffer(x, "<f4")
        scale = np.log((len(table) + 1) / ((found > 0).sum(axis=0) + 1))
        x, y = features(found, scale), np.eye(len(DOMAINS))[table["domain"]]
        speed = np.zeros_like(w)
        for _ in range(steps):  # gradient descent with momentum on the ridge-penalised log-loss
            p = np.exp((z := x @ w) - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            speed = 0.9 * speed - 4.0 * (x.T @ (p - y) / len(x) + 1e-5 * w)
            w = w + speed
    return Model(w, scale)


def shares(texts: list[str | None], model: Model) -> tuple[np.ndarray, list[int]]:
    """Posteriors and number of tokens of each text."""
    z, sizes = np.zeros((len(texts), len(DOMAINS))) + model.weights[DIM], []
    for k, text in enumerate(texts):  # as ``features``, for the features that the text has
        found, n = counts(text)
        at = np.flatnonzero(found)
        x = found[at] * model.scale[at]
        z[k] += x @ model.weights[at] / max(1e-12, float(np.sqrt(x @ x)))
        sizes.append(n)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), sizes


def posteriors(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """The ``carry`` columns, tokens and p, an array with a probability per domain."""
    kept = docs.select(*carry, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.select(*carry).dtypes) + ", tokens long, p array<double>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p, n = shares(part.column(part.num_columns - 1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], [*carry, "tokens", "p"])

    return kept.mapInArrow(run, schema)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Each row's rate after the given steps, starting from 1."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0, r - p @ step)
    return r


def totals(table: DataFrame, steps: list[np.ndarray], tries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """After ``steps`` and each of ``tries``: the expected tokens of each domain, and the second moments of the active rows."""
    k, t = len(tries[0]), len(tries)

    def run(batches):
        s, m = np.zeros((t, k)), np.zeros((t, k, k))
        for batch in batches:
            n = np.asarray(batch.column(0), float)
            p = np.asarray(batch.column(1).flatten(), float).reshape(-1, k)
            before = rates(p, steps)
            for j, step in enumerate(tries):
                moved = p @ step
                r = np.maximum(0, before - moved)
                s[j] += (r * n) @ p
                active = n * ((r > 0) | (moved < 0))
                m[j] += (p * active[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()]), pa.array([m.ravel().tolist()])], ["s", "m"])

    sums = table.select("tokens", "p").mapInArrow(run, "s array<double>, m array<double>")
    row = sums.agg(*(F.sum(F.col("s")[i]) for i in range(t * k)), *(F.sum(F.col("m")[i]) for i in range(t * k * k))).first()
    row = np.array([x or 0.0 for x in row])
    return row[: t * k].reshape(t, k), row[t * k :].reshape(t, k, k)


#: Lengths that are tried of each step, all in one pass.
LENGTHS = [2.0**-j for j in range(0, 14, 2)] + [0.5]


def fit(table: DataFrame, weights: list[float], anchor: int = 0, grow: float = 1.0, passes: int = 25, close: float = 1e-6) -> list[np.ndarray]:
    """The steps that bring the domain totals to ``weights``; their sum is set so that ``anchor`` keeps ``grow`` times its tokens.

    Of each step the length that leaves the least squared distance to the targets is taken, so the distance never grows.
    """
    k, steps = len(weights), []
    share = np.array(weights, float) / sum(weights)
    found, moments = totals(table, steps, [np.zeros(k)])
    now, moment = found[0], moments[0]
    target = share * (grow * now[anchor] / share[anchor])
    missing = lambda s: np.abs(s - target).max() / max(1.0, target.sum())
    for _ in range(passes):
        if missing(now) <= close:
            break
        ridge = 1e-9 * max(np.trace(moment), 1e-9)
        newton = np.linalg.solve(moment + ridge * np.eye(k), now - target)
        plain = (now - target) / max(np.trace(moment), 1e-9)
        tries = [x * step for step in (newton, plain) for x in LENGTHS]
        found, moments = totals(table, steps, tries)
        best = int(((found - target) ** 2).sum(axis=1).argmin())
        if ((found[best] - target) ** 2).sum() > 0.99 * ((now - target) ** 2).sum():
            break  # as near as it gets
        steps.append(tries[best])
        now, moment = found[best], moments[best]
    if missing(now) > close:
        warnings.warn(f"after {len(steps)} steps the domain totals miss their targets by up to {missing(now):.2g} of all tokens", stacklevel=2)
    return steps


def mix(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = (0.9, 0.08, 0.02), grow: float = 1.05) -> DataFrame:
    """doc_id, tokens, the posteriors, rate and copies of every row of ``docs``."""
    table = scratch.save(posteriors(docs, classifier(docs, labels), "doc_id"), "posteriors")
    steps = fit(table, list(weights), grow=grow)
    return rated(table, steps)


def chance(key: Column) -> Column:
    """A number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 32)) / float(1 << 32)


def rated(table: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    @F.pandas_udf("double")
    def rate(p):
        return __import__("pandas").Series(np.round(rates(np.array(p.tolist(), float).reshape(len(p), -1), steps), 6))

    more = (chance(F.col("doc_id")) < F.col("rate") - F.floor("rate")).cast("long")
    return table.withColumn("rate", rate("p")).withColumn("copies", (F.floor("rate") + more).cast("long"))


def resampled(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = (0.9, 0.08, 0.02), grow: float = 1.05) -> DataFrame:
    """``docs`` with each row as often as its copies say; the text is scored again rather than shuffled."""
    model = classifier(docs, labels)
    table = scratch.save(posteriors(docs, model, "doc_id"), "posteriors")
    steps = fit(table, list(weights), grow=grow)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                p, _ = shares(part.column(at).to_pylist(), model)
                rate = np.round(rates(p, steps), 6)
                copies = np.floor(rate) + (np.asarray(part.column(part.num_columns - 1)) < rate - np.floor(rate))
                again = np.repeat(np.arange(part.num_rows), copies.astype(np.int64))
                for k in range(0, len(again), 32):
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(again[k : k + 32])) for c in part.columns[:-1]], columns)

    last = "_" * (max(map(len, columns)) + 1)  # a name that no column has
    return docs.select("*", chance(F.col("doc_id")).alias(last)).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", "tokens", *(F.round(F.col("p")[k], 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "copies")
