"""Lexical retrieval packing.

Documents become token ids (with an end id) once, in a table in the shared folder.  They are dealt to shards of about
``shard_tokens`` tokens by content: a tree of centroids (two levels of ``BRANCHES``, fitted on about ``sample`` documents)
gives each document a leaf; a branch that fits into a shard is one, else its leaves are gathered into shards, and a leaf that is
more than a shard is split by a sketch (the smallest hash of a document's ``SHINGLE``-id windows), so near copies meet
with a chance of about their similarity.  A sketch whose documents are more than a shard is split by a hash.  A shard holds a BM25 inverted index over its documents, with document frequencies counted over the whole corpus (the terms
are token ids, so these are one bounded vector) and the Robertson-Sparck Jones weight, which is 0 for ids in half of all
documents or more.  From a seed document the index returns the unused documents that are nearest;
they fill the seed's window greedily.  A document that does not fit is cut, and its rest is the next seed.  So every
sequence is full; what is left of a shard is cut into sequences whose lengths are powers of two, which need no padding.

A seed asks its own shard only: asking all would cost the square of the corpus (the README has the share of nearest
documents that a shard holds).  Null texts are empty: one end id.  Repeated rows, also of one doc_id, are packed each on its
own; rows without an id keep their null.  A text may be of any length.  An empty table gives no rows; other columns are
not read.  Rows come with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import scratch, tokens
from vecloom.llm.text import M1, M3, mix, rows
from vecloom.llm.tokens import END, VOCABULARY

K1, B = 1.2, 0.75
BRANCHES, SHINGLE, DIM = 16, 8, 1024


#: The dimension of each token id in document vectors.
PLACE = (mix(np.arange(VOCABULARY, dtype=np.uint64)) % np.uint64(DIM)).astype(np.int64)


def counts(ids: np.ndarray) -> np.ndarray:
    return np.log1p(np.bincount(PLACE[ids], minlength=DIM)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors; always ``k`` rows."""
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), k, replace=len(x) < k)] if len(x) else np.zeros((k, DIM), np.float32)
    for _ in range(rounds if len(x) else 0):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(k)], np.float32))
    return c


@dataclass(frozen=True)
class Tree:
    """Factor of each dimension, centroids of the branches, and of the leaves of each branch."""

    scale: np.ndarray
    branches: np.ndarray
    leaves: np.ndarray

    def leaf(self, found: np.ndarray) -> np.ndarray:
        x = unit(found * self.scale)
        branch = (x @ self.branches.T).argmax(axis=1)
        out = branch * BRANCHES
        for b in np.unique(branch):
            out[branch == b] += (x[branch == b] @ self.leaves[b].T).argmax(axis=1)
        return out


def tree(docs: DataFrame, sample: int = 4000) -> Tree:
    """Fitted on about ``sample`` documents; it says where a document is packed, not whether."""

    def run(batches):
        for (texts,) in rows(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([counts(tokens.ids(t)).tobytes() for t in texts], pa.binary())], ["x"])

    some = docs.select("text").sample(min(1.0, sample / max(1, docs.count())), seed=9).mapInArrow(run, "x binary").toPandas()["x"]
    found = np.array([np.frombuffer(x, np.float32) for x in some]).reshape(-1, DIM)
    scale = np.log((len(found) + 1) / ((found > 0).sum(axis=0) + 1)).astype(np.float32) + np.float32(1e-6)
    x = unit(found * scale)
    branches = centroids(x, BRANCHES)
    near = (x @ branches.T).argmax(axis=1)
    return Tree(scale, branches, np.array([centroids(x[near == j], BRANCHES) for j in range(BRANCHES)]))


def sketches(docs: list[np.ndarray]) -> list[int]:
    """For each document the smallest hash of its windows of ``SHINGLE`` ids (a power of two); a shorter one is one window."""
    size = np.array([len(d) for d in docs])
    start = np.cumsum(size) - size
    h, w = np.concatenate(docs).astype(np.uint64) + M1, 1
    short = [int(np.bitwise_xor.reduce(mix(h[a : a + n] * M3 + np.arange(n, dtype=np.uint64))).view(np.int64)) if n < SHINGLE else 0 for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    long = np.flatnonzero(size >= SHINGLE)
    if not len(long):
        return short
    while w < SHINGLE:  # windows of twice the width from two neighbours
        h = h[:-w] * M3 + h[w:]
        h ^= h >> np.uint64(29)
        w *= 2
    # of the windows that begin at each place, those that end in the same document
    h = np.append(mix(h), np.zeros(1, np.uint64))
    ends = np.column_stack([start[long], start[long] + size[long] - SHINGLE + 1]).ravel()
    least = np.minimum.reduceat(h, ends)[::2].view(np.int64)
    for k, x in zip(long.tolist(), least.tolist(), strict=True):
        short[k] = x
    return short


def tokenised(docs: DataFrame, model: Tree) -> DataFrame:
    """doc_id, n (ids with the end id), ids (little-endian 16-bit), leaf, sketch."""

    def run(batches):
        end = np.array([END], "<u2")
        for doc_ids, texts in rows(batches, "doc_id", "text", slice_rows=128):
            ids = [np.concatenate([tokens.ids(t), end]) for t in texts]
            leaf = model.leaf(np.array([counts(x) for x in ids]).reshape(-1, DIM))
            longs = [doc_ids, [len(x) for x in ids], sketches(ids)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(leaf.astype(np.int32))], ["doc_id", "n", "sketch", "ids", "leaf"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sketch long, ids binary, leaf int")


def holders(docs: list[np.ndarray]) -> np.ndarray:
    """How many of these documents (at most 2**16) hold each id."""
    key = np.sort(np.concatenate([d.astype(np.uint32) | np.uint32(j << 16) for j, d in enumerate(docs)]))
    return np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] & np.uint32(0xFFFF), minlength=VOCABULARY)


def frequencies(table: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents that hold each id, the number of documents and their mean length, over the whole corpus."""

    def run(batches):
        df = np.zeros(VOCABULARY, np.int64)
        for (raw,) in rows(batches, "ids", slice_rows=64):
            df += holders([np.frombuffer(x, "<u2") for x in raw])
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(df[t])], ["t", "df"])

    got = table.select("ids").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toPandas()  # at most one row per id of the vocabulary
    df = np.zeros(VOCABULARY)
    df[got["t"]] = got["df"]
    n, mean = table.agg(F.count(F.lit(1)), F.avg("n")).first()
    return df, n, float(mean or 1)


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(d) for d in docs], np.int64)
        wide = np.uint32 if len(docs) < 1 << 16 else np.uint64  # numbers as short as they may be sort faster
        key = np.sort(np.concatenate([d.astype(wide) | (wide(i) << wide(16)) for i, d in enumerate(docs)]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(first, len(key)))
        term, doc = (key[first] & wide(0xFFFF)).astype(np.int64), (key[first] >> wide(16)).astype(np.int64)
        said = idf[term] > 0
        term, doc, tf = term[said], doc[said], tf[said]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        self.start = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.term = term
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.doc, self.posted = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.n, self.gone = len(docs), 0

    def forget(self, used: np.ndarray) -> None:
        """Leave the postings of used documents out from now on."""
        alive = ~used[self.doc]
        self.at = np.concatenate([[0], np.cumsum(alive)])[self.at]
        self.doc, self.posted, self.gone = self.doc[alive], self.posted[alive], int(used.sum())

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document that is not forgotten for the distinct ids of ``seed``."""
        own = self.term[self.start[seed] : self.start[seed + 1]]
        first, n = self.at[own], self.at[own + 1] - self.at[own]
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        return np.bincount(self.doc[at], self.posted[at], self.n)

    def nearest(self, seed: int, used: np.ndarray, first: int = 32):
        """Unused documents, best score first (ties: earlier document), in growing portions."""
        if 4 * (int(used.sum()) - self.gone) > self.n - self.gone:
            self.forget(used)
        score = self.scores(seed)
        score[used] = -1
        while True:
            some = np.argpartition(-score, first)[:first] if first < self.n else np.arange(self.n)
            some = some[np.lexsort((some, -score[some]))]
            for d in some:
                if score[d] < 0:
                    return
                yield int(d)
            if first >= self.n:
                return
            score[some] = -1
            first *= 4


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    index, used, out = Index(docs, idf, mean), np.zeros(len(docs), bool), []
    size = [len(d) for d in docs]
    sequence, next_seed, rest = 0, 0, None
    while True:
        if rest is None:
            while next_seed < len(docs) and used[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return out
            rest, used[next_seed] = (next_seed, 0), True
        seed, start = rest
        filled, pieces, rest = 0, [], None
        found = None
        at = (seed, start)
        while at is not None and filled < window:
            doc, start = at
            take = min(window - filled, size[doc] - start)
            pieces.append((doc, start, take, filled))
            filled += take
            if start + take < size[doc]:
                rest, at = (doc, start + take), None
            elif filled < window:
                found = found or index.nearest(seed, used)
                nearest = next(found, None)
                at = None
                if nearest is not None:
                    used[nearest], at = True, (nearest, 0)
        if filled == window:
            out.extend((d, s, n, sequence, o) for d, s, n, o in pieces)
            sequence += 1
            continue
        # the shard's last tokens: sequences of falling powers of two
        base, left = 0, filled
        while left:
            part = 1 << (left.bit_length() - 1)
            for d, s, n, o in pieces:
                a, b = max(o, base), min(o + n, base + part)
                if a < b:
                    out.append((d, s + a - o, b - a, sequence, a - base))
            base, left, sequence = base + part, left - part, sequence + 1


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def places(totals: dict[int, int], shard_tokens: int) -> tuple[list[int], list[int]]:
    """For each leaf its group, and the number of shards of that group."""
    group, parts, at = [0] * BRANCHES**2, [1] * BRANCHES**2, 0
    for branch in range(BRANCHES):
        leaves, held = range(branch * BRANCHES, (branch + 1) * BRANCHES), 0
        at += 1
        for leaf in leaves:
            n = totals.get(leaf, 0)
            if held and held + n > shard_tokens:
                at, held = at + 1, 0
            group[leaf], parts[leaf] = at, max(1, -(-n // shard_tokens))
            held += n
    return group, parts


def dealt(table: DataFrame, shard_tokens: int, broadcast_rows: int = 200_000) -> DataFrame:
    """``table`` with g, p, s, which together name a document's shard."""
    totals = {r["leaf"]: r["t"] for r in table.groupBy("leaf").agg(F.sum("n").alias("t")).collect()}  # at most BRANCHES**2 rows
    group, parts = (F.element_at(F.array(*map(F.lit, x)), F.col("leaf") + 1) for x in places(totals, shard_tokens))
    sums = table.groupBy("leaf", "sketch").agg(F.sum("n").alias("t"))
    large = scratch.save(sums.where(F.col("t") > shard_tokens).select("leaf", "sketch", F.ceil(F.col("t") / shard_tokens).alias("pieces")), "large")
    small = large.count() <= broadcast_rows
    table = table.join(F.broadcast(large) if small else large, ["leaf", "sketch"], "left")
    whole = F.col("pieces").isNull()
    part = F.when(whole, F.pmod(F.xxhash64("sketch"), parts)).otherwise(F.col("sketch"))
    piece = F.when(whole, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "n"), F.col("pieces")))
    return table.withColumns({"g": group, "p": part.cast("long"), "s": piece.cast("long")})


def pack(docs: DataFrame, window: int = 2048, shard_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` ids."""
    table = scratch.save(tokenised(docs, tree(docs)), "tokens")
    df, n, mean = frequencies(table)
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))

    def packed(held, base):
        ids = [np.frombuffer(x, "<u2") for x in held[1]]
        got = pack_shard(ids, idf, mean, window)
        crc = [zlib.crc32(ids[d][s : s + k].astype("<u4").tobytes()) for d, s, k, _, _ in got]
        columns = [[held[0][x[0]] for x in got], [x[1] for x in got], [x[2] for x in got], crc, [len(ids[x[0]]) for x in got], [base + x[3] for x in got], [x[4] for x in got]]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return batch, base + (got[-1][3] + 1 if got else 0)

    def run(batches):
        """Rows come sorted by shard; sequences are numbered within the task, which holds one shard at a time."""
        held, at, base = ([], []), None, TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = list(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True))
            for key, doc_id, raw in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != at and held[0]:
                    out, base = packed(held, base)
                    yield out
                    held = ([], [])
                at = key
                held[0].append(doc_id)
                held[1].append(raw)
        if held[0]:
            yield packed(held, base)[0]

    shards = dealt(table, shard_tokens).select("g", "p", "s", "doc_id", "ids", "n", "sketch")
    return shards.repartition("g", "p", "s").sortWithinPartitions("g", "p", "s", "doc_id", "n", "sketch").select("g", "p", "s", "doc_id", "ids").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
