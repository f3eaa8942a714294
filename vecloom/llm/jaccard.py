"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, as 64-bit hashes.  Documents with equal sets form a class, and
only the class's smallest id goes on.  Let linked sets of sizes a <= b differ in d elements.  Jaccard >= t gives
d <= (a + b)(1 - t) / (1 + t).  For a band of sizes this is at most D.  Each element flips one bit of a sketch of
W = 2 (D + 1) words (a word is 2**32 bits wide and is kept as the XOR of its set bits' codes).  The Hamming distance of
two such parity sketches is at most d, so at most D words differ and at least D + 2 agree: the join is an equi-join on
(band, word number, word).  Words with few elements, or few but those that a sample of the documents shows to be
common, agree without meaning.  So words are ordered by their rare elements, and a set that differs from what links to
it in at most d <= D elements keeps its d + 1 first words: of the words that two linked sets share, the first in that
order has all the other shared ones behind it, and they are all but d at least, so both keep it.  A set near the lower
end of its band is in the band below, too, where it only meets smaller ones.

Pairs that meet are linked to the first row of their bucket only, which keeps a bucket of m documents to m rows;
buckets that a sample shows to be large are aggregated before the shuffle and never gathered.  The other keys are
shuffled once, sorted and read in a stream.  Keys go with the numbers of rows, which only the few that meet change for
those of classes; of rows with equal sets that a task sees, the first alone has keys.  The
components of these candidate links hold every linked pair, since documents of one bucket are in one component.  Each
component is then verified exactly: an inverted list gives the intersections of one set with all others at once, and
pairs already connected are skipped.  In a component of more than ``chunk`` classes every set is first compared with
one of them by a join; those that link to it are one cluster, so only pairs with a set outside it are left, which are
dealt as pairs of chunks, so that no task holds more than two chunks.  The links found are joined into the final components.

A text is lower-cased in A-Z; words are runs of bytes other than 0x20 and 0x09-0x0D.  A text with fewer words than the
width is one shingle; null and empty texts have none and are alone.  Rows that repeat a doc_id are told apart by their
texts, and each gets the component of its own text; a null doc_id links like others but never names a component that
has another id.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import scratch
from vecloom.llm.text import WordHashes, mix, rows, shingles

RATIO = 2


def sets(texts: list[str | None], hashes: WordHashes, width: int) -> list[np.ndarray]:
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        out.append(shingles(hashes.of(words), width) if words else np.zeros(0, np.uint64))
    return out


def band_of(n: int) -> int:
    return int(math.floor(math.log(n) / math.log(RATIO) + 1e-9))


def words_in(n: int, band: int, percent: int) -> tuple[int, int]:
    """(number of sketch words, how many of them a set of ``n`` is joined on) for pairs whose smaller set is in ``band``."""
    a = math.floor(RATIO ** (band + 1)) + 1
    differ = [(x + y) * (100 - percent) // (100 + percent) for x, y in ((a, a * 100 // percent + 1), (n, n * 100 // percent if band == band_of(n) else min(n, a)))]
    return 2 * (differ[0] + 1), min(differ) + 1


def sampled(docs: DataFrame, most: int) -> DataFrame:
    """The texts of about ``most`` rows."""
    return docs.select("text").sample(min(1.0, most / max(1, docs.count())), seed=5)


def frequent(values: DataFrame, least: int, most: int) -> np.ndarray:
    """Sorted values of x that stand in at least ``least`` rows, the ``most`` most frequent at most."""
    counted = values.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    got = counted.orderBy(F.desc("n"), "x").limit(most).select("x").toPandas()["x"]
    return np.sort(got.to_numpy(np.int64).view(np.uint64))


def common(docs: DataFrame, width: int, sample: int = 8000, often: int = 3, most: int = 500_000) -> np.ndarray:
    """Sorted shingles that stand in at least ``often`` of about ``sample`` documents, ``most`` at most.

    They only say which sketch words are worth joining on; the result does not depend on them.
    """

    def run(batches):
        hashes = WordHashes()
        for (texts,) in rows(batches, "text", slice_rows=256):
            found = sets(texts, hashes, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["x"])

    return frequent(sampled(docs, sample).mapInArrow(run, "x long"), often, most)


def hot_keys(docs: DataFrame, width: int, percent: int, often: np.ndarray, sample: int = 8000, least: int = 20, most: int = 20_000) -> np.ndarray:
    """Sorted join keys of at least ``least`` of about ``sample`` documents, ``most`` at most.

    They only say which keys are aggregated before the shuffle; the result does not depend on them.
    """

    def run(batches):
        hashes = WordHashes()
        for (texts,) in rows(batches, "text", slice_rows=256):
            found = [keys_of(s, percent, often) for s in sets(texts, hashes, width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["x"])

    return frequent(sampled(docs, sample).mapInArrow(run, "x long"), least, most)


def keys_of(items: np.ndarray, percent: int, often: np.ndarray) -> np.ndarray:
    """The join keys of a set: a hash of (band, word number, word) for each joinable word of its one or two bands."""
    n, out = len(items), []
    band = band_of(n)
    h = mix(items ^ np.uint64(0xD6E8FEB86659FD93))
    rare = np.ones(n, bool)
    if len(often):
        rare = often[np.minimum(np.searchsorted(often, items), len(often) - 1)] != items
    code = mix(h)  # stands for the one bit of 2**32 that the element flips in its word
    for b in (band, band - 1):
        if b == band or b >= 0 and n * percent <= 100 * (math.floor(RATIO ** (b + 1)) + 1):
            total, joined = words_in(n, b, percent)
            at = ((h >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
            word = np.zeros(total, np.uint64)
            np.bitwise_xor.at(word, at, code)
            key = mix(word ^ mix(np.arange(total, dtype=np.uint64) + np.uint64((b + 1) << 32)))
            # an order of words that depends on nothing but the word: rare elements, elements, hash
            best = np.lexsort((key, np.bincount(at, minlength=total), np.bincount(at[rare], minlength=total)))
            out.append(key[best[-joined:]])
    return np.concatenate(out)


def measured(docs: DataFrame, width: int, percent: int, often: np.ndarray, hot: np.ndarray, most: int = 400_000) -> DataFrame:
    """row, doc_id, th (hash of the text), n_shingles, fp (128-bit hash of the set), keyed, hot keys and other keys of every row.

    Only keyed rows have keys: not those whose set the task has had (it remembers ``most``).
    """

    def run(batches):
        hashes, had = WordHashes(), set()

        def new(digest: bytes | None) -> bool:
            if digest is None or digest in had:
                return False
            if len(had) >= most:
                had.clear()
            had.add(digest)
            return True

        for numbers, ids, ths, texts in rows(batches, "row", "doc_id", "th", "text", slice_rows=256):
            found = sets(texts, hashes, width)
            fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            keyed = [new(x) for x in fp]
            keys = [keys_of(s, percent, often) if k else np.zeros(0, np.uint64) for s, k in zip(found, keyed, strict=True)]
            warm = [hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k if len(hot) else np.zeros(len(k), bool) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x, pa.int64()) for x in (numbers, ids, ths, [len(s) for s in found])), pa.array(fp, pa.binary()), pa.array(keyed, pa.bool_()),
                    *(pa.array([k[w == x].view(np.int64) for k, w in zip(keys, warm, strict=True)], pa.list_(pa.int64())) for x in (True, False)),
                ],
                ["row", "doc_id", "th", "n_shingles", "fp", "keyed", "hot", "keys"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("th"), "text")
    return numbered.mapInArrow(run, "row long, doc_id long, th long, n_shingles long, fp binary, keyed boolean, hot array<long>, keys array<long>")


def met(keyed: DataFrame) -> DataFrame:
    """a, b: each row but one of those that share a key, and that one."""

    def run(batches):
        """Rows come sorted by key; the last key goes on in the next batch."""
        last, first = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, row = (np.concatenate([x, batch.column(j).to_numpy()]) for j, x in enumerate((last, first)))
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            head = np.repeat(row[starts], np.diff(np.append(starts, len(key))))
            last, first = key[-1:], head[-1:]
            meets = row != head
            yield pa.RecordBatch.from_arrays([pa.array(row[meets]), pa.array(head[meets])], ["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, root (smallest id of the component) of every id in ``edges`` (a, b)."""
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    # what is joined to the edges is dealt out once more, so both sides of the joins are plain exchanges, of which adaptive
    # execution splits the edges of a large component's root
    again = F.xxhash64("a")
    for _ in range(most):
        # every vertex links to its smallest neighbour, and its larger neighbours to that one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition(again)
        large = edges.select(F.col("b").alias("v"), F.col("a").alias("u")).join(low.withColumnRenamed("a", "v"), "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        # the smaller neighbours of a vertex link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).repartition(again)
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = scratch.save(small.distinct(), "edges")
        # done when no vertex is both a member and a root
        if new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").limit(1).count() == 0 and new.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            return new.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        edges = new
    raise RuntimeError("the components did not settle")


def verify(ids: list[int], found: list[np.ndarray], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join every linked pair's component. ``sides``: if given, only pairs of different sides are looked at."""
    m = len(ids)
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([len(s) for s in found], np.int64)
    item = np.unique(np.concatenate(found), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(item.max()) + 1, np.int32)
    out = []
    for i in range(m - 1):
        roots = np.array([root(j) for j in range(i + 1, m)])
        may = (roots != root(i)) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
        if sides is not None:
            may &= np.array(sides[i + 1 :]) != sides[i]
        if not may.any():
            continue
        own = item[at[i] : at[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[item[at[i + 1] :]], at[i + 1 : m] - at[i + 1])
        mark[own] = 0
        for j in np.flatnonzero(may & (100 * both >= percent * (size[i] + size[i + 1 :] - both))):
            a, b = root(i), root(i + 1 + int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids[i], ids[i + 1 + int(j)]))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Do two sorted sets link?"""
    both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def join(docs: DataFrame, width: int = 3, percent: int = 90, chunk: int = 512, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_shingles, component_id and th (``xxhash64`` of the text) of every row of ``docs``."""
    often = common(docs, width)
    table = scratch.save(measured(docs, width, percent, often, hot_keys(docs, width, percent, often)), "sets")
    # one row stands for the class of rows with its set; ``n`` rows have its id and text
    same = table.where("fp IS NOT NULL").groupBy("fp", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = same.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th", "n")).alias("x"))
    classes = scratch.save(first.select(F.monotonically_increasing_id().alias("id"), "fp", "x.doc_id", "x.th", "x.n"), "classes")
    pairs = met(table.select(F.explode("keys").alias("key"), "row"))
    # the hot keys are bounded in number (``hot_keys``), so their first rows can be broadcast
    warm = table.select("row", F.explode("hot").alias("key"))
    warm = warm.join(F.broadcast(warm.groupBy("key").agg(F.min("row").alias("first"))), "key").where("row <> first")
    pairs = pairs.unionByName(warm.select(F.col("row").alias("a"), F.col("first").alias("b"))).distinct()
    which = table.where("keyed").select("row", "fp").join(classes.select("fp", "id"), "fp")
    for end in ("a", "b"):
        pairs = pairs.join(which.select(F.col("row").alias(end), F.col("id").alias(f"{end}_id")), end)
    groups = scratch.save(components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))), "candidates")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    placed = groups.join(sizes, "root").join(classes, "id").select("id", "root", "doc_id", "th", "n", (F.col("m") > chunk).alias("large"))
    placed = scratch.save(placed, "placed")
    told = placed.agg(F.count(F.lit(1)), F.max("n"), F.max("large")).first()
    side = F.broadcast(placed) if told[0] <= broadcast_rows else placed
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").alias("l").join(side.alias("r"), (F.col("l.th") == F.col("r.th")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")))
    texts = texts.select("r.id", "r.root", "r.large", "l.text")
    if told[1] and told[1] > 1:  # rows that repeat an id and its text stand for one class
        texts = texts.dropDuplicates(["id"])

    def again(batches):
        hashes = WordHashes()
        for ids, root, large, text in rows(batches, "id", "root", "large", "text", slice_rows=256):
            found = sets(text, hashes, width)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(root, pa.int64()), pa.array(large, pa.bool_()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "root", "large", "items"])

    members = texts.mapInArrow(again, "id long, root long, large boolean, items binary")
    # small groups are one part; ``free`` parts are compared with all parts of their group, the rest with the free ones only
    one = [F.lit(0).alias(c) for c in ("part", "last")]
    dealt, links = members.where("NOT large").select("id", "root", "items", *one), None
    if told[2]:
        members = scratch.save(members, "members")
        large = members.where("large")
        # a group's pivot is its root; both sides are plain exchanges, so adaptive execution can split a large group
        both = large.join(large.where("id = root").select("root", F.col("items").alias("pivot")), "root")

        def star(batches):
            for ids, root, items, pivot in rows(batches, "id", "root", "items", "pivot", slice_rows=256):
                linked = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(items, pivot, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(root, pa.int64()), pa.array(linked, pa.bool_())], ["id", "root", "linked"])

        stars = scratch.save(both.select("id", "root", "items", "pivot").mapInArrow(star, "id long, root long, linked boolean"), "stars")
        links = stars.where("linked AND id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
        left = stars.groupBy("root").agg(F.count_if(~F.col("linked")).alias("free"), F.count_if("linked").alias("rest")).where("free > 0")
        parts = [F.ceil(F.col(c) / chunk).cast("int") for c in ("free", "rest")]
        h = F.xxhash64("id")
        part = F.when(F.col("linked"), parts[0] + F.pmod(h, F.greatest(parts[1], F.lit(1)))).otherwise(F.pmod(h, parts[0])).cast("int")
        last = F.when(F.col("linked"), parts[0] - 1).otherwise(parts[0] + parts[1] - 1)
        where = stars.join(left, "root").select("id", part.alias("part"), last.alias("last"))
        dealt = members.where("NOT large").select("id", "root", "items", *one).unionByName(large.join(where, "id").select("id", "root", "items", "part", "last"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).select("id", "root", "items", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def check(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending")]).combine_chunks()
        ids, sides = group.column("id").to_pylist(), group.column("part").to_pylist()
        found = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        split = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        got = verify(ids, found, percent, sides if split else None) if len(ids) > 1 else []
        return pa.table([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])

    more = dealt.groupBy("root", "i", "j").applyInArrow(check, "a long, b long")
    linked = scratch.save(components(more if links is None else links.unionByName(more)), "linked")
    # a component is named by its smallest document
    ids = classes.select("id", "doc_id").join(linked, "id")
    names = linked.join(ids.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("id", "component")
    named = classes.select("id", "fp", "doc_id").join(names, "id", "left").select("fp", F.coalesce("component", "doc_id").alias("component"))
    return table.join(named, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "th")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS k FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM e)),
pre AS (SELECT doc_id, n, x FROM f WHERE k <= n - (90 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
i AS (SELECT a, b, count(*) AS i FROM cand JOIN e p ON p.doc_id = a JOIN e q ON q.doc_id = b AND q.x = p.x GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * i >= 90 * (len(p.s) + len(q.s) - i)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(id, root) AS (SELECT a, a FROM g UNION SELECT g.b, t.root FROM t JOIN g ON g.a = t.id AND t.root < g.b) SELECT id, min(root) AS root FROM t GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(r.root, s.doc_id), s.doc_id) AS component_id FROM s LEFT JOIN r ON r.id = s.doc_id
"""
