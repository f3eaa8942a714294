"""Ranked fulltext search: BM25 over postings, all in DataFrame operations.

Tokens come from an analyser: ``standard`` (runs of letters and digits, lower-cased), ``simple`` (runs of letters,
lower-cased), ``whitespace`` (as they stand), ``english`` (standard without stop words and plural endings) or
``soundex`` (standard, by sound; a phonetic code that Spark has stands for the one of the inventory).  A query holds
terms, ``term*`` prefixes, ``+must`` and ``-not``, or AND, OR, NOT.  With an index, a search reads the postings of its
terms; without, it tokenises the table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75

ANALYSERS = ("standard", "simple", "whitespace", "english", "soundex")
#: English stop words (fixed values).
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text: Column, analyser: str = "standard") -> Column:
    analyser = analyser.lower()
    if analyser not in ANALYSERS:
        raise ValueError(f"no analyser {analyser}")
    if analyser == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+" if analyser == "simple" else r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if analyser == "english":
        words = F.filter(words, lambda t: ~t.isin(STOP_WORDS))
        words = F.transform(words, lambda t: F.when(t.rlike("^.{2,}[^su]s$"), F.regexp_replace(t, "s$", "")).otherwise(t))
    return F.transform(words, lambda t: F.soundex(t)) if analyser == "soundex" else words


def parse(query: str, lower: bool = True) -> tuple[list[str], list[str], list[str]]:
    """(optional, required, excluded) lower-case terms; a trailing * makes a prefix."""
    out: dict[str, list[str]] = {"": [], "+": [], "-": []}
    previous = ""
    for word in query.split():
        if word in ("AND", "OR", "NOT"):
            previous = word
            continue
        sign = word[0] if word[0] in "+-" else ""
        sign = {"AND": "+", "NOT": "-"}.get(previous, sign)
        for term in re.findall(r"[^\W_]+\*?", word.lower()) if lower else [word.lstrip("+-")]:
            out[sign].append(term)
        if previous == "AND" and out[""]:
            out["+"].append(out[""].pop())
        previous = ""
    return out[""], out["+"], out["-"]


def _frequency(words: Column, term: str) -> Column:
    if term.endswith("*"):
        return F.size(F.filter(words, lambda t: t.startswith(term[:-1])))
    return F.size(F.filter(words, lambda t: t == term))


def matches(text: Column, query: str) -> Column:
    """Does the text match?"""
    optional, must, never = parse(query)
    words = tokens(text)
    one = lambda x: F.exists(words, lambda t: t.startswith(x[:-1]) if x.endswith("*") else t == x)
    some = lambda terms: list(map(one, terms))
    hit = functools.reduce(lambda a, b: a | b, some([*optional, *must]), F.lit(False))
    return functools.reduce(lambda a, b: a & b, [*some(must), *(~x for x in some(never))], hit)


def _idf(n: Column, freq: Column) -> Column:
    return F.log(1 + (n - freq + 0.5) / (freq + 0.5))


def scored(df: DataFrame, column: str, query: str, alias: str = "score") -> DataFrame:
    """Rows of ``df`` that match, with their score. Counts cover the whole table; one small aggregate, no shuffle of texts."""
    optional, must, never = parse(query)
    terms = list(dict.fromkeys([*optional, *must]))
    df = df.withColumn("_words", tokens(F.col(column)))  # a column of its own, so that it is computed once per row
    words = F.col("_words")
    df = df.withColumn("_len", F.size(words)).withColumns({f"_tf{k}": _frequency(words, t) for k, t in enumerate(terms)})
    if never:
        df = df.withColumn("_no", functools.reduce(lambda a, b: a | b, [_frequency(words, t) > 0 for t in never]))
    sums = df.agg(F.count(column).alias("_n"), F.avg(F.when(F.col(column).isNotNull(), F.col("_len"))).alias("_mean"), *(F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(terms))))
    # one row of totals: a broadcast of fixed size
    df = df.crossJoin(F.broadcast(sums)) if terms else df.withColumn("_n", F.lit(0))
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, freq = F.col(f"_tf{k}"), F.col(f"_df{k}")
        score = score + _idf(F.col("_n"), freq) * tf / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    hit = functools.reduce(lambda a, b: a | b, [F.col(f"_tf{k}") > 0 for k in range(len(terms))], F.lit(False))
    for t in must:
        hit = hit & (F.col(f"_tf{terms.index(t)}") > 0)
    if never:
        hit = hit & ~F.col("_no")
    # the filter is pushed below the words; a plain search of the text spares most rows their tokens
    holds = [F.contains(F.lower(F.col(column)), F.lit(t.rstrip("*"))) for t in terms]
    hit = functools.reduce(lambda a, b: a | b, holds, F.lit(False)) & hit
    made = [c for c in df.columns if re.fullmatch(r"_tf\d+|_df\d+|_words|_len|_no|_n|_mean", c)]
    return df.where(hit).withColumn(alias, score).drop(*made)


#: About so many words become one run of an inverted index: what a task counts at once, in some 100 MB of memory.
RUN = 1 << 21


def postings(df: DataFrame, key: str, column: str, analyser: str = "standard") -> DataFrame:
    """The inverted index in segments, as files are written: term, keys, lens, tfs, the last three lists of one length.

    A text's words are counted where the text is read, so no posting is shuffled: each task makes a segment of its own, sorted by
    term, in which a term has a row for each run of texts.  A look-up reads a few pages of each segment; ``unlisted`` gives a row
    per posting.  The whole text of each row is one more term, kept as a hash behind a character that no token has, for
    look-ups by ``=``.
    """
    words = df.select(F.col(key).alias("key"), tokens(F.col(column), analyser).alias("words"), verbatim(F.col(column)).alias("whole"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            many = len(batch.column(1).flatten())
            if held and size + many > RUN:
                yield from _counted(held)
                held, size = [], 0
            held.append(batch)
            size += many
        yield from _counted(held)

    kind = words.schema["key"].dataType.simpleString()
    return words.mapInArrow(run, f"term string, keys array<{kind}>, lens array<int>, tfs array<int>").sortWithinPartitions("term")


def _counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of some texts: one row per term, then one per text for the term that stands for it."""
    if not batches:
        return
    key, words, whole = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
    key, words, whole = (c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in (key, words, whole))
    lens = pc.fill_null(pc.list_value_length(words), 0).cast(pa.int32())

    def made(terms, starts, row, tf):
        at = pa.array(row)
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in (key.take(at), lens.take(at), pa.array(tf, pa.int32()))]
        return pa.RecordBatch.from_arrays([terms, *lists], ["term", "keys", "lens", "tfs"])

    coded = words.flatten().dictionary_encode()
    terms, code = coded.dictionary, np.asarray(coded.indices, np.int64)
    pair, tf = np.unique(code * len(key) + np.asarray(pc.list_parent_indices(words), np.int64), return_counts=True)
    code, row = np.divmod(pair, len(key))
    yield made(terms, np.searchsorted(code, np.arange(len(terms) + 1)), row, tf)
    row = np.flatnonzero(np.asarray(whole.is_valid()))
    yield made(whole.take(pa.array(row)), np.arange(len(row) + 1), row, np.ones(len(row)))


def unlisted(segments: DataFrame, key: str) -> DataFrame:
    """term, key, len, tf: a row per posting. A condition on the term reaches the scan."""
    one = segments.select("term", F.explode(F.arrays_zip("keys", "lens", "tfs")).alias("one"))
    return one.select("term", F.col("one.keys").alias(key), F.col("one.lens").alias("len"), F.col("one.tfs").cast("long").alias("tf"))


def verbatim(text: Column) -> Column:
    """The term that stands for a whole text."""
    return F.when(text.isNotNull(), F.concat(F.lit("\x00"), F.hex(F.xxhash64(text))))


def totals(postings: DataFrame) -> dict[str, Any]:
    """Number of texts and their mean length, from the terms that stand for whole texts."""
    row = postings.where(F.col("term").startswith("\x00")).agg(F.count(F.lit(1)), F.avg("len")).first()
    return {"texts": row[0], "mean": float(row[1] or 1)}


def _hit(term: str, analyser: str) -> Column:
    """The posting is of ``term``, which goes through the analyser as the texts did; a constant, so the scan is pruned by it."""
    if term.endswith("*"):
        return F.col("term").startswith(term[:-1])
    word = F.lit(term)
    if analyser == "soundex":
        word = F.soundex(word)
    elif analyser == "english":
        word = F.when(word.rlike("^.{2,}[^su]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.col("term") == word


def search(postings: DataFrame, key: str, totals: dict[str, Any], query: str, alias: str = "score", analyser: str = "standard") -> DataFrame:
    """key and score of the texts that match, from the postings of the query's terms alone."""
    optional, must, never = parse(query, analyser != "whitespace")
    hit_of = functools.partial(_hit, analyser=analyser)
    terms = list(dict.fromkeys([*optional, *must]))
    if not terms:
        return postings.select(key, F.lit(0.0).alias(alias)).limit(0)
    read = postings.where(functools.reduce(lambda a, b: a | b, map(hit_of, [*terms, *never])))
    tf = {f"_tf{k}": F.sum(F.when(hit_of(t), F.col("tf")).otherwise(0)).alias(f"_tf{k}") for k, t in enumerate(terms)}
    no = [F.max(functools.reduce(lambda a, b: a | b, map(hit_of, never))).alias("_no")] if never else []
    grouped = read.groupBy(key).agg(F.max("len").alias("_len"), *tf.values(), *no)
    # one row of document frequencies: a broadcast of fixed size
    freq = grouped.agg(*(F.count_if(F.col(t) > 0).alias(f"_df{k}") for k, t in enumerate(tf)))
    score, n = F.lit(0.0), F.lit(totals["texts"])
    for k, t in enumerate(tf):
        score = score + _idf(n, F.col(f"_df{k}")) * F.col(t) / (F.col(t) + K1 * (1 - B + B * F.col("_len") / F.lit(totals["mean"])))
    hit = functools.reduce(lambda a, b: a | b, [F.col(t) > 0 for t in tf])
    for t in must:
        hit = hit & (F.col(f"_tf{terms.index(t)}") > 0)
    if never:
        hit = hit & ~F.col("_no")
    return grouped.crossJoin(F.broadcast(freq)).where(hit).select(key, score.alias(alias))
