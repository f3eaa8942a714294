"""Suffix-array removal of repeated byte strings.

Every byte covered by a ``length``-byte string that also starts anywhere else goes.  Suffix arrays are built where
repeats can be: each ``length``-byte window has an anchor, its leftmost smallest ``gram``-byte hash, which depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets.  Anchors that occur once in the corpus settle
their windows.  The others send their span (the bytes of the windows they stand for) to the anchor's group.  Equal
spans settle each other, first within a task, which then sends one of them, then in the group; the rest of a group is
concatenated, sorted by ``suffix_array``, and neighbours in that order that agree in ``length`` bytes mark their windows.
Removed runs return to their documents.

``suffix_array`` is the linear grouping construction: suffixes are grouped by their Lyndon prefix, groups are processed
in descending order and lengthen the prefix of the suffix at their previous-smaller pointer, and a second scan emits
each group's order from the order of the suffixes that follow.  No recursion and no renaming takes place.

A group of more than ``largest`` bytes (a passage with very many different surroundings) is settled by sorting its
windows at each offset instead, in numpy, since the construction here is Python; the result is the same.

Null texts are empty; texts shorter than ``length`` lose nothing; repeated rows are each other's copies; a text may be
of any length below 2**38 bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import scratch
from vecloom.llm.text import mix, rows

LENGTH, GRAM = 200, 64
_B = 0x9E3779B97F4A7C15 | 1
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
CHUNK, BITS = 1 << 20, np.uint64(21)  # a position within a chunk and the window after it has 21 bits
#: Spans that a task holds to find equal ones before it sends them, and their bytes.
HELD, HELD_BYTES = 50_000, 16 << 20


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Start positions of all suffixes in lexicographic order."""
    n = len(text)
    if n == 0:
        return []
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(c, []).append(i)
    # groups in ascending order as a linked list; a group's members share a prefix that no other group has
    members: list[list[int] | None] = [by[c] for c in sorted(by)]
    below = list(range(-1, len(members) - 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    top, previous, skip, final = len(members) - 1, [-1] * n, list(range(-1, n)), []
    # skip[i + 1]: i while it is open; else somewhere below, by path halving
    while top >= 0:
        here = members[top]
        for i in here:
            skip[i + 1] = i - 1
        count: dict[int, int] = {}
        for i in here:
            j = i
            while skip[j] != j - 1:  # the nearest open position below i
                skip[j] = skip[skip[j] + 1]
                j = skip[j] + 1
            p = j - 1
            previous[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        final.append(here)
        lower = below[top]
        # a suffix whose prefix is followed by k copies of this group's prefix leaves its group upwards, by k
        moved: dict[int, dict[int, list[int]]] = {}
        for p, k in count.items():
            moved.setdefault(group[p], {}).setdefault(k, []).append(p)
        for g, parts in moved.items():
            total = sum(map(len, parts.values()))
            if len(parts) == 1 and total == len(members[g]):
                continue
            gone = {p for m in parts.values() for p in m}
            left = [i for i in members[g] if i not in gone] if total < len(members[g]) else None
            at = below[g]
            pieces = ([left] if left else []) + [parts[k] for k in sorted(parts)]
            for m in pieces[:-1]:
                new = len(members)
                members.append(m)
                below.append(at)
                for i in m:
                    group[i] = new
                at = new
            members[g], below[g] = pieces[-1], at
        top = lower
    # second scan: the suffix at i settles, in their groups, those whose prefix ends at i
    final.reverse()
    head, place = [0] * len(members), 0
    number = [0] * n
    for k, m in enumerate(final):
        head[k] = place
        place += len(m)
        for i in m:
            number[i] = k
    order, done = [-1] * n, [False] * n
    for k in range(-1, n):
        p = (n if k < 0 else order[k]) - 1
        while p >= 0 and not done[p]:
            done[p] = True
            g = number[p]
            order[head[g]] = p
            head[g] += 1
            p = previous[p]
    return order


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position of the anchor of each window start, hash at each position)."""
    n = len(raw)
    h = np.empty(n - gram + 1, np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(min(n, CHUNK + gram) - 1, np.uint64(_B))]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(min(n, CHUNK + gram) - 1, np.uint64(pow(_B, -1, 1 << 64)))]))
    code = _CODE[np.frombuffer(raw, np.uint8)]
    for a in range(0, len(h), CHUNK):
        part = code[a : a + CHUNK + gram - 1]
        s = np.concatenate([[np.uint64(0)], np.cumsum(part * power[: len(part)])])
        m = len(part) - gram + 1
        h[a : a + m] = (s[gram:] - s[:m]) * inverse[:m]
    h = mix(h)
    # sliding minimum of (hash, position) by prefix and suffix minima of blocks; the hash's bits that count and the order of
    # positions are the same in every text and part of it
    w, starts = length - gram + 1, n - length + 1
    out = np.empty(starts, np.int64)
    for a in range(0, starts, CHUNK):
        part = h[a : a + CHUNK + w - 1]
        key = (part >> BITS << BITS) | np.arange(len(part), dtype=np.uint64)
        full = np.full(-(-len(key) // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
        full[: len(key)] = key
        blocks = full.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = min(CHUNK, starts - a)
        low = np.minimum(back[:m], ahead[w - 1 : w - 1 + m])
        out[a : a + m] = (low & ((np.uint64(1) << BITS) - np.uint64(1))).astype(np.int64) + a
    return out, h


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def reach(parts: list[bytes]) -> list[int]:
    """For each string, the longest prefix that it shares with any other: neighbours in sorted order have it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        k = shared(parts[i], parts[j])
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def marked(spans: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each span (bytes, offset of its anchor), which of its windows also start elsewhere in ``spans``.

    A shared window holds the anchor, so it lies within what the span shares with any other to the left and right of
    it; the rest of the span is left out of the suffix array.
    """
    out = [np.zeros(len(s) - length + 1, bool) for s, _ in spans]
    left, right = reach([s[:o][::-1] for s, o in spans]), reach([s[o:] for s, o in spans])
    kept = [(k, o - a, s[o - a : o + b]) for k, ((s, o), a, b) in enumerate(zip(spans, left, right, strict=True)) if a + b >= length]
    if len(kept) > 1:
        text = b"\n".join(s for _, _, s in kept)  # a separator for places only: windows are compared within their spans
        symbols = np.frombuffer(text, np.uint8).astype(np.int64) + 1
        where, shift, at = np.full(len(text), -1), [], 0
        for x, (_, a, s) in enumerate(kept):
            shift.append(a - at)
            where[at : at + len(s) - length + 1] = x
            at += len(s) + 1
            if at <= len(text):
                symbols[at - 1] = 0
        where = where.tolist()
        order = [i for i in suffix_array(symbols.tolist()) if where[i] >= 0]
        for i, j in zip(order, order[1:], strict=False):
            if text[i : i + length] == text[j : j + length]:
                for x in (i, j):
                    out[kept[where[x]][0]][x + shift[where[x]]] = True
    return out


def plain_marks(spans: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """The same for spans given with their anchor's offset: windows at one offset are sorted as they are."""
    out = [np.zeros(len(s) - length + 1, bool) for s, _ in spans]
    for back in range(length):
        have = [(k, o - back) for k, (s, o) in enumerate(spans) if 0 <= o - back < len(out[k])]
        if len(have) > 1:
            cut = np.frombuffer(b"".join(spans[k][0][a : a + length] for k, a in have), f"V{length}")
            _, inverse, count = np.unique(cut, return_inverse=True, return_counts=True)
            for (k, a), n in zip(have, count[inverse], strict=True):
                out[k][a] = n > 1
    return out


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    # the hash tells apart rows of one doc_id; both joins below deal this out alike, so its exchange is used twice
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))

    def first(batches):
        for ids, ths, texts in rows(batches, "doc_id", "th", "text", slice_rows=128):
            out = ([], [], [], [])
            for i, th, t in zip(ids, ths, texts, strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    at, h = anchors(raw, length, gram)
                    p = np.unique(at)
                    out[0].extend([i] * len(p))
                    out[1].extend([th] * len(p))
                    out[2].append(p)
                    out[3].append(h[p])
            cat = [np.concatenate(x) if x else np.zeros(0) for x in out[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.uint64).view(np.int64))], ["doc_id", "th", "p", "fp"])

    found = scratch.save(docs.mapInArrow(first, "doc_id long, th long, p long, fp long"), "anchors")
    # a table, so that the join below has plain exchanges on both sides, of which adaptive execution splits a hot anchor's
    again = scratch.save(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "again")
    # rows with one id and one text share a list: its positions are sets
    places = found.join(again, "fp").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("p")).alias("ps"))

    on = [F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("l.th") == F.col("r.th")]
    with_places = docs.alias("l").join(places.alias("r"), on).select("l.doc_id", "l.th", "text", "ps")

    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    columns = ["fp", "span", "off", "doc_id", "th", "a", "b", "many"]

    def spans(batches):
        """A row per span (``many``: it has been found equal to another), or with no span a run that is settled."""
        held: dict[tuple[int, bytes], list] = {}
        out, weight = tuple([] for _ in kinds), 0

        def put(*row):
            for x, value in zip(out, row, strict=True):
                x.append(value)

        def run(i, th, a, b):  # dealt anywhere
            put(int(np.int64(((i or 0) * 0x9E3779B97F4A7C15 + th * 3 + a * 0x2545F4914F6CDD1D) & 0x7FFFFFFFFFFFFFFF)), b"", -1, i, th, a, b, True)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], columns)
            for x in out:
                x.clear()
            return batch

        def let_go():
            nonlocal weight
            for (fp, span), (off, i, th, a, _, many) in held.items():
                put(fp, span, off, i, th, a, 0, many)  # the end follows from the span; a constant takes no room
            held.clear()
            weight = 0

        for batch in batches:
            for ids, ths, texts, pss in rows([batch], "doc_id", "th", "text", "ps", slice_rows=64):
                for i, th, text, ps in zip(ids, ths, texts, pss, strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    at, h = anchors(raw, length, gram)
                    # positions of one anchor are consecutive starts, since anchors never move left
                    low, high = np.searchsorted(at, ps, "left"), np.searchsorted(at, ps, "right")
                    for p, fp, a, b in zip(ps, h[ps].view(np.int64).tolist(), low.tolist(), high.tolist(), strict=True):
                        b += length - 1
                        have = held.get((fp, raw[a:b]))
                        if have is None:
                            held[fp, raw[a:b]] = [p - a, i, th, a, b, False]
                            weight += b - a
                            continue
                        if not have[5]:
                            have[5] = True
                            run(*have[1:5])
                        if have[1:4] != [i, th, a]:
                            run(i, th, a, b)
                if len(held) > HELD or weight > HELD_BYTES:
                    let_go()
                yield flush()
        let_go()
        yield flush()

    sent = with_places.mapInArrow(spans, "fp long, span binary, off int, doc_id long, th long, a long, b long, many boolean")

    def settle(batches):
        """Rows come sorted by (fp, span), so equal spans are neighbours and only one of them is kept."""
        held: list[list] = []
        now = None
        result = ([], [], [], [])

        def give(row, a, b):
            for x, value in zip(result, (row[3], row[4], row[5] + a, row[5] + b), strict=True):
                x.append(value)

        def close():
            lonely = [h for h in held if not h[7]]
            if lonely and len(held) > 1:
                pieces = [(h[1], h[2]) for h in held]
                marks = marked(pieces, length) if sum(len(p) for p, _ in pieces) <= largest else plain_marks(pieces, length)
                for h, m in zip(held, marks, strict=True):
                    if not h[7]:
                        for a, b in runs(m):
                            give(h, a, b - 1 + length)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(result[0], pa.int64()), pa.array(result[1], pa.int64()), pa.array(result[2], pa.int64()), pa.array(result[3], pa.int64())], ["doc_id", "th", "a", "b"])
            for x in result:
                x.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] < 0:
                    give(row, 0, row[6] - row[5])
                    continue
                if row[0] != now:
                    close()
                    held, now = [], row[0]
                if held and held[-1][1] == row[1]:
                    for one in (held[-1], row):
                        if not one[7]:
                            give(one, 0, len(row[1]))
                    held[-1][7] = True
                else:
                    held.append([*row])
            yield flush()
        close()
        yield flush()

    gone = sent.repartition("fp").sortWithinPartitions("fp", "span").mapInArrow(settle, "doc_id long, th long, a long, b long")
    merged = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("cut"))
    both = docs.alias("l").join(merged.alias("r"), on, "left").select("l.doc_id", "text", "cut")

    def finish(batches):
        for batch in batches:
            for ids, texts, cuts in rows([batch], "doc_id", "text", "cut", slice_rows=128):
                out = ([], [], [], [], [], [])
                for i, text, cut in zip(ids, texts, cuts, strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    kept, at, removed, n = [], 0, 0, 0
                    for c in cut or []:
                        if c["a"] > at or n == 0:  # a new run; runs that touch are one
                            kept.append(raw[at : c["a"]])
                            n += 1
                            at = c["a"]
                        if c["b"] > at:
                            removed += c["b"] - at
                            at = c["b"]
                    kept.append(raw[at:])
                    left = b"".join(kept)
                    for x, value in zip(out, (i, len(raw), removed, n, hashlib.sha256(left).hexdigest(), left), strict=True):
                        x.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
