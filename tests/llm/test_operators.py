"""Each operator against a plain version, on small tables with nulls, empty and repeated rows and clashing columns."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import chat, gbt, html, jaccard, lines, mixing, packing, quality, suffix, tokens, topk, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = words(rng, 200)
    edited = base.split()
    edited[90] = "other"
    passage = words(rng, 70)
    texts = [None, "", " \n ", "one", "One two", base, base, " ".join(edited), base + " tail", words(rng, 30) + " " + passage, words(rng, 40) + " " + passage + " " + words(rng, 9), "aaaa " * 300, "é" * 450, passage + "\n" + passage, "<|endoftext|> x", words(rng, 20000, 9000)]
    texts += [words(rng, 60) + "\nboiler plate line\n" + words(rng, 5) for _ in range(14)]
    return spark.createDataFrame([(k, t, "en", f"s{k}" if k else None, 7) for k, t in enumerate(texts)] + [(5, base, "en", "s1", 7)], DOCS)


def test_suffix_array_sorts():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(1, rng.choice([2, 3, 9])) for _ in range(rng.randrange(60))]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed_by_force(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), len(suffix.runs(gone)), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [200_000, 0])
def test_suffix_dedup(docs, largest):
    rows = docs.collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, removed_by_force([(r.text or "").encode() for r in rows], 200), strict=True))
    got = sorted(tuple(r) for r in suffix.dedup(docs, largest=largest).drop("kept").collect())
    assert got == want


def test_suffix_dedup_of_nothing(spark):
    assert suffix.dedup(spark.createDataFrame([], DOCS)).count() == 0


def jaccard_by_force(rows, width, percent):
    def shingle(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets, root = [(r.doc_id, shingle(r.text)) for r in rows], {r.doc_id: r.doc_id for r in rows}
    changed = True
    links = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= percent * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sorted((d, len(s), root[d]) for d, s in sets)


@pytest.mark.parametrize(("width", "percent", "chunk"), [(3, 90, 512), (5, 80, 2)])
def test_jaccard(docs, width, percent, chunk):
    got = sorted(tuple(r) for r in jaccard.join(docs, width, percent, chunk).drop("th").collect())
    assert got == jaccard_by_force(docs.collect(), width, percent)


def test_jaccard_of_a_large_group(spark):
    """Near copies so many that their keys are aggregated before the shuffle, and exact copies among them."""
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 120, 3)] + [" ".join(base)] * 5
    docs = spark.createDataFrame([(k, t, "en", "s", 7) for k, t in enumerate([*texts, "a b c d"])], DOCS)
    often = jaccard.common(docs, 3)
    assert len(jaccard.hot_keys(docs, 3, 90, often))
    assert sorted(tuple(r) for r in jaccard.join(docs).drop("th").collect()) == jaccard_by_force(docs.collect(), 3, 90)


def test_jaccard_tells_rows_of_one_id_apart(spark):
    rng = random.Random(6)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a), (4, c), (4, c), (None, c + " x"), (None, words(rng, 50))]
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.component_id) for r in jaccard.join(docs, 5, 80).collect())
    assert got == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 2, (None, 4): 1, (None, None): 1})


def test_jaccard_keys_of_pairs_that_just_link():
    """Such pairs meet at any sizes, and a set has one key more than elements that may differ."""
    rng = np.random.default_rng(1)
    often = np.zeros(0, np.uint64)
    for percent in (60, 80, 90):
        for n in (1, 2, 7, 31, 64, 255, 256, 300, 641, 1000, 1025):
            for m in {n, n * 100 // percent, (n + n * 100 // percent) // 2}:
                both = -(-percent * (n + m) // (100 + percent))
                x = rng.permutation(4 * n + 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : n + m - both]]))
                if both <= n:
                    assert len(np.intersect1d(*(jaccard.keys_of(s, percent, often) for s in (a, b)))), (percent, n, m)
    assert len(jaccard.keys_of(np.sort(x[:1000]), 80, often)) == 251


def test_jaccard_shuffles_its_keys_once(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, words(rng, 400, 10**6), "en", "s", 7) for k in range(50)], DOCS)
    for sampled in ("common", "hot_keys"):
        monkeypatch.setattr(jaccard, sampled, lambda *_: np.zeros(0, np.uint64))
    n = jaccard.measured(docs, 5, 80, np.zeros(0, np.uint64), np.zeros(0, np.uint64)).selectExpr("sum(size(keys))").first()[0]

    def shuffled():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = shuffled()
    assert jaccard.join(docs, 5, 80).count() == 50
    assert n <= sum(v for k, v in shuffled().items() if k not in before) < 1.5 * n


def test_jaccard_of_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup(docs):
    rows = {(r.doc_id, r.source): r for r in lines.remove(docs).collect()}
    holders = [r for r in rows.values() if r.doc_id >= 16]
    assert sum("boiler plate line" in r.text for r in holders) == 1
    assert rows[16, "s16"].n_removed == 0 and rows[17, "s17"].n_removed == 1 and rows[17, "s17"].n_lines == 3
    assert rows[0, None].text is None and rows[0, None].n_lines == 0 and rows[1, "s1"].text == ""
    assert len(rows) == docs.count()


def test_line_dedup_exact_near_threshold(docs):
    for sites in (13, 14, 15):
        gone = sum(r.n_removed for r in lines.remove(docs, min_sites=sites).collect())
        assert gone == (13 if sites <= 14 else 0)


def test_line_dedup_of_long_lines(spark):
    rng = random.Random(8)
    notice = words(rng, 300)
    docs = spark.createDataFrame([(k, f"{words(rng, 40)}\n{notice}\nend {k}", "en", f"s{k}", 7) for k in range(12)], DOCS)
    rows = {r.doc_id: r for r in lines.remove(docs).collect()}
    assert len(notice) > 1000 and [k for k, r in rows.items() if notice in r.text] == [0]
    assert [rows[k].n_removed for k in range(12)] == [0] + [1] * 11


def test_line_dedup_of_odd_columns_and_of_nothing(spark, docs):
    names = ["cut", "cut_id", "k", "a", "b", "row", "pos", "first", "n_removed", "x.y"]
    odd = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    got = lines.remove(odd, counts=("lines before", "gone"))
    assert got.columns == [*docs.columns, *names, "lines before", "gone"]
    assert sum(r.gone for r in got.collect()) == sum(r.n_removed for r in lines.remove(odd).collect()) == 13
    assert lines.remove(odd.limit(0)).count() == 0
    base = duckdb.connect()
    base.register("documents", docs.dropDuplicates(["doc_id"]).toArrow())
    want = {r[0]: r[1:] for r in base.execute(lines.ORACLE).fetchall()}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove(docs.dropDuplicates(["doc_id"])).collect()} == want


def measured_by_force(text):
    w = (text or "").encode().split()
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)]


def test_quality_counts(docs):
    for r in docs.collect():
        assert quality.measure(r.text)[0] == measured_by_force(r.text)


def test_quality_verdicts(spark):
    rows = quality.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    told = {r.doc_id: r.quality for r in labels.collect()}
    forest = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    other = [r for r in quality.score(docs.where("doc_id % 2 = 1"), forest).collect() if r.doc_id in told and not r.base_failed]
    assert len(other) > 500 and np.mean([r.kept == (told[r.doc_id] == 1) for r in other]) > 0.97


def test_quality_of_nothing(spark, docs):
    forest = quality.fit(docs, spark.createDataFrame([(99, None, 0)], "doc_id long, quality int, toxic int"))
    assert quality.score(docs.limit(0), forest).count() == 0 and quality.keep(docs.limit(0), forest).columns == docs.columns
    odd = docs.select("*", F.lit(1).alias("kept"), F.lit(2).alias("features"))
    assert quality.keep(odd, forest).columns == odd.columns and quality.score(odd, forest).count() == docs.count()


def test_trees_are_monotonic_and_generalise():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(3000)) > 0.5).astype(float)
    forest = gbt.train(x[:2000], y[:2000], [1, 0, -1])
    assert ((forest.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    up = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.5)], axis=1)
    assert (np.diff(forest.score(up)) >= -1e-9).all()
    assert gbt.train(x[:0], y[:0], [1, 0, -1]).score(x[:3]).tolist() == [0, 0, 0]


def test_trees_without_labels(spark, docs):
    labels = spark.createDataFrame([(99, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep(docs, quality.fit(docs, labels)).columns == docs.columns


def test_tokens_equal_the_measure(docs):
    odd = ["a  b", " a", " ", "a \n b\n\n", "it's <|endoftext|> ok", "\u00a0x \x1c y", "日本語 text", "'s 12 ab12!?"]
    for t in [r.text for r in docs.collect()] + odd:
        assert tokens.ids(t).tolist() == (tokens.reference().encode(t, add_special_tokens=False).ids if t else [])


def test_tokens_around_white_space():
    """Texts with white space in rows, which need the look-ahead, and without, which take the pattern that has none."""
    rng = random.Random(4)
    for _ in range(1500):
        t = "".join(rng.choice(["a", "Bc", "12", "!", "'s", "\u00e9", "\u8a9e", " ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b"]) for _ in range(rng.randrange(1, 9)))
        assert tokens.ids(t).tolist() == tokens.reference().encode(t, add_special_tokens=False).ids, repr(t)


def test_tokens_of_plain_texts_spare_the_look_ahead():
    rng = random.Random(5)
    texts = ["\n".join(" ".join("".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(12)) for _ in range(40)) for _ in range(60)]

    def least(f):
        took = []
        for _ in range(7):
            at = time.process_time()
            for t in texts:
                f(t)
            took.append(time.process_time() - at)
        return min(took)

    slow = tokens._encoder(True)
    tokens.ids(texts[0])
    assert least(tokens.ids) < 0.92 * least(lambda t: slow.encode_to_numpy(t, disallowed_special=()).astype("<u2"))


def test_packing(docs):
    rows = packing.pack(docs, shard_tokens=9000).collect()
    by, whole = {}, Counter()
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        whole[r.doc_id] += r.length
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        total = sum(p.length for p in pieces)
        assert total <= 2048 and total & (total - 1) == 0  # nothing is padded
    ids = Counter()
    for r in docs.collect():
        ids[r.doc_id] += len(tokens.ids(r.text)) + 1
    assert whole == ids
    # every id lies in one piece: the pieces of a document follow each other, and their digests are those of its ids
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        own = sorted(pieces[r.doc_id], key=lambda x: x.start)
        if r.doc_id == 5:
            continue  # two rows
        told = np.array([*(tokens.reference().encode(r.text, add_special_tokens=False).ids if r.text else []), 1], "<u4")
        assert [x.start for x in own] == np.cumsum([0, *(x.length for x in own)])[:-1].tolist() and {x.doc_tokens for x in own} == {len(told)}
        assert [x.ids_crc32 for x in own] == [zlib.crc32(told[x.start : x.start + x.length].tobytes()) for x in own]


def test_packing_splits_a_large_group_of_copies_and_keeps_near_copies_together(spark):
    rng = random.Random(11)
    copy, near = words(rng, 300), words(rng, 300)
    rows = [(k, copy) for k in range(40)] + [(100 + k, near + f" {k}") for k in range(6)] + [(200 + k, words(rng, 300)) for k in range(30)] + [(None, "a")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, leaf int, p int, sketch int")
    table = packing.dealt(packing.tokenised(docs, packing.tree(docs)), 8000).select("doc_id", "n", "p", "g", "s").collect()
    sizes = Counter()
    for r in table:
        sizes[r.p, r.g, r.s] += r.n
    assert len({(r.p, r.g, r.s) for r in table if r.doc_id is not None and r.doc_id < 40}) > 1
    # near copies have one sketch; a branch that fits into a shard is one, a larger one is cut between leaves
    ids = [np.append(tokens.ids(t), np.uint16(1)) for _, t in rows] + [np.array([1], "<u2"), np.arange(7, dtype="<u2"), np.arange(8, dtype="<u2")]
    assert packing.sketches(ids) == [packing.sketches([x])[0] for x in ids]
    assert len({x for x, (i, _) in zip(packing.sketches(ids), rows, strict=False) if i in range(100, 106)}) == 1
    group, parts = packing.places({0: 10, 1: 20, 2: 71, 16: 5, 17: 300}, 100)
    assert group[0] == group[1] != group[2] and group[16] != group[17] and set(parts) == {1, 3} and parts[17] == 3
    out = packing.pack(docs, shard_tokens=8000).collect()
    assert Counter((r.doc_id is None, r.doc_id) for r in out).keys() == Counter((i is None, i) for i, _ in rows).keys()
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_fills_windows_with_the_nearest(spark):
    """The index against BM25 by definition, and a window's documents against the greedy choice."""
    rng = random.Random(12)
    docs = [np.array([rng.randrange(50 + 40 * (k % 3)) + 100 * (k % 3) for _ in range(rng.randrange(20, 120))], "<u2") for k in range(60)]
    df = np.zeros(packing.VOCABULARY)
    for d in docs:
        df[np.unique(d)] += 1
    mean, idf = float(np.mean([len(d) for d in docs])), np.maximum(0, np.log((60 - df + 0.5) / (df + 0.5)))
    index = packing.Index(docs, idf, mean)
    for q in range(0, 60, 7):
        want = [sum(idf[t] * (f := int((d == t).sum())) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[q].tolist())) for d in docs]
        assert np.allclose(index.scores(q), want)
    got = packing.pack_shard(docs, idf, mean, 256)
    first = [d for d, _, _, s, _ in got if s == 0]
    used, expect, filled = np.zeros(60, bool), [0], len(docs[0])
    used[0] = True
    while filled < 256:
        score = np.where(used, -1, index.scores(0))
        expect.append(int(score.argmax()))
        used[expect[-1]] = True
        filled += len(docs[expect[-1]])
    assert first == expect


def test_chat_round_trip(spark):
    rng = random.Random(5)
    marks = ["<s>", "</s>", "\ue000", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]", "\\", " ", "\n", "a", "<", "["]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a\nb", "\\", "x\\\n[/ROLE]"]), "".join(rng.choices(marks, k=rng.randrange(6)))) for _ in range(rng.randrange(1, 5))]
        out, spans, texts, rewrites = chat.locate(turns, chat.render)
        assert chat.read_back(out) == turns and not rewrites
        assert [chat.unescape(out[a:b]) for a, b in texts] == [t for _, t in turns]
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "hi", "x"), (2, 0, None, "", "x"), (None, 0, "user", "n", "x"), (1, 1, "assistant", "hi", "x")]
    got = {r.conv_id: r for r in chat.digest(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 4 and got[2].n_turns == 1 and got[None].n_turns == 1


def test_chat_finds_templates_that_rewrite():
    def template(turns):
        return "".join(f"<{'last' if k == len(turns) - 1 else 'turn'}>{t}" for k, (_, t) in enumerate(turns))

    for n in (3, 100):
        turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(n)]
        out, _, texts, rewrites = chat.locate(turns, template)
        assert rewrites and [out[a:b] for a, b in texts] == [t for _, t in turns]


def test_chat_of_long_conversations():
    """Blocks give what all prefixes give, also where the template looks at how far the conversation has come."""

    def counting(turns):
        return "".join(f"#{k} {role}: {text}\n" for k, (role, text) in enumerate(turns))

    def forgetful(turns):  # drops the first turn of a long conversation
        return chat.render(turns[1:] if len(turns) > 50 else turns)

    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k} </s> \\ \ue000") for k in range(150)]
    for template in (chat.render, counting, forgetful):
        assert chat.locate(turns, template) == chat.locate(turns, template, near=len(turns))
    assert chat.locate(turns, forgetful)[3] and not chat.locate(turns, counting)[3]
    began = time.process_time()
    long = turns * 100
    out, _, texts, _ = chat.locate(long, chat.render)
    assert chat.read_back(out) == long and [chat.unescape(out[a:b]) for a, b in texts[:300]] == [t for _, t in long[:300]]
    assert time.process_time() - began < 60


def test_chat_of_nothing(spark):
    assert chat.digest(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_html():
    page = "<html><head><title>t</title></head><body><nav><p>menu of the day and more of it</p></nav><article><h1>A &amp; B</h1><p>Sh <b>is</b>.<br>x<p>two<aside>ad</aside><script>var t='</p>'</script></article><footer>f</footer>"
    assert html.main_text(page) == "A & B\nSh is. x\ntwo"
    dense = "It is the story of the man that was in the house of the king and it is for you to say that he was at the end of it all with you"
    open_page = f"<div class=menu><a href=x>Home</a></div><div><p>{dense}</p><p>Short one.</p><p>{dense}</p><ul><li><a href=a>link link link link link link link</a></ul></div>"
    assert html.main_text(open_page) == f"{dense}\nShort one.\n{dense}"
    assert html.main_text(None) == html.main_text("") == html.main_text("<!-- x") == ""
    assert html.main_text("plain  text") == "plain text"


def test_html_rules_hold_beside_and_inside_an_article():
    dense = "It is the story of the man that was in the house of the king and it is for you to say that he was at the end of it all with you"
    beside = f"<article><p>A teaser.</p></article><div><p>{dense}</p><p>{dense}</p></div>"
    assert html.main_text(beside) == f"A teaser.\n{dense}\n{dense}"
    links = "<ul><li><a href=a>one more link to some other page</a></li><li><a href=b>and a link to yet another page</a></li></ul>"
    assert html.main_text(f"<nav>Home</nav><article><h1>Head</h1><p>{dense}</p>{links}<p>Wörter ohne Funktion</p></article>") == f"Head\n{dense}\nWörter ohne Funktion"
    assert html.main_text(f"<article>{links}<p>More</p>{links}</article><div><p>{dense}</p></div>") == dense


def test_html_of_hostile_pages_takes_linear_time():
    pages = ["<a " * 340_000 + '"', "<div>" * 100_000 + "</b>" * 100_000, '<a href="x ' * 90_000, "<head>" * 160_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<!--x" * 200_000, "<svg>" * 200_000, "<p a= " + " " * 1_000_000 + '"', "<" * 1_000_000]
    for page in pages:
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 6, page[:20]  # a second or less on a free machine


def plain_extraction(page):
    """The same rules, written with the standard library's parser and lists."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.text, self.linked, self.stack, self.links, self.raw = [], "", 0, [], 0, None

        def flush(self):
            text = " ".join(self.text.split())
            if text:
                self.found.append((text, self.stack[-1][1] if self.stack else "none", min(self.linked, len(text))))
            self.text, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if self.raw:
                return
            if tag in html.RAW | html.WHOLE:
                self.raw = tag
            if tag in html.BLOCK:
                self.flush()
            if self.raw:
                return
            if tag == "br":
                self.text += "\n"
            self.links += tag == "a"
            if tag in html.BLOCK and tag not in html.VOID:
                self.links = self.links if tag in ("li", "dt", "dd", "option") else 0
                while self.stack and self.stack[-1][0] in html.IMPLIED.get(tag, {"p"}):
                    self.stack.pop()
                zone, told = self.stack[-1][1] if self.stack else "none", dict(attrs)
                names = " ".join(told[k] or "" for k in told if k in ("class", "id", "role"))
                if zone != "poor" and tag not in ("html", "body"):
                    if tag in html.POOR and not (tag == "header" and zone == "rich") or html.POOR_NAME.search(names) or "hidden" in told:
                        zone = "poor"
                    elif tag in html.RICH or html.RICH_NAME.search(names):
                        zone = "rich"
                self.stack.append((tag, zone))

        def handle_endtag(self, tag):
            if self.raw:
                self.raw = None if tag == self.raw else self.raw
                return
            if tag == "a":
                self.links = max(0, self.links - 1)
            if tag in html.BLOCK:
                self.flush()
                if tag in [t for t, _ in self.stack]:
                    while self.stack.pop()[0] != tag:
                        pass

        def handle_data(self, data):
            if not self.raw:
                self.text += data
                self.linked += len(" ".join(data.split())) * bool(self.links)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    labels = []
    for text, zone, linked in reader.found:
        words = text.lower().split()
        dense = sum(w.encode().strip(b".,;:!?") in quality.FUNCTION_WORDS for w in words) / len(words)
        rich = zone == "rich"
        good = dense >= (0.15 if rich else 0.25) or len(text) >= 140 and dense >= 0.15
        open_ = len(text) < 60 or rich or len(text) >= 140 or dense >= 0.15
        labels.append(False if zone == "poor" or linked > 0.4 * len(text) else True if len(text) >= 60 and good else None if open_ else False)
    if all(x is None for x in labels):
        labels = [True] * len(labels)
    kept = []
    for k, (text, zone, _) in enumerate(reader.found):
        label = labels[k]
        if label is None:
            able = [j for j, x in enumerate(labels) if x is not None and (zone != "rich" or reader.found[j][1] != "poor")]
            before, after = [j for j in able if j < k][-1:], [j for j in able if j > k][:1]
            if zone == "rich":
                label = not (before and after and labels[before[0]] is False and labels[after[0]] is False)
            else:
                gap = min([k - j for j in before] + [j - k for j in after])
                label = any(labels[j] for j in before + after if abs(j - k) == gap)
        if label:
            kept.append(text)
    return "\n".join(kept)


def test_html_extract_against_a_plain_version(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(-1, None, None), (-2, "u", ""), (-2, "u", ""), (-3, "v", "<p>one <b>two</b>&nbsp;three<p>four<br>five")]
    given = pages.select("page_id", "url", "html", F.lit(1).alias("text"), F.lit(2).alias("n_chars")).unionByName(spark.createDataFrame([(*o, 1, 2) for o in odd], "page_id long, url string, html string, text int, n_chars int"))
    got = sorted((tuple(r) for r in html.extract(given).collect()), key=str)
    want = sorted(((r.page_id, r.url, t := plain_extraction(r.html), len(t)) for r in given.collect()), key=str)
    assert got == want
    assert html.extract(given.limit(0)).count() == 0


def test_urls(spark):
    given = [(1, "http://Net/es/a"), (2, "https://a.net/fr/?q"), (3, "http://example.com/en/x#y"), (4, "x://www.example.com/en/"), (5, "https://a.www.example.com/de"), (6, None), (7, "no scheme"), (8, "http://example.org/"), (9, "http://com"), (9, "http://com/"), (10, "http://xcom/"), (11, "http://a.net/es/" + "x" * 100_000), (11, "http://a.net/es/" + "x" * 100_000)]
    pages = spark.createDataFrame([(*g, "z") for g in given], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in urls.judge(pages, rules, ranges=3).collect())
    assert got == sorted([(1, "net/es/", "block"), (2, "net/fr/", "block"), (3, "example.com/en/", "block"), (4, "www.example.com/en/", "allow"), (5, "com/", "allow"), (6, "", "allow"), (7, "", "allow"), (8, "/", "block"), (9, "", "allow"), (9, "com/", "allow"), (10, "/", "block"), (11, "net/es/", "block"), (11, "net/es/", "block")])
    untold = spark.createDataFrame([("net", "/", None), (None, None, "allow"), ("net", "/", "allow")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, untold, ranges=2).collect()}[2] == "block"
    assert {r.rule for r in urls.judge(pages, untold.limit(0)).collect()} == {None}
    assert urls.judge(pages.limit(0), rules).count() == 0


def topk_by_force(rows, asked, k=10):
    """Each query row against all other rows, with Python's whole numbers."""
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if asked(i):
            score = lambda v: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=False))))  # noqa: B023, E731
            best = sorted((-score(v), j) for m, (j, v) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>"


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for k in range(400)] + [(400, [1.0] * 8), (401, [1.0] * 8), (500, None), (501, [float("nan")] * 8), (502, [1.0]), (503, [None] * 8), (None, [1.0] * 8), (504, []), (505, [float("inf")] + [0.0] * 7)]
    table = topk.integers(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", query_id string, row long").repartition(5))
    asked = F.col("vec_id") % 50 == 0
    assert sorted(tuple(r) for r in topk.search(table, asked, block=4).collect()) == topk_by_force(rows, lambda i: i % 50 == 0)
    empty = topk.search(table.limit(0), asked)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.search(table.where("vec_id = 7"), F.lit(True)).count() == 0  # nothing but the query itself


def test_topk_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(8).astype(np.float32).tolist()) for k in [*range(201), 100, 100, *[7] * 4]]
    rows += [(9, [3.0] * 8)] * 4 + [(11, [-3.0] * 8)] * 4 + [(100, [0.5] * 8)] * 2
    given = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(tuple(r) for r in topk.search(topk.integers(given), F.col("vec_id") % 100 == 0, block=2, visit=3).collect())
    base = duckdb.connect()
    base.register("embeddings", given.toArrow())
    assert got == sorted(base.execute(topk.ORACLE).fetchall()) == topk_by_force(rows, lambda i: i % 100 == 0) and len(got) == 70


def test_topk_of_very_many_equal_vectors_and_very_large_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [2.0] * 6) for k in range(3000)] + [(3000 + k, rng.standard_normal(6).astype(np.float32).tolist()) for k in range(300)]
    rows += [(4000, [3e38] * 6), (4001, [-3e38] * 6), (4002, [4e9, 0.0, 0.0, 0.0, 0.0, 0.0]), (4003, [2.0**40, 1.0, -(2.0**40), 0.0, 0.5, 0.0])]
    got = sorted(tuple(r) for r in topk.search(topk.integers(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 500 == 0, visit=7).collect())
    assert got == topk_by_force(rows, lambda i: i % 500 == 0)


def test_mixing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.mix(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    p = np.array([r.p for r in got])
    n, rate = np.array([r.tokens for r in got]), np.array([r.rate for r in got])
    total = (n * rate) @ p
    assert np.allclose(total / total.sum(), [0.9, 0.08, 0.02], atol=1e-3) and (rate >= 0).all()
    steps = [np.array([0.5, -0.2, 0.1]), np.array([0.9, 0.0, 0.0])]
    by_hand = [max(0.0, max(0.0, 1 - x @ steps[0]) - x @ steps[1]) for x in p[:50]]
    assert np.allclose(mixing.rates(p[:50], steps), by_hand)
    assert n.tolist() == [len(tokens.reference().encode(t, add_special_tokens=False).ids) if t else 0 for t in (texts[r.doc_id] for r in got)]
    # the fit against plain projected steps over all rows at once
    x, share, r = p, np.array([0.9, 0.08, 0.02]), np.ones(len(p))
    target = share * 1.05 * (n @ x)[0] / share[0]
    for _ in range(4000):
        r = np.maximum(0, r - 0.2 * (x * n[:, None]).max() ** -1 * (x @ ((r * n) @ x - target)) / len(x))
    assert np.abs((r * n) @ x - target).max() < 0.02 * target.sum() and np.abs(total - target).max() < 1e-4 * target.sum()
    again = Counter(r.doc_id for r in mixing.resampled(docs, labels).collect())
    assert again == Counter({r.doc_id: r.copies for r in got if r.copies}) and max(again.values()) > 1
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.resampled(docs.limit(0), nobody).columns == docs.columns


def test_mixing_tells_domains_apart_and_warns_where_a_target_cannot_be_met(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    told = {r.doc_id: 2 if r.toxic == 1 else 0 if r.quality == 1 else 1 for r in labels.collect()}
    model = mixing.classifier(docs, labels.where("doc_id % 2 = 0"))
    rows = [r for r in docs.where("doc_id % 2 = 1").collect() if r.doc_id in told and (r.text or "").split()]
    p = mixing.shares([r.text for r in rows], model)[0].argmax(axis=1)
    assert np.mean([k == told[r.doc_id] for k, r in zip(p, rows, strict=True)]) > 0.9
    table = spark.createDataFrame([(k, 10, [1.0, 0.0, 0.0]) for k in range(5)], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss their targets"):
        steps = mixing.fit(table, [0.5, 0.3, 0.2])
    assert np.isfinite(mixing.rates(np.array([[1.0, 0.0, 0.0]]), steps)).all()


def test_suffix_dedup_of_a_hot_passage(spark):
    """One passage in many texts, a periodic text, equal rows: spans are found equal within tasks and between them."""
    rng = random.Random(9)
    passage = words(rng, 90)
    texts = [f"{words(rng, 25)} {passage} {words(rng, 25)}" for _ in range(60)] + ["ab " * 700, "ab " * 300 + words(rng, 30), passage, passage]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(texts)] + [(61, texts[61], 1, 2, 3)], "doc_id long, text string, fp int, span int, a int").repartition(3)
    rows = docs.collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, removed_by_force([r.text.encode() for r in rows], 200), strict=True))
    assert sorted(tuple(r) for r in suffix.dedup(docs).drop("kept").collect()) == want
