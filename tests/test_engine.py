import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from vecloom import suite
from vecloom.functions import fulltext
from vecloom.functions import vectors as V
from vecloom.operators import predicates as P
from vecloom.operators.indexes import kinds
from vecloom.plans.query import Query
from vecloom.sources import files
from vecloom.sources.catalog import Catalog
from vecloom.streaming import ingest
from vecloom.types import ColumnDef

SF = "/root/testdata/sf0.001"


def norm(v):
    return ("nan" if v != v else repr(v)) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", ["select_star", "filter_and_or_not", "filter_not_null_two_valued", "filter_in_subquery", "agg_count_distinct", "aggregate_after_limit", "topk", "fn_div", "dist_cosine", "dist_chisquared", "knn_filtered", "index_vaf_euclidean", "index_vaf_farthest", "fulltext_not", "stats_vector", "fn_intdiv", "vec_mul", "dist_complex_innerproduct32", "agg_sum_complex", "index_btree_range", "index_btree_uq", "index_lucene_equals", "filter_match_index", "fulltext_and", "index_lsh_recall", "match_score", "topk_order", "dml_update", "tx_conflict", "dump_restore_csv", "entity_statistics", "sql_cosine", "sql_passthrough_window"])
def test_suite_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in "nation region orders customer part lineitem documents embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = suite.QUERIES[name](spark, SF)
    got = con.execute(suite.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(norm(x) for x in r) for r in got.fetchall()) == sorted(tuple(norm(r[c]) for c in names) for r in df.collect())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.create_schema("S")
    c.create_entity("s.t", [ColumnDef("id", "LONG", nullable=False, auto_increment=True), ColumnDef("name", "STRING", nullable=False), ColumnDef("x", "INT"), ColumnDef("v", "FLOAT_VECTOR", 4)])
    return c


def rows(n):
    return [{"name": f"n{k}", "x": k if k % 3 else None, "v": [float(k), 1.0, 0.0, -1.0]} for k in range(n)]


def test_definition_and_manipulation(catalog):
    t = catalog.entity("s.t").insert(rows(10)).insert(rows(5))
    assert t.count() == t.frame().count() == 15 and [r.id for r in t.frame().orderBy("id").collect()] == list(range(15))
    t, n = t.update(P.compare("name", "=", "n1"), x=99)
    assert n == 2 and t.frame().where("x = 99").count() == 2
    t, n = t.delete(P.negate(P.compare("x", ">", 2)))
    assert n == 15 - t.count() and t.frame().where("x IS NULL").count() == 0
    assert catalog.entity("s.t", 1).frame().count() == 10  # readers keep their version
    with pytest.raises(Exception, match="null"):
        t.insert([{"name": None}])
    with pytest.raises(Exception, match="dimension"):
        t.insert([{"name": "a", "v": [1.0]}])
    catalog.truncate_entity("s.t")
    assert catalog.entity("s.t").count() == 0
    assert catalog.list_entities("s").collect()[0].dbo == "s.t" and catalog.entity("s.t").about().count() == 5
    catalog.drop_entity("s.t")
    catalog.drop_schema("s")
    assert catalog.list_schemas().count() == 0


def test_transactions(catalog):
    t = catalog.begin()
    t.stage("s.t", "insert", rows(3))
    assert catalog.entity("s.t").count() == 0 and t.entity("s.t").count() == t.entity("s.t").frame().count() == 3 and catalog.list_locks().count() == 1
    t.stage("s.t", "delete", ("name", "=", "n1"))
    t.commit()
    assert [r.name for r in catalog.entity("s.t").frame().orderBy("id").collect()] == ["n0", "n2"]
    u = catalog.begin()
    u.stage("s.t", "insert", rows(3))
    u.rollback()
    assert catalog.entity("s.t").count() == 2 and catalog.list_transactions().count() == 2 and catalog.list_locks().count() == 0
    stale = catalog.entity("s.t")
    catalog.entity("s.t").insert(rows(1))
    with pytest.raises(Exception):  # noqa: B017  another writer was first
        stale.insert(rows(1))
    with pytest.raises(ValueError, match="cannot write"):
        catalog.begin(read_only=True).stage("s.t", "delete")
    killed = catalog.begin()
    killed.stage("s.t", "delete")
    killed.kill()
    with pytest.raises(ValueError, match="not open"):
        killed.commit()


def test_commit_is_all_or_nothing(spark, catalog):
    catalog.create_entity("s.u", [ColumnDef("x", "INT")])
    catalog.entity("s.t").insert(rows(2))
    t = catalog.begin()
    assert t.entity("s.t").count() == 2
    catalog.entity("s.t").insert(rows(1))  # after the transaction has read it
    assert t.entity("s.t").count() == 2
    t.stage("s.u", "insert", [{"x": 1}])
    t.stage("s.t", "update", None, x=5)
    with pytest.raises(ValueError, match="committed first"):
        t.commit()
    assert catalog.entity("s.u").count() == 0 and catalog.entity("s.t").count() == 3 and catalog.entity("s.t").frame().where("x = 5").count() == 0
    # a session that dies between locking and its record: nobody sees its version, nobody overtakes it, until it is released
    dead = catalog.begin()
    dead.stage("s.u", "insert", [{"x": 2}])
    e = dead.pinned["s.u"]
    catalog._write(e.meta | {"transaction": dead.id}, "s", "u", "versions", f"{e.version + 1:012d}.json")
    other = Catalog(spark, catalog.root)
    assert other.entity("s.u").count() == 0 and other.list_locks().collect()[0].txid == dead.id
    with pytest.raises(Exception):  # noqa: B017
        other.entity("s.u").insert([{"x": 3}])
    other.release(dead.id)
    assert other.entity("s.u").insert([{"x": 3}]).count() == 1


def test_rows_are_computed_once_and_only_files_with_hits_are_rewritten(catalog, spark):
    t = catalog.entity("s.t").insert(spark.range(50).select(F.concat(F.lit("n"), F.rand().cast("string")).alias("name"), F.lit(1).alias("x")).repartition(3))
    assert sorted(r.id for r in t.frame().collect()) == list(range(50))
    t = t.insert([{"name": "other", "x": 2}])
    files_before = t.meta["files"]
    t, n = t.update(("x", "=", 2), x=3)
    assert n == 1 and t.meta["files"][0] == files_before[0] and t.meta["files"][1] != files_before[1]
    t, n = t.delete(("x", "=", 77))
    assert n == 0 and t.count() == 51


def test_index_lifecycle(spark, catalog):
    t = catalog.entity("s.t").insert(rows(60))
    t.create_index("vaf", "near", "v", marks_per_dimension=8)
    q = t.query().nearest("v", [7.2, 1.0, 0.0, -1.0], "euclidean", 3, "id")
    assert "1. vaf:near" in q.explain() and [r.name for r in q.frame().collect()] == ["n7", "n8", "n6"]
    assert [r.name for r in q.hint(use_index=False).frame().collect()] == ["n7", "n8", "n6"]
    again = Catalog(spark, catalog.root).entity("s.t")  # another session finds it
    assert "1. vaf:near" in again.query().nearest("v", [7.2, 1.0, 0.0, -1.0], "euclidean", 3, "id").explain()
    t = t.insert(rows(1))
    assert not t.indexes()[0].clean() and "vaf:near" not in t.query().nearest("v", [1.0] * 4, "euclidean", 3, "id").explain()
    assert t.rebuild_index("near").clean() and t.about_index("near").count() >= 3
    t.drop_index("near")
    assert not t.indexes() and not again.indexes()
    with pytest.raises(ValueError, match="unique"):
        t.create_index("btree_uq", "u", "name")


def test_filters_and_texts_choose_their_indexes(catalog):
    t = catalog.entity("s.t").insert([{"name": f"word{k % 7} and cat{'s' * (k % 2)}", "x": k, "v": [float(k), 0.0, 0.0, 0.0]} for k in range(200)])
    t.create_index("btree", "byx", "x")
    t.create_index("lucene", "text", "name")
    t.create_index("vaf", "near", "v")
    q = t.query()
    for f, kind in [(("x", "=", 7), "btree:byx"), (P.isin("x", [3, 400, 9]), "btree:byx"), (P.between("x", 20, 10), "btree:byx"), (P.compare("x", "<", 5) & P.compare("name", "!=", "x"), "btree:byx"), (P.match("name", "word3 -cats"), "lucene:text"), (("name", "=", "word3 and cats"), "lucene:text"), (P.like("name", "word3 and c%"), "lucene:text")]:
        one = q.where(f)
        assert f"1. {kind}" in one.explain(), f
        assert sorted(r.x for r in one.frame().collect()) == sorted(r.x for r in one.hint(use_index=False).frame().collect())
        assert one.frame().count() > 0
    assert "btree" not in q.where(P.compare("x", "=", 7) | P.compare("x", "=", 8)).explain()
    scored = q.fulltext("name", "word3 cats")
    assert "1. lucene:text" in scored.explain()
    near = lambda frame: sorted((r.id, round(r.score, 9)) for r in frame.collect())
    assert near(scored.frame()) == near(scored.hint(use_index=False).frame())
    # neighbours among the matches only: the vector index knows nothing of them
    both = scored.nearest("v", [50.0, 0.0, 0.0, 0.0], "euclidean", 4, "id").hint(use_index="vaf")
    assert [r.x for r in both.frame().collect()] == [r.x for r in both.hint(use_index=False).frame().collect()] and "score" in both.frame().columns
    plans = q.where(("x", "=", 7)).explain_plans().collect()
    assert plans[0].rank == 1 and plans[0].plan == "btree:byx" and {p.plan for p in plans} == {"scan", "btree:byx"}
    assert q.count().frame().first()[0] == 200 and "LocalTableScan" in q.count().explain() or "ExistingRDD" in q.count().explain()
    t.analyze()
    assert t.distinct()["x"] > 150 and {r.key for r in t.statistics().where("dbo LIKE '%.v'").collect()} >= {"min", "max", "sum", "mean"}


def test_analysers(catalog):
    t = catalog.entity("s.t").insert([{"name": n} for n in ("The Cats sat", "a cat", "Robert B-52", "rupert")])
    for kind, query, want in [("english", "cats", 2), ("whitespace", "B-52", 1), ("soundex", "rupert", 2), ("simple", "b", 1), ("standard", "52", 1)]:
        t.create_index("lucene", kind, "name", analyzer_type=kind)
        assert t.index(kind).scores(query, "score").count() == want, kind
        t.drop_index(kind)


def test_postings_are_counted_where_texts_are_read(spark, tmp_path, monkeypatch):
    texts = [("a b a", 1), (None, 2), ("", 3), ("-- !", 4), ("b " * 300 + "ä", 5), ("a b a", 6), ("Ä İ ß 漢字 x1", 7), *((f"w{k % 7} a", 10 + k) for k in range(90))]
    df = spark.createDataFrame(texts, "text string, id int").repartition(3)
    plan = fulltext.postings(df, "id", "text")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") <= 1 and "Aggregate" not in plan and "rangepartitioning" not in plan and "Sort [term" in plan
    words = df.select("id", fulltext.tokens(F.col("text")).alias("w"))
    want = sorted((r.t, r.id, r.n, r["count"]) for r in words.select("id", F.size("w").alias("n"), F.explode("w").alias("t")).groupBy("t", "id", "n").count().collect())
    for size in (1 << 21, 5):
        monkeypatch.setattr(fulltext, "RUN", size)
        index = kinds.build(df, "lucene", "i", "text", "id", f"file://{tmp_path}/{size}")
        for found in (index, kinds.load(spark, f"file://{tmp_path}/{size}"), kinds.build(df, "lucene", "i", "text", "id")):
            assert found.table.dtypes == [("term", "string"), ("id", "int"), ("len", "int"), ("tf", "bigint")]
            rows = [tuple(r) for r in found.table.collect()]
            assert sorted(r for r in rows if r[0][0] != "\x00") == want
            assert sorted(r[1] for r in rows if r[0][0] == "\x00") == sorted(k for t, k in texts if t is not None)
            assert found.model["texts"] == 96 and abs(found.model["mean"] - (3 + 0 + 0 + 301 + 3 + 5 + 180) / 96) < 1e-9
    twice = kinds.build(df.union(df), "lucene", "i", "text", "id")
    assert sorted(tuple(r) for r in twice.lookup(["a", "b"]).collect()) == sorted((t, k, n, 2 * tf) for t, k, n, tf in want if t in "ab")
    empty = kinds.build(df.where("id < 0"), "lucene", "i", "text", "id")
    assert empty.table.count() == 0 and empty.model["texts"] == 0 and empty.scores("a", "score").count() == 0


@pytest.mark.parametrize("name", ["index_lucene_postings", "fulltext_index_not", "filter_match_index", "index_lucene_equals"])
def test_queries_on_many_runs_equal_duckdb(spark, monkeypatch, name):
    """Terms have rows in many runs of a segment."""
    monkeypatch.setattr(fulltext, "RUN", 1000)
    monkeypatch.setattr(suite, "_stored", {})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        test_suite_equals_duckdb(spark, name)
        (index,) = suite._stored.values()
        assert index.model["unique"] and index.table.inputFiles()
        assert spark.read.parquet(*index.table.inputFiles()).groupBy("term").count().where("count > 5").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_match_that_postings_decide_reads_no_text(spark, tmp_path):
    df = spark.createDataFrame([("that is", 1, 1), ("that when", 2, 2), (None, 3, 3), ("berlin", 4, 4), ("that", 5, 4), ("", 6, 0)], "text string, id int, x int")
    df.write.parquet(f"{tmp_path}/t")
    for key, read in (("id", False), ("x", True)):  # x: two rows of one key, of which one matches
        df = spark.read.parquet(f"{tmp_path}/t")
        q = Query(suite._Indexed(df, kinds.build(df, "lucene", "i", "text", key, f"file://{tmp_path}/{key}")))
        for query, also, want in (("that -when", F.lit(True), [1, 5]), ("that ber* -when", F.col("id") < 5, [1, 4]), ("-when", F.lit(True), []), ("+that +when", F.lit(True), [2])):
            one = q.where(P.match("text", query) & P.of(also)).select("id")
            assert sorted(r.id for r in one.frame().collect()) == want == sorted(r.id for r in one.hint(use_index=False).frame().collect())
            assert ("text:string" in one.frame()._jdf.queryExecution().executedPlan().toString()) == read or not want


def test_background_rebuild(catalog):
    t = catalog.entity("s.t").insert(rows(30))
    t.create_index("btree", "byx", "x")
    t.insert(rows(2))
    work = ingest.Rebuilder(catalog)
    assert work.once() == ["s.t.byx"] and catalog.entity("s.t").index("byx").clean() and work.once() == [] and not work.failed


def test_functions_are_chosen_by_their_arguments(spark):
    df = spark.createDataFrame([(7, 2, -7, 1.5, [1.0, 2.0], [True, False], {"re": 3.0, "im": 4.0})], "a int, b int, c int, r double, v array<double>, f array<boolean>, z struct<re:double,im:double>")
    q = Query(df)
    one = lambda name, *args: q.function(name, *args, alias="y").frame().first().y
    assert one("div", "a", "b") == 3 and one("div", "c", "b") == -3 and one("div", "a", 0) is None and one("div", "a", "r") == 7 / 1.5
    assert one("add", "v", "v") == [2.0, 4.0] and one("add", "a", "b") == 9 and one("mul", "v", "r") == [1.5, 3.0] and one("sub", "v", [1.0, 1.0]) == [0.0, 1.0]
    assert one("hamming", "f", [True, True]) == 1.0 and one("abs", "z") == 5.0 and tuple(one("conjugate", "z")) == (3.0, -4.0) and tuple(one("inverse", "z")) == (3 / 25, -4 / 25)
    assert tuple(one("mul", "z", 1j)) == (-4.0, 3.0) and one("sqrt", "v") == [1.0, math.sqrt(2)] and one("ln", 0) == -math.inf and one("pow", "r", 2) == 2.25
    for name, args in [("euclidean", ("a", "v")), ("haversine", ("z", "z")), ("nothing", ("a",))]:
        with pytest.raises(ValueError, match="no function"):
            one(name, *args)
    V.define("twice", (("num",), lambda x: x * 2))
    assert one("twice", "a") == 14


@pytest.mark.parametrize(("form", "end"), [("json", ""), ("csv", ".zip"), ("parquet", "")])
def test_dump_and_restore(catalog, tmp_path, form, end):
    t = catalog.entity("s.t").insert([*rows(4), {"name": 'q"uo,te', "x": 1, "v": [math.inf, 0.0, 1.0, 2.0]}])
    files.dump(t, f"file://{tmp_path}/dump{end}", form)
    back = files.restore(catalog, f"file://{tmp_path}/dump{end}", "other.u")
    assert sorted(map(str, back.frame().drop("_tid", "id").collect())) == sorted(map(str, t.frame().drop("_tid", "id").collect()))


def test_dump_and_restore_of_a_schema(catalog, tmp_path):
    catalog.entity("s.t").insert(rows(4))
    catalog.create_entity("s.u", [ColumnDef("b", "BOOLEAN_VECTOR", 2), ColumnDef("z", "COMPLEX32_VECTOR", 1)])
    catalog.entity("s.u").insert([{"b": [True, False], "z": [(1.0, 2.0)]}]).analyze()
    assert catalog.entity("s.u").statistics().where("key IN ('true', 'sum_im')").count() == 2
    files.dump_schema(catalog, "s", f"file://{tmp_path}/all", "parquet")
    assert [e.name for e in files.restore_schema(catalog, f"file://{tmp_path}/all", "r")] == ["r.t", "r.u"]
    assert catalog.entity("r.t").count() == 4 and catalog.entity("r.u").frame().first().b == [True, False]


def test_streaming_append(spark, catalog, tmp_path):
    spark.createDataFrame(rows(6), "name string, x int, v array<float>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("name string, x int, v array<float>").parquet(f"{tmp_path}/in")
    ingest.append(stream, catalog, "s.t", f"{tmp_path}/cp").awaitTermination()
    assert catalog.entity("s.t").count() == 6


@pytest.mark.parametrize(("kind", "least"), [("vaf", 1.0), ("pq", 0.9), ("ivfpq", 0.9)])
def test_recall(spark, kind, least):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (1500, 1)) * 1.0 + rng.uniform(-1, 1, (1500, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    q = x[3].tolist()
    index = kinds.build(df, kind, "i", "v", key="id")
    got = {r.id for r in index.candidates(df, q, "euclidean", 10).withColumn("d", V.euclidean("v", q)).orderBy("d", "id").limit(10).collect()}
    want = {r.id for r in df.withColumn("d", V.euclidean("v", q)).orderBy("d", "id").limit(10).collect()}
    assert len(got & want) / 10 >= least


@pytest.mark.parametrize(("kind", "function"), [("pq", "euclidean"), ("ivfpq", "euclidean"), ("lsh", "cosine")])
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_embeddings(spark, kind, function, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    index = kinds.build(df, kind, "i", "embedding", key="vec_id")
    index.table = index.table.cache()
    x = np.array([r.embedding for r in df.orderBy("vec_id").limit(200).collect()], float)
    found = []
    for q in [suite.POINT, *x[::50].tolist()]:
        near = lambda t: {r.vec_id for r in t.withColumn("d", V.lookup(function)("embedding", q)).orderBy("d", "vec_id").limit(10).collect()}  # noqa: B023, E731
        found.append(len(near(index.candidates(df, q, function, 10)) & near(df)) / 10)
    index.table.unpersist()
    print(kind, sf, found[0], np.mean(found[1:]))
    assert found[0] >= 0.9 and np.mean(found[1:]) >= 0.9


def test_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], None), (2, [1.0, 1.0], 5)], "id int, v array<double>, x int")
    assert math.isnan(df.select(V.cosine("v", [1.0, 0.0])).first()[0]) and math.isnan(df.select(V.chisquared("v", [0.0, 0.0])).first()[0])
    assert Query(df).where(P.negate(P.compare("x", "=", 4))).frame().count() == 2
    assert Query(df).where(P.like("x", "a_", compat=True)).frame().count() == 0
    assert Query(df).count_distinct("x").frame().first()[0] == 2
    assert Query(df).order_by(("x", "desc"), "id").limit(1).select("id").frame().first()[0] == 2
    assert df.select(V.intdiv(F.lit(-7), F.lit(2)), V.intdiv(F.lit(1), F.lit(0))).first()[:] == (-3, None)
    with pytest.raises(ValueError, match="alias"):
        Query(df).select(("*", "y")).frame()
    with pytest.raises(ValueError, match="distinct names"):
        Query(df).select("id", ("x", "id")).frame()
    with pytest.raises(ValueError, match="dimension"):
        ColumnDef("v", "FLOAT_VECTOR").field()
