import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import fulltext, search, vectors
from quillstone.plans import boolexpr as B
from quillstone.plans import sql
from quillstone.sources.store import Store
from quillstone.streaming import gate

T = B.Term
C1 = [
    (1, "upload file", "the user uploads large files to server", ""), (2, "download report", "uploading is not possible", "step upload upload"),
    (3, "Café naïve", "café 你好 $12345 re-upload", None), (4, "deprecated upload", "old b text", ""), (5, None, "orphan b c text", None), (6, "a b", "only b here", ""),
    (7, "a c", "x", ""), (8, "a", "y", ""), (9, "a b c", "z", ""),
]


@pytest.mark.parametrize(
    "given_, want",
    [
        ("a b or not c", B.Or((B.And((T("a"), T("b"))), B.Not(T("c"))))), ("a,b", B.And((T("a"), T("b")))), ("a!b", B.And((T("a"), B.Not(T("b"))))), ('"and" || x', B.Or((T("and"), T("x")))),
        ('"open end', T("open end")), ("（a）", T("a")), ("NOT NOT a", B.Not(B.Not(T("a")))),
    ],
)
def test_parse(given_, want):
    assert B.parse(given_) == want


@pytest.mark.parametrize("bad", ["a and", "(a", "a)", "", "  ", "or a", "()", "not"])
def test_parse_refuses(bad):
    with pytest.raises(ValueError):
        B.parse(bad)


def test_terms_and_keywords():
    assert B.positive_terms(B.parse("a and not not b or c")) == ["a", "c"]
    assert B.split_keywords(["a, b c,", "d"]) == ["a", "b c", "d"]
    assert B.from_keywords([]) is None and B.from_keywords(["x"], "all") == T("x") and B.from_keywords(["x", "y"], "all") == B.And((T("x"), T("y")))
    assert [B.searchable(B.parse(x)) for x in ("a", "a and not b", "a or not b", "not a", "not a and not b", "a and not not b")] == [True, True, False, False, False, False]


TREES = st.recursive(st.builds(T, st.sampled_from("abc")), lambda t: st.one_of(st.builds(B.Not, t), st.builds(B.And, st.tuples(t, t)), st.builds(B.Or, st.tuples(t, t))), max_leaves=8)


def shown(n):
    if isinstance(n, B.Term):
        return f'"{n.text}"'
    return f"not ({shown(n.child)})" if isinstance(n, B.Not) else "(" + (" and " if isinstance(n, B.And) else " or ").join(map(shown, n.children)) + ")"


@given(TREES)
def test_parse_round_trip(tree):
    assert B.parse(shown(tree)) == tree


@pytest.fixture(scope="module")
def index(spark):
    return fulltext.index(spark.createDataFrame(C1, "id long, name string, description string, stepsText string")).cache()


@pytest.fixture(scope="module")
def stored(spark, index, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    stage = Store(spark, f"{at}/p").stage(1)
    table = stage.put("postings", fulltext.postings(index, 8))
    dates = spark.createDataFrame([(i, f"2024-01-0{i}") for i in range(1, 10)], "id long, createdDate string")
    return fulltext.Postings(table, fulltext.stats_of(index), 8, dates)


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(name, description, stepsText, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, name, description, stepsText) VALUES (?, ?, ?, ?)", C1)
    return con


@pytest.mark.parametrize(
    "expression, match, field",
    [
        ("upload", '"upload"', "all"), ("upload", 'name : ("upload")', "name"), ("cafe", '"cafe"', "all"), ("你好", '"你好"', "all"), ('"$12345"', '"$12345"', "all"), ('"re-upload"', '"re-upload"', "all"),
        ('"$"', '"$"', "all"), ('"$" or upload', '("$" OR "upload")', "all"), ("a and not b", '("a") NOT "b"', "all"), ("a and not b and not c", '("a") NOT ("b") NOT "c"', "all"),
        ("upload or upload", '("upload" OR "upload")', "all"), ("upload or (large and orphan)", '("upload" OR ("large" AND "orphan"))', "all"), ("a and (b or c)", '"a" AND ("b" OR "c")', "all"),
        ('"user upload"', '"user upload"', "all"), ("a and not (b and not c)", '("a") NOT (("b") NOT "c")', "all"), ('a and not "$"', '("a") NOT "$"', "all"),
    ],
)
def test_equals_fts5(index, stored, fts, expression, match, field):
    want = fts.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ? ORDER BY bm25(f), rowid", (match,)).fetchall()
    for kind in (index, stored):
        got = [tuple(r) for r in fulltext.search(kind, B.parse(expression), field).collect()]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_compat_precedence(index, stored):
    for kind in (index, stored):
        assert [r.id for r in fulltext.search(kind, B.parse("a and not (b and not c)"), compat=True).collect()] == [8]


def test_postings_count_like_arrays(index, stored):
    for words in ("upload", "user upload", "b", "upload upload"):
        hits = {r.id: r.hits for r in fulltext.phrase_hits(stored.table, words, buckets=8).collect()}
        p = fulltext.stem.analyze_phrase(words)
        want = index.select("id", sum(fulltext.occurrences(F.col(f"t_{c}"), p) for c in fulltext.COLUMNS).alias("h")).where("h > 0")
        assert hits == {r.id: r.h for r in want.collect()}


def test_a_stored_index_reads_its_terms_only(stored):
    rows = stored.rows(["upload", "b"], fulltext.COLUMNS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters")[1].split("]")[0]
    assert "bucket" in pruned and "xxhash64" not in pruned and "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "")
    dated = fulltext.search(stored, B.parse("upload"), where=F.col("createdDate") >= "2024-01-03").collect()
    assert {r.id for r in dated} == {3, 4}


def test_search_in_sql(spark, index, stored):
    run = lambda q: sql.query(spark, q, {"items": spark.range(10).withColumnRenamed("id", "x")}, lambda e, f: fulltext.search(stored, B.parse(e), f, limit=None))
    got = run("SELECT id FROM fts_match('upload and not \"it''s\"') JOIN items ON x = id WHERE id <> 1 ORDER BY bm25")
    assert [r.id for r in got.collect()] == [2, 4, 3]
    assert run("WITH a AS (SELECT * FROM fts_match('upload', 'name')), b AS (SELECT * FROM fts_match('a')) SELECT count(*) AS n FROM a").first().n == 2


def test_no_cartesian_and_pushdown(spark, small):
    from quillstone.plans import catalog

    plan = catalog.QUERIES["like_or_not"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "ReadSchema" in plan
    assert "Cartesian" not in catalog.QUERIES["fts_and"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_fusion(spark):
    def leg(name, *ids):
        return spark.createDataFrame([(i, name, r) for r, i in enumerate(ids)], "id string, leg string, rank int")

    got = {r.id: (round(r.rrf, 4), r.via) for r in search.fuse(leg("fts", "x", "y").unionByName(leg("like", "y"))).collect()}
    assert got == {"y": (0.0325, "fts+like"), "x": (0.0164, "fts")}
    tie = search.fuse(leg("fts", "x").unionByName(leg("like", "y"))).orderBy(F.desc("rrf"), "first_leg", "first_rank")
    assert [r.id for r in tie.collect()] == ["x", "y"]


def test_chunks_and_embedding(spark):
    items = spark.createDataFrame([(1, "n" * 1600, "", ""), (2, None, "", None), (3, "name", "d", "")], "id long, name string, description string, stepsText string")
    rows = vectors.embed(vectors.chunk_rows(items), vectors.HashingEmbedder(8)).collect()
    assert sorted((r.chunk_id, len(r.text)) for r in rows) == [("1-0", 1500), ("1-1", 300), ("2-0", 0), ("3-0", 7)]


@pytest.mark.parametrize(
    "bad",
    [
        "DROP TABLE x", "WITH q AS (SELECT 1) INSERT INTO items SELECT * FROM q", "INSERT INTO items VALUES (1)", "SELECT TRANSFORM(id) USING 'uname -s' AS (b STRING) FROM items",
        "SELECT 1 WHERE EXISTS (SELECT TRANSFORM(id) USING 'cat' AS (b STRING) FROM items)", "WITH q AS (SELECT TRANSFORM(id) USING 'cat' AS (b STRING) FROM items) SELECT * FROM q",
        "SELECT reflect('java.lang.System', 'getProperty', 'x')", "SELECT upper(java_method('a', 'b'))", "SELECT * FROM items ORDER BY try_reflect('a', 'b')", "SELECT system.builtin.reflect('a', 'b')",
        "SELECT sum(id) OVER (PARTITION BY reflect('a', 'b')) FROM items", "SELECT transform(array(1), x -> java_method('a', x))", "SELECT * FROM items LATERAL VIEW explode(array(reflect('a', 'b'))) t AS z",
        "SELECT * FROM parquet.`/tmp/x`", "SELECT (SELECT count(*) FROM csv.`/etc/passwd`)", "SELECT * FROM IDENTIFIER('parquet.`/x`')", "SELECT IDENTIFIER('reflect')('a', 'b')", "SELECT * FROM other",
        "SELECT * FROM spark_catalog.default.items",
    ],
)
def test_read_only_sql(spark, bad):
    with pytest.raises(sql.ReadOnly):
        sql.check(spark, bad, {"items"})


@pytest.mark.parametrize(
    "good",
    [" with q as (select 1) select * from q", "SELECT (id, 1), replace('a', 'b', 'c'), array(1, 2) FROM Items WHERE id IN (SELECT id FROM items)", "SELECT * FROM range(3) AS drop_me", "SELECT transform(array(1), x -> x + 1) AS created"],
)
def test_plain_queries_pass(spark, good):
    sql.check(spark, good, {"items"})


def test_dates_in_sql(spark):
    got = sql.query(spark, "SELECT julianday(t) AS j, datetime(t) AS d FROM x", {"x": spark.createDataFrame([("2024-01-01T12:00:00.000+0000",)], "t string")}).first()
    assert tuple(got) == (2460311.0, "2024-01-01 12:00:00")


def test_gate():
    ready = gate.State("ready")
    go = lambda s=ready, need=True, offline=False, force=False, delta=0, lag=0: gate.check(s, need, offline, force, lambda: delta, lambda: lag, 200)
    assert [go(), go(offline=True, delta=None), go(force=True, delta=None), go(delta=200), go(need=False, lag=999)] == ["sync", "serve", "rebuild", "sync", "sync"]
    for action, kw in (("init", {"s": gate.State("missing"), "force": True}), ("rebuild", {"s": gate.State("corrupt"), "offline": True}), ("update", {"s": gate.State("ready", "stale")}), ("update", {"delta": 201}), ("update", {"delta": None}), ("update", {"lag": 201})):
        with pytest.raises(gate.Stop) as e:
            go(**kw)
        assert e.value.action == action


def test_analysis_of_whole_batches(spark):
    from quillstone.functions import stem

    rows = [(0, ["things", "running", "things"]), (1, None), (2, []), (3, ["Caf\u00e9s", "x", None]), (4, ["ties"])]
    df = spark.createDataFrame(rows, "i int, w array<string>").coalesce(1)
    got = {r.i: r.s for r in df.select("i", stem.analyze(F.col("w")).alias("s")).collect()}
    assert got == {0: ["thing", "run", "thing"], 1: None, 2: [], 3: [stem.analyzed("Caf\u00e9s"), "x", None], 4: ["ti"]}


def test_a_phrase_is_met_without_a_row_for_each_place(spark, stored):
    from quillstone.operators import fulltext

    words = "a b a a b c a"
    idx = fulltext.index(spark.createDataFrame([(1, words, "a b"), (2, "b a", "a"), (3, None, "a a a")], "id long, name string, description string").withColumn("stepsText", F.lit(None).cast("string")), stemmed=False)
    table = fulltext.postings(idx, 8)
    for phrase, want in (("a b", {1: 3}), ("a a", {1: 1, 3: 2}), ("a a b", {1: 1}), ("b a a b c a", {1: 1}), ("c b", {})):
        found = fulltext.phrase_hits(table, phrase, buckets=8, stemmed=False)
        assert {r.id: r.hits for r in found.collect()} == want
        assert "explode(" not in found._jdf.queryExecution().executedPlan().toString()
