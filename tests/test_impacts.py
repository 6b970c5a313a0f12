"""Searches that end early give what the full way gives, and read less."""

import random
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.operators import fulltext, impacts
from quillstone.plans import boolexpr
from quillstone.plans.catalog import items
from quillstone.sources.store import Store

from .test_engine import Site, item


def answer(idx, expression, k, stemmed=False):
    return [(r.id, round(r.bm25, 12)) for r in fulltext.search(idx, boolexpr.parse(expression), limit=k, stemmed=stemmed).collect()]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """3,000 items of words with falling frequency; equal texts, so that scores tie; items without any word."""
    dice = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(dice.choices(words, weights, k=dice.choice([1, 3, 3, 8, 40, 120])))) for i in range(2900)]
    rows += [(i, "w5 w9") for i in range(2900, 2950)] + [(i, "") for i in range(2950, 3000)]
    df = spark.createDataFrame(rows, "id long, description string").withColumns({"name": F.lit(None).cast("string"), "stepsText": F.lit("w0")})
    stage = Store(spark, str(tmp_path_factory.mktemp("early"))).stage(1)
    idx = stage.put("fts", fulltext.index(df, stemmed=False))
    size = fulltext.size_of(idx)
    mean = size["fts_length"] / size["fts_rows"]
    made = stage.put("impacts", impacts.impacts(idx, mean, 8))
    lv = stage.put("levels", impacts.levels(made))
    stats = fulltext.stats_row(spark, size["fts_rows"], size["fts_length"])
    return idx, fulltext.Postings(stage.put("postings", fulltext.postings(idx, 8)), stats, 8, None, impacts.Early(made, lv, idx, mean, 0))


@pytest.mark.parametrize("expression", ["w1", "w1 or w2", "w0 or w1 or w2", "w3 or w30 or w50", "w5 or w9", "w5 or w5 or w9", "w40 or (w41 or nothing)", "w0", "nothing or never", "w59 or w0", "w2 or w3 or w4 or w5 or w6 or w7 or w8"])
@pytest.mark.parametrize("k", [1, 10, 200])
def test_early_equals_full(texts, expression, k):
    idx, early = texts
    assert answer(early, expression, k) == answer(idx, expression, k)


def test_little_is_read(texts):
    idx, early = texts
    size = early.stats.first()
    ids, n = early.early.candidates({"w3": 1, "w30": 1, "w50": 1}, size.rows_in_index, size.mean_length, 10, 8)
    any_of = idx.where(F.arrays_overlap("t_description", F.array(*map(F.lit, ("w3", "w30", "w50"))))).count()
    assert ids.count() < any_of / 4 and n["w50"] == idx.where(F.array_contains("t_description", "w50")).count()
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(impact" in plan and "PartitionFilters: [" in plan


@pytest.mark.parametrize("shift", [0.5, 0.9, 1.2, 3.0])
def test_a_mean_that_moved(spark, texts, shift):
    idx, early = texts
    old = early.early
    moved = fulltext.Postings(early.table, early.stats, 8, None, impacts.Early(impacts.impacts(idx, old.mean * shift, 8), impacts.levels(impacts.impacts(idx, old.mean * shift, 8)), idx, old.mean * shift, 0))
    for expression in ("w1 or w7", "w3 or w30 or w50"):
        assert answer(moved, expression, 10) == answer(idx, expression, 10)


def test_postings_equal_exploding(spark, small):
    idx = fulltext.index(items(spark, small), stemmed=False)
    got = {(r.term, r.id, r.field): (r.dl, r.n, tuple(r.positions)) for r in fulltext.postings(idx, 16).collect()}
    want = {}
    for r in idx.collect():
        for c in fulltext.COLUMNS:
            for at, t in enumerate(r[f"t_{c}"]):
                want.setdefault((t, r.id, c), (r.dl, []))[1].append(at)
    assert got == {k: (dl, len(p), tuple(p)) for k, (dl, p) in want.items()}
    assert "Exchange" not in fulltext.postings(idx, 16)._jdf.queryExecution().executedPlan().toString()
    assert fulltext.postings(idx.where("false"), 16).count() == 0


def test_updates_keep_levels(spark, tmp_path):
    site = Site([item(i, "2024-01-01T00:00:00.000+0000", name=f"word{i % 9} thing{i}", description=f"<p>{'large ' * (i % 7)}file</p>") for i in range(1, 61)])
    e = Engine(spark, str(tmp_path / "root"), site.base)
    e.build(5, with_vectors=False)
    site.items[2] = item(3, "2024-02-01T00:00:00.000+0000", name="renamed", description="<p>" + "large " * 9 + "</p>")
    assert e.sync(5, with_vectors=False) == "updated"
    site.items = site.items[:50]
    assert e.reconcile(5)["deleted"] == 10
    net = {(r.term, r.level): r.n for r in e.store.read(5, "levels").groupBy("term", "level").agg(F.sum("n").alias("n")).collect() if r.n}
    own = {(r.term, r.level): r.n for r in impacts.levels(e.store.read(5, "impacts")).collect()}
    assert net == own
    stored = replace(e.postings(5), early=replace(e.postings(5).early, worth=0))
    for expression in ("large or word1", "renamed or thing"):
        assert answer(stored, expression, 5, True) == answer(e.store.read(5, "fts"), expression, 5, True)


def test_an_index_is_written_in_sorted_runs_without_a_shuffle(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("w"), F.col("id") % 7, F.lit(" w"), F.col("id") % 900, F.lit(" w1")).alias("description"), F.lit(None).cast("string").alias("name"), F.lit("x").alias("stepsText"))
    stage = Store(spark, str(tmp_path)).stage(1)
    idx = stage.put("fts", fulltext.index(df))
    stage.put("postings", fulltext.postings(idx, 8))
    made = stage.put("impacts", impacts.impacts(idx, 4.0, 8))
    runs = impacts.level_runs(made)
    assert not any("Exchange" in x._jdf.queryExecution().executedPlan().toString() for x in (runs, impacts.impacts(idx, 4.0, 8)))
    stage.put("levels", runs)
    count = lambda x: {(r.bucket, r.term, r.level): r.n for r in x.groupBy("bucket", "term", "level").agg(F.sum("n").alias("n")).collect()}
    assert count(stage.read("levels")) == count(impacts.levels(made))
    for part in fulltext.postings(idx, 8).where("field = 'description'").select("term").rdd.glom().collect():
        assert [r.term for r in part] == sorted(r.term for r in part)  # a batch each
    for table in ("postings", "impacts", "levels"):
        rows = stage.read(table)
        files = rows.groupBy(F.input_file_name(), F.spark_partition_id()).agg(F.countDistinct("bucket").alias("n")).collect()
        assert all(r.n == 1 for r in files) and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert not list((tmp_path / "project_id=1").glob("*/_temp/*"))  # nothing is written twice


def test_turning_around_needs_little_memory():
    """A run's working arrays take few bytes a token, and what it gives out comes in parts."""
    rng = np.random.default_rng(7)
    lists = [[f"w{x}" for x in rng.integers(0, 50_000, n)] for n in rng.integers(0, 2_000, 400)]
    batch = pa.record_batch([pa.array(range(400)), pa.array([len(x) for x in lists]), pa.array([[]] * 400, pa.list_(pa.string())), pa.array(lists), pa.array([None] * 400, pa.list_(pa.string()))], ["id", "dl", *(f"t_{c}" for c in fulltext.COLUMNS)])
    total = sum(map(len, lists))
    tracemalloc.start()
    for _ in fulltext.turned(batch):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    out = list(fulltext.turned(batch))
    assert len(out) > 1 and max(x.num_rows for x in out) <= fulltext.OUT
    rows = pa.Table.from_batches(out).to_pylist()
    want = {}
    for i, words in enumerate(lists):
        for at, w in enumerate(words):
            want.setdefault((w, i), []).append(at)
    assert [(r["term"], r["id"], r["positions"]) for r in rows] == [(w, i, p) for (w, i), p in sorted(want.items())]
    assert all(r["n"] == len(r["positions"]) and r["dl"] == len(lists[r["id"]]) and r["field"] == "description" for r in rows)
    assert most < 48 * total
