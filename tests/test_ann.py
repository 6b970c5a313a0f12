"""The approximate index against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.operators import ann, vectors
from quillstone.plans import catalog
from quillstone.sources.store import Store

from .test_engine import Site, item


def true_neighbours(rows, k):
    x = np.array([e for _, e in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - x @ x.T
    return far, np.argsort(far, axis=1, kind="stable")[:, :k]


def test_recall_over_the_table(spark, small):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() if r.embedding)
    far, best = true_neighbours(rows, 10)
    ids = [i for i, _ in rows]
    got = {}
    for r in catalog.QUERIES["knn_index"](spark, small).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.distance
    assert set(got) == {i for i in ids if i % 20 == 0} and all(len(g) == 10 for g in got.values())
    want = {ids[n]: {ids[m] for m in best[n]} for n in range(len(ids))}
    assert np.mean([len(want[i] & set(g)) / 10 for i, g in got.items()]) >= 0.95
    place = {i: n for n, i in enumerate(ids)}
    assert all(abs(far[place[i], place[j]] - d) < 0.0011 for i, g in got.items() for j, d in g.items())


@pytest.fixture(scope="module")
def clustered(spark):
    """Clusters of vectors, one of them a third of all, and vectors without a direction."""
    dice = np.random.default_rng(5)
    centres = dice.standard_normal((40, 32))
    own = np.where(dice.random(6000) < 1 / 3, 0, dice.integers(0, 40, 6000))
    x = centres[own] + 0.15 * dice.standard_normal((6000, 32))
    rows = [(i, i % 500, v.tolist()) for i, v in enumerate(x)]
    rows += [(6000, 1, None), (6001, 1, [0.0] * 32), (6002, 2, [float("nan")] * 32), (6003, 2, [1.0] * 7)]
    return rows, spark.createDataFrame(rows, "chunk_id long, item_id long, embedding array<float>")


def test_clustered_data_need_few_lists(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 50)
    rows, df = clustered
    model = ann.fit(df)
    assert len(model.centroids) == 64 and model.probes <= 16 and model.recall >= ann.RECALL
    store = Store(spark, str(tmp_path))
    store.write(1, {"ann": ann.encode(df, model), "ann_model": model.rows(spark)}, {})
    again = ann.Model.read(store.read(1, "ann_model"))
    assert np.array_equal(again.centroids, model.centroids) and np.array_equal(again.codebooks, model.codebooks) and again.probes == model.probes
    table = store.read(1, "ann")
    assert table.count() == len(rows) and table.where("list = -1").count() == 4
    _, best = true_neighbours([(i, v) for i, _, v in rows[:6000]], 10)
    hits = 0
    for i in range(0, 6000, 600):
        found = ann.nearest(table, model, rows[i][2], 10, None).collect()
        hits += len({r.chunk_id for r in found} & set(best[i].tolist()))
        exact = {r.chunk_id: r.distance for r in vectors.nearest(df.where("chunk_id < 6000"), rows[i][2], 10, None).collect()}
        assert all(abs(exact[r.chunk_id] - r.distance) < 1e-9 for r in found if r.chunk_id in exact)
    assert hits >= 95
    # only probed lists are read
    plan = ann.candidates(table, model, rows[0][2], 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list#\d+ IN", plan) and "embedding" not in re.search("ReadSchema: .*", plan)[0]
    queries = df.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {}
    for r in ann.nearest_all(table, model, queries, 10).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert len(got) == 300 and np.mean([len(g & set(best[i].tolist())) / 10 for i, g in got.items()]) >= 0.95


def test_an_index_of_nothing(spark, clustered):
    _, df = clustered
    for rows in (df.where("false"), df.where("chunk_id >= 6000 AND chunk_id < 6003")):
        model = ann.fit(rows)
        table = ann.encode(rows, model)
        assert table.where("list >= 0").count() == 0 and ann.nearest(table, model, [1.0], 5, None).count() == 0


def test_an_engine_keeps_its_index(spark, tmp_path):
    site = Site([item(i, "2024-01-01T00:00:00.000+0000", name=f"word{i % 9} thing{i}") for i in range(1, 101)])
    e = Engine(spark, str(tmp_path / "root"), site.base)
    e.build(5)
    with pytest.raises(ValueError, match="no vector index"):
        e.semantic(5, "word1", approximate=True, offline=True)
    assert e.index_vectors(5)["recall"] >= 0.9
    site.items[2] = item(3, "2024-02-01T00:00:00.000+0000", name="quite other words here")
    assert e.sync(5) == "updated"
    text = e.store.read(5, "chunks").where("item_id = 3").first().text
    exact, near = ([tuple(r) for r in e.semantic(5, text, top=1, offline=True, approximate=a).collect()] for a in (False, True))
    assert near == exact and near[0][0] == 3 and near[0][4] == 1.0
    assert e.store.read(5, "ann").count() == e.store.read(5, "chunks").count() == 100
    site.items = site.items[:50]
    assert e.reconcile(5)["deleted"] == 50 and e.store.read(5, "ann").count() == 50
