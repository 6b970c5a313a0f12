"""Snapshots of parts and retired keys against a dictionary, and what an update writes."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.sources import store as store_
from quillstone.sources.store import Store

from .test_engine import Site, edge, item


def files_of(store, project):
    import os

    home = store._home(project)
    return {os.path.relpath(os.path.join(d, f), home): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(home) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("many, share", [(2, 100.0), (8, 0.0), (100, 100.0)])
def test_parts_equal_a_dictionary(spark, tmp_path, monkeypatch, many, share):
    monkeypatch.setattr(store_, "MANY_PARTS", many)
    monkeypatch.setattr(store_, "CHANGED_SHARE", share)
    dice, store, want = random.Random(many), Store(spark, str(tmp_path)), {i: "0" for i in range(50)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, v string")
    store.write(1, {"t": frame(want), "other": frame({1: "x"})}, {})
    other = store.manifest(1)["tables"]["other"]
    for n in range(1, 7):
        new = {dice.randrange(60): str(n) for _ in range(dice.randint(1, 6))}
        gone = {dice.randrange(60) for _ in range(3)} - set(new)
        stage = store.stage(1)
        stage.retire(spark.createDataFrame([(i,) for i in [*new, *gone, None]], "id long"), "t")
        stage.add("t", frame(new))
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert {r.id: r.v for r in stage.read("t").collect()} == want
        stage.commit({"n": n})
        assert {r.id: r.v for r in store.read(1, "t").collect()} == want
    said = store.manifest(1)["tables"]
    assert said["other"] == other and store.read(1, "other").count() == 1
    assert (len(said["t"]["parts"]) == 7) == (many == 100)
    # what no version in force names is gone
    named = {f for v in store._commits(1) for f in store_._folders(store.manifest(1, v))}
    assert {f.rsplit("/", 1)[0] for f in files_of(store, 1)} <= named and len(store._commits(1)) == 2


def test_edges_go_with_either_end(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(1, {"relationships": spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, None, 5)], "id long, fromItem long, toItem long")}, {})
    stage = store.stage(1)
    stage.retire(spark.createDataFrame([(2,)], "id long"), "relationships", "none of the tables")
    stage.commit({})
    assert sorted(r.id for r in store.read(1, "relationships").collect()) == [3, 4]


def test_filters_reach_the_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(1, {"t": spark.range(1000).withColumn("v", F.col("id") % 7)}, {})
    stage = store.stage(1)
    stage.retire(spark.range(3), "t")
    stage.add("t", spark.range(3).withColumn("v", F.lit(0).cast("long")))
    stage.commit({})
    plan = store.read(1, "t").where("id = 2").select("v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(id,2)") == 2 and "BroadcastHashJoin" in plan
    assert store.read(1, "t").where("id = 2").first().v == 0


def test_a_sync_of_one_item_writes_little(spark, tmp_path):
    many = 400
    site = Site([item(i, "2024-01-01T00:00:00.000+0000" if i == many else "2023-06-01T00:00:00.000+0000") for i in range(1, many + 1)], {i: [edge(i, i)] for i in range(1, many + 1)}, {1: {"id": 1, "name": "Open", "pickList": 9}})
    e = Engine(spark, str(tmp_path / "root"), site.base)
    e.build(5, with_links=True)
    before = files_of(e.store, 5)
    site.items[2] = item(3, "2024-02-01T00:00:00.000+0000", name="Renamed thing")
    assert e.sync(5) == "updated"
    after = files_of(e.store, 5)
    new = {f: n for f, n in after.items() if f not in before}
    assert set(before) <= set(after) and len(new) <= 10  # a file each: items, fields_kv, sketches, the index's four tables, keys; chunks and their keys
    assert sum(new.values()) < 60_000 and not any(f.split("/")[1].startswith(("relationships", "picklist")) for f in new)
    read = lambda t: e.store.read(5, t)
    assert read("items").count() == many and read("items").where("id = 3").first().name == "Renamed thing"
    assert read("chunks").groupBy("item_id").count().where("count <> 1").isEmpty() and "Renamed" in read("chunks").where("item_id = 3").first().text
    meta = e.store.meta(5)
    assert int(meta["item_count"]) == many and int(meta["field_kv_count"]) == read("fields_kv").count()
    assert (int(meta["fts_rows"]), int(meta["fts_length"])) == tuple(read("fts").agg(F.count("*"), F.sum("dl")).first())
    counted = {(r.t, r.field): r.n for r in e.distinct(5).collect()}
    assert abs(counted["items", "id"] - many) <= 0.05 * many and counted["items", "typeKey"] == 0 and counted["fields_kv", "key"] == read("fields_kv").select("key").distinct().count()
    assert e.sync(5) == "unchanged" and files_of(e.store, 5) == after
    # deletions write keys, and what takes them off the index's counts
    site.items = [r for r in site.items if r["id"] not in (3, 4)]
    assert e.reconcile(5)["deleted"] == 2
    gone = {f for f in files_of(e.store, 5) if f not in after}
    assert sorted(f.split("/")[1].split("-")[0] for f in gone) == ["gone", "levels"]
    meta = e.store.meta(5)
    assert int(meta["relationship_count"]) == read("relationships").count() and int(meta["item_count"]) == read("items").count() == many - 2
    assert [r.id for r in e.match(5, "renamed").collect()] == [] and read("chunks").count() == many - 2
