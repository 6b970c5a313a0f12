"""The substring index against looking at all texts."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.operators import filters, grams, search
from quillstone.plans import boolexpr
from quillstone.sources.store import Store

from .test_engine import Site, item


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    dice = random.Random(11)
    rows = [(i * 37 - 500, "".join(dice.choices("abcAé %_\n", k=dice.choice([0, 2, 30, 60])))) for i in range(400)]
    rows += [(90_000, None), (90_001, "x" * 100_000 + "needle"), (90_002, "ab\U0001f600cd"), (None, "abc")]
    df = spark.createDataFrame(rows, "id long, name string").withColumns({"description": F.lit(None).cast("string"), "stepsText": F.lit("Z"), "globalSortOrder": F.lit(1), "createdDate": F.lit("x")})
    stage = Store(spark, str(tmp_path_factory.mktemp("grams"))).stage(1)
    stage.put("items", df.where("id < 10000"))
    stage.put("grams", grams.grams(stage.read("items")))
    more = df.where("id >= 10000 OR id IS NULL")  # in a part of its own
    stage.add("items", more)
    stage.add("grams", grams.grams(more))
    return stage.read("items"), stage.read("grams")


@pytest.mark.parametrize("expression", ["abc", "ABC", "aéa", "ab%ba", "needle", '"cab a"', "aaa and bbb", "aaa or bbb", "aaa and not bbb", "not aaa", "aaa or not bbb", "ab", "ab_cab", "a%b", "abca and (bcb or cacb)", "zzzz", "aaa and ab", "😀cd"])
@pytest.mark.parametrize("field", ["all", "name"])
def test_index_equals_scan(texts, expression, field):
    items, table = texts
    tree = boolexpr.parse(expression)
    got = [r.id for r in search.like_leg(items, tree, field, limit=None, index=table).collect()]
    want = [r.id for r in search.like_leg(items, tree, field, limit=None).where("id IS NOT NULL").collect()]
    assert [i for i in got if i is not None] == want


def test_only_candidates_are_read(texts):
    items, table = texts
    found = grams.candidates(table, boolexpr.parse("needle"))
    assert [r.id for r in found.collect()] == [90_001]
    plan = search.like_leg(items, boolexpr.parse("needle"), index=table)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,90001)" in plan or "In(id, [90001])" in plan
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()
    assert grams.candidates(table, boolexpr.parse("not aaa")) is None and grams.candidates(table, boolexpr.parse("ab")) is None


def test_pieces_of_terms():
    assert len(grams.wanted("abcdef")) == 2 and len(grams.wanted("abcd")) == 2 and grams.wanted("ab") == [] and grams.wanted("ab%cd_e") == []
    assert len(grams.wanted("abc%def")) == 2 and len(grams.wanted("a%cde", escape=True)) == 2


def test_updates_keep_the_index(spark, tmp_path):
    site = Site([item(i, "2024-01-01T00:00:00.000+0000") for i in range(1, 31)])
    e = Engine(spark, str(tmp_path / "root"), site.base)
    e.build(5)
    e.index_substrings(5)
    site.items[2] = item(3, "2024-02-01T00:00:00.000+0000", name="entirely renamed")
    assert e.sync(5) == "updated"
    read = lambda t: e.store.read(5, t)
    for expression in ("tirely ren", "pload fil", "file 3"):
        tree = boolexpr.parse(f'"{expression}"')
        got = {r.id for r in search.like_leg(read("items"), tree, index=read("grams")).collect()}
        assert got == {r.id for r in read("items").where(filters.substring(tree)).collect()}
    assert 3 in {r.id for r in e.search(5, expr='"tirely ren"', offline=True).collect()}


def test_pieces_are_brought_together_without_a_shuffle(spark):
    rows = [(5, "abcd abcd"), (5, "abc"), (4096, "abc"), (-1, "xabc"), (7, "ab"), (8, None), (None, "abc"), (4, "ABC")]
    df = spark.createDataFrame(rows, "id long, name string").withColumns({"description": F.lit(""), "stepsText": F.lit("")}).coalesce(1)
    made = grams.grams(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    abc = int(grams.pieces("abc")[0])
    assert [(r.block, r.ids) for r in made.where(F.col("gram") == abc).collect()] == [(-1, [4095]), (0, [4, 5]), (1, [0])]
