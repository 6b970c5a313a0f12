import random

import pytest

from quillstone.operators import graph
from quillstone.plans import catalog


def brute(links):
    ends, starts = {}, {}
    for f, t in links:
        if f is not None and t is not None:
            ends.setdefault(f, set()).add(t)
            starts.setdefault(t, set()).add(f)
    found = {f: len(set().union(*(starts[t] for t in mine)) - {f}) for f, mine in ends.items()}
    return {f: n for f, n in found.items() if n}


def dealt(seed, starts, ends, most):
    rng = random.Random(seed)
    return [(f, rng.randrange(ends)) for f in range(starts) for _ in range(rng.randrange(1, most))]


@pytest.mark.parametrize(
    "links",
    [
        dealt(1, 60, 40, 8),  # few ends each
        dealt(2, 40, 30, 60),  # few and many
        dealt(3, 12, 80, 200),  # many
        [(f, t) for f in range(9) for t in range(graph.WIDE + f % 3 - 1)],  # about the bound, and all alike
        [(1, 1), (1, 1), (2, 1), (2, None), (None, 1), (3, 2), (4, 4), (4, 4), (-5, 1), (-5, 0), (1, 0)],  # repeated, null, alone
        [],
    ],
)
def test_siblings_equal_brute_force(spark, links):
    got = graph.siblings(spark.createDataFrame(links, "f long, t long")).collect()
    assert {r.src: r.siblings for r in got} == brute(links) and len(got) == len({r.src for r in got})


def test_starts_at_one_end_are_not_paired(spark):
    """400 starts that share one end and nothing else: 159,600 pairs of 800 links."""
    links = spark.range(400).selectExpr("id AS f", "-1L AS t").union(spark.range(400).selectExpr("id AS f", "id AS t"))
    n, got = _shuffled(spark, graph.siblings(links))
    assert {r.siblings for r in got} == {399} and len(got) == 400 and n < 10 * 800


def test_the_query_lists_no_pairs(spark, small):
    pairs = spark.read.parquet(f"{small}/lineitem.parquet").groupBy("l_partkey").count().selectExpr("sum(count * (count - 1))").first()[0]
    assert _shuffled(spark, catalog.QUERIES["sql_graph_hop"](spark, small))[0] < pairs / 2


def _shuffled(spark, df):
    """Records that the stages of a run wrote to shuffles, and the rows of the answer."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    rows = df.collect()
    return sum(n for k, n in stages().items() if k > before), rows
