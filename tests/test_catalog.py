import pytest

from quillstone.plans import catalog

from .compare import rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_sql(name, spark, small, duck):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stream_equals_batch(spark, small):
    key = lambda df: sorted(map(tuple, df.select("id", "event_id", "event_type", "modifiedDate").collect()))
    assert key(catalog.QUERIES["incremental_stream"](spark, small)) == key(catalog.QUERIES["dedup_last_seen"](spark, small))


def test_entry_and_registry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graph_hop_answers_all_orders(spark, small, duck):
    parts, orders = {}, {}
    for order, part in duck.execute("SELECT l_orderkey, l_partkey FROM lineitem").fetchall():
        parts.setdefault(part, set()).add(order)
        orders.setdefault(order, set()).add(part)
    want = {o: len(set().union(*(parts[p] for p in mine)) - {o}) for o, mine in orders.items()}
    got = {r.src: r.siblings for r in catalog.QUERIES["sql_graph_hop"](spark, small).collect()}
    assert got == {o: n for o, n in want.items() if n} and len({o % 500 for o in got}) > 1
