import pytest

from quillstone.llm import queries

from ..compare import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(name, spark, small, duck):
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
