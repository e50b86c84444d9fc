import pytest

from scholium.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, oracle):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    columns, want = oracle(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    got = sorted([tuple(r) for r in found.select(*columns).collect()], key=repr)
    assert len(got) == len(want)
    assert got == want
