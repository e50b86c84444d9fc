import pytest

from scholium.plans import catalog
from tests.oracle import rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, spark):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(map(tuple, found.select(*columns).collect()), key=repr)
    assert got
    if name in catalog.ORACLE_SQL:
        names, want = rows_of(catalog.ORACLE_SQL[name], SF)
        assert columns == names
        assert len(got) == len(want)
        assert got == want
