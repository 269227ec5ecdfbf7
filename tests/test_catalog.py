import pytest
from compare import plain, sql_rows

from celltide.plans import catalog, stored  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.SQL:
        assert plain(got.toPandas()) == sql_rows(catalog.SQL[name], FOLDER)
    else:
        assert got.count() > 0
