import pytest

from skein import catalog
from tests.oracle import compare

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    compare(spark, sf, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
