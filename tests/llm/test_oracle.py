import pytest

from skein.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    assert compare(spark, sf.replace("sf0.001", "sf0.01"), queries.queries()[name], queries.oracle_sql()[name]) > 0
