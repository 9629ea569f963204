import pytest

from tests.conftest import SF, same_rows
from tidelog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(name, spark, duck):
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    same_rows(mine, duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
