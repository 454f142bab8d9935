import sys, os

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import rows_of, rows_of_sql

from arrowmill import registry


@pytest.mark.parametrize("name", list(registry.PAIRS))
def test_query_gives_the_rows_of_its_sql(name, spark, small, duck):
    assert rows_of(registry.QUERIES[name](spark, small)) == rows_of_sql(duck, registry.ORACLES[name])


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.PAIRS) <= set(e.queries())
