"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from sluiceway.plans import catalogue
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_sql(spark, data, name):
    same(catalogue.QUERIES[name](spark, data), catalogue.ORACLE[name], data)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
