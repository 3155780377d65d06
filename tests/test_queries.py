"""Every registered query beside its SQL twin on the smallest tables."""

import pytest

from tests.compare import differences, duck
from wayfind import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, con, name):
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert catalog.queries()[name](spark, SF).count() > 0
    else:
        assert differences(spark, con, catalog.queries()[name], sql, SF) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
