"""Every query of the catalogue runs; those with SQL agree with it."""

import pytest

from lodestar.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(agrees, name):
    agrees(name)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["source", "n_all", "n_long", "n_good", "n_clean"] and rows.count() > 0
