"""Every query of the catalogue against its SQL."""

import pytest

from tessera.plans import catalogue
from tests.differential import differences

WITH_SQL = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(WITH_SQL)))
def test_queries_without_sql_have_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
