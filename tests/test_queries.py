"""Every registered query against its SQL on the small tables."""

import pytest

from tallyfield.plans import catalog

from .compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, catalog.ORACLES[name])


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
