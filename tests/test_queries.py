"""Each registered query against its oracle; those SQL cannot say must run and agree with themselves."""

from __future__ import annotations

import pytest

from tests.oracle import check, spark_rows
from tidemill import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_repeatable(spark, sf_dir, name):
    first = spark_rows(QUERIES[name](spark, sf_dir))
    assert first
    assert first == spark_rows(QUERIES[name](spark, sf_dir))


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0
