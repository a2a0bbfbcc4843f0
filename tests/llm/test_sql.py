"""The training-data queries that SQL can say, against DuckDB."""

from __future__ import annotations

import pytest

from tests.oracle import check
from tidemill.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
