"""Every registered query against its DuckDB oracle on the smallest data."""

from __future__ import annotations

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    from __spark_entry__ import queries
    return sorted(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    line = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    expect = "OK" if name in oracle_sql() else "ROWS"
    assert line.startswith(expect), line


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() == 10
    assert "strategic_score" in df.columns
