"""Every training-data query with SQL gives the rows DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare
from marketsense.llm import queries

from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    line = compare(spark, duck, name, SF)
    assert line.startswith("ok"), line


def test_all_thirteen_and_the_pipeline_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in contract.queries() if name.startswith("op") and name[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in contract.queries()
