"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as contract
from marketsense import catalog
from check import TABLES, compare

from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


def test_every_query_is_callable_and_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without == {
        "train_random_forest", "train_gbt", "grid_search_cv", "cross_validate", "evaluate_model",
        "feature_importance", "train_pipeline",
    }


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    line = compare(spark, duck, name, SF)
    assert line.startswith("ok"), line


def test_entry(spark):
    assert contract.entry(spark).columns[:2] == ["ticker", "date"]


def test_the_entry_works_without_the_training_data_part(monkeypatch):
    """A library that only that part needs may be missing; so may the part itself."""
    for missing in ("public_tokenizers", "corpus_pipeline", "marketsense.llm.queries"):
        with monkeypatch.context() as patch:
            for name in [name for name in sys.modules if name == "corpus_pipeline" or name.startswith("marketsense.llm")]:
                patch.delitem(sys.modules, name)
            patch.setitem(sys.modules, missing, None)
            assert set(contract.queries()) == set(catalog.queries()) and set(contract.oracle_sql()) == set(catalog.oracle_sql())
