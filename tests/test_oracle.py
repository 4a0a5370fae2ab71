"""Every registered query against its SQL on DuckDB, over whole tables."""

import os
import re

import pytest
from oracle import DATA, compare, duck

import __spark_entry__ as entry_module

SF_DIR = str(DATA / f"sf{os.environ.get('TEST_SF', '0.001')}")
QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    with duck(SF_DIR) as connection:
        yield connection


@pytest.mark.parametrize("name", [name for name in QUERIES if name in ORACLE])
def test_query_equals_sql(spark, connection, name):
    compare(spark, connection, name, QUERIES[name], ORACLE[name], SF_DIR)


def test_every_query_has_sql():
    # queries for training data have tests of their own where SQL cannot express them
    own = {name for name in QUERIES if re.match(r"op\d+_|pipeline$", name)}
    assert set(QUERIES) - set(ORACLE) <= own
    assert set(ORACLE) <= set(QUERIES)


def test_entry_gives_findings(spark):
    rows = entry_module.entry(spark)
    assert rows.count() > 0
    assert "policy_action" in rows.columns
