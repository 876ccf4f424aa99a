"""Every registered query against its SQL twin on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry
from lectern.queries.check import compare

SF_DIR = "/root/testdata/sf0.001"
CORE = [module for module in entry.MODULES if module.__name__.startswith("lectern.queries.")]
QUERIES = {name: query for module in CORE for name, query in module.QUERIES.items()}
SQL = {name: sql for module in CORE for name, sql in module.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["sitename", "dn", "dt", "num"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    outcome = compare(spark, SF_DIR, QUERIES[name], SQL[name])
    assert outcome.startswith("ok"), outcome
