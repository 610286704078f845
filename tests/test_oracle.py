"""Every registered query against its SQL, over the whole smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry_module
from canvass.registry import QUERIES as registered
from canvass.registry import load_all

load_all()
QUERIES = {name: fn for name, fn in entry_module.queries().items() if name in registered}
SQL = {name: sql for name, sql in entry_module.oracle_sql().items() if name in registered}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    problem, _ = oracle.compare(spark, con, sf_dir, QUERIES[name], SQL.get(name))
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() >= 0


def test_only_page_parsing_lacks_sql():
    assert set(QUERIES) - set(SQL) == {"page_text", "page_block_text"}
