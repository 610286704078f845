"""The queries that have SQL, over whole tables, and what all queries promise."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from canvass.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    problem, n = oracle.compare(spark, oracle.connect(sf), sf, QUERIES[name], ORACLES[name])
    assert problem is None and n > 0, problem


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
