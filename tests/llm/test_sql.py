"""Registered queries against their SQL, and all of them over the smallest tables."""

import os

import pytest

from strandweave.llm import queries

from ..oracle import SMALL, duck, same_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck(), queries.ORACLES[name])


def test_one_query_for_each_operator(spark):
    import __spark_entry__ as e

    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in e.queries()) == 1
    assert "pipeline" in e.queries()
