"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from caretide.plans.catalog import REGISTRY
from tests.compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"approval_stream"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in queries() if n not in SLOW])
def test_matches_sql(spark, con, name):
    result = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert result.startswith(("ok", "rows only")), result


def test_entry(spark):
    assert set(entry(spark).columns) == {"lang", "type", "n_matches", "n_texts"}


def test_every_query_has_sql():
    assert all(sql for _, sql in REGISTRY.values())
    assert set(REGISTRY) <= set(queries())
