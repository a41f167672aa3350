"""Every registered query against its SQL on the smallest shared tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from matchflow import queries as registered

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.all_queries(), registered.all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"kmeans_fit", "pca_2d", "kmeans_diagnostics", "recalibrate_dense", "throw_in_outs"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    try:
        ok, text, _ = compare(spark, con, SF, QUERIES[name], SQL.get(name))
    except AssertionError:
        raise
    assert ok or text == "no rows", text


def test_entry_holds_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
