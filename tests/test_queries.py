"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from oracle import compare, database
from paneloom.plans import catalog

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    problem, n_rows = compare(spark, duck, SF_DIR, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert problem is None
    assert n_rows >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 18
    assert set(entry.oracle_sql()) <= set(entry.queries())
