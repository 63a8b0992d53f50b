"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks.compare import database, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = driver.queries()[name](spark, SF).toPandas()
    assert difference(got, duck.execute(driver.oracle_sql()[name]).df()) is None
    assert len(got)


def test_entry(spark):
    rows = {r["type"]: r for r in driver.entry(spark).collect()}
    assert rows["(overall)"].correct > 0
