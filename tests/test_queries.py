"""Every registered query, on whole tables, against its SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    assert compare(spark, duck, FOLDER, name, queries()[name], oracle_sql().get(name)) == ""


def test_entry(spark):
    assert entry(spark).columns == ["overall_status", "studies"]
