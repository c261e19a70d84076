"""Every catalog query against its SQL statement over the given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from newsflow.plans.catalog import registry
from newsflow.plans.oracle import statements
from tests.compare import connect, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES = registry()
STATEMENTS = statements()


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_a_statement():
    assert QUERIES.keys() == STATEMENTS.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_statement(spark, duck, name):
    columns, found = spark_rows(QUERIES[name](spark, SF_DIR))
    wanted_columns, wanted = duck_rows(duck, STATEMENTS[name])
    assert columns == wanted_columns
    assert len(found) == len(wanted)
    assert found == wanted


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
