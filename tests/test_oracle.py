"""Every registered query against its SQL twin; the others have to run and keep their promises."""

import os

import pytest

from tasksieve.catalog import ORACLE, QUERIES
from tests.oracle import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], FOLDER, may_be_empty=True) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and sum(r["n"] for r in rows) > 0
