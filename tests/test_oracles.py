"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

from workload import load_all
from workload.check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


# Queries that SQL does not express, and the tests that hold them to hand-made or brute-force results.
WITHOUT_ORACLE: dict[str, str] = {}
# Queries that may find nothing in the smallest tables.
MAY_BE_EMPTY = {"job_page"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    verdict, _, _ = compare(spark, connection, SF_DIR, name)
    assert verdict.startswith("ok") or (verdict == "EMPTY" and name in MAY_BE_EMPTY), verdict


def test_only_listed_queries_have_no_oracle():
    assert set(QUERIES) - set(ORACLES) == set(WITHOUT_ORACLE)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
