"""Every registered query against its SQL twin, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from pairloom.plans import all_checks  # noqa: E402

QUERIES = dict(all_checks())
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.duck(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    verdict, _, _, detail = compare.compare(spark, duck, sf_dir, name, QUERIES[name], ORACLE[name])
    assert verdict == "ok", detail


def test_entry(spark):
    assert entry.entry(spark).count() == 19
