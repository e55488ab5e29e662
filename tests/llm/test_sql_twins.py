"""The queries that SQL can express, against their twins; the others give rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import compare  # noqa: E402

from pairloom.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, name):
    verdict, _, _, detail = compare.compare(spark, compare.duck(sf_dir), sf_dir, name, QUERIES[name], ORACLE[name])
    assert verdict == "ok", detail


def test_every_number_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
