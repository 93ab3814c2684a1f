"""Every registered query against its SQL twin on the smallest data."""

import check_oracles
import pytest

import __spark_entry__ as entry
from sourcelight.plans import oracles
from sourcelight.plans.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"extractive_answer", "assistant_answers", "review_reports"}


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees(spark, con, name):
    ok, text = check_oracles.compare(spark, con, FOLDER, name)
    assert ok, text


def test_oracles_cover_the_registry():
    assert set(REGISTRY) - set(oracles.oracle_sql()) == ROWS_ONLY
    assert set(REGISTRY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
