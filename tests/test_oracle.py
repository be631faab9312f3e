"""Registered queries against their SQL on the smallest tables. FACTLOOM_ALL=1 runs the slow code queries too."""

import os

import pytest

import __spark_entry__ as entry
from factloom.tables import code_queries
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
SLOW = {n for n, f in entry.queries().items() if f.__module__ == code_queries.__name__}
NAMES = [n for n in entry.oracle_sql() if n not in SLOW or os.environ.get("FACTLOOM_ALL")] + (
    [] if os.environ.get("FACTLOOM_ALL") else ["declarations", "usages", "shapes", "switches", "references", "api_diff"])


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None, problem


def test_verify_changes_counts_open_switches(spark, con):
    name = "verify_changes_whole"
    problem, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None, problem
    rows = entry.queries()[name](spark, SF).filter("switches > 0").collect()
    assert rows and all(f"{r.switches} open switch(es)" in r.verdict_reason for r in rows)


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
