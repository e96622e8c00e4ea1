"""Registered queries against their SQL twins on the smallest tables, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
# One query per operator family; ``python -m tests.oracle`` runs them all.
SAMPLE = (
    "w05_price_signals", "w11_period_returns", "w13_corporate_actions", "j02_close_on_or_before", "a08_winsorised_mean",
    "a21_newey_west", "rank_positions", "p02_cross_section_score", "w26_quarterly_values", "x12_total_debt",
    "f02_pre_filter", "r01_research_queue", "f11_duplicate_listings",
)
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_twin(spark, name):
    problem, _ = compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])
    assert problem is None, problem


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registration_needs_no_session():
    """The twins must load in a process that never starts Spark."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
