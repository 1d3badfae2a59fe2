"""Registered queries against their SQL. A subset by default; TICKLOOM_ALL=1 runs every one."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry_module

SF = os.environ.get("TICKLOOM_SF_DIR", "/root/testdata/sf0.01")
SUBSET = ("fixture_bars", "c6_exclusion_reasons", "j1_forward_as_of", "w8_signal_labels", "o3_all_horizons", "r1_candidates", "g4_industry_table", "k4_neighbour_statistics", "t2_as_of_query", "a1_monthly_feed", "p3_mention_counts")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("TICKLOOM_ALL") else [n for n in SUBSET]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows[0]["momentum20"] >= rows[-1]["momentum20"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
