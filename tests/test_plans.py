"""What the plans look like: no Python on the executors, pruned and filtered scans."""

from __future__ import annotations

import os
import re

import pytest

from sparkloom.plans import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
MODELS = {n for n in QUERIES if n.startswith("ml_")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_stays_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas|CartesianProduct", text)


def scanned(text: str, table: str) -> set[str]:
    """Columns that the scans of a table read."""
    found: set[str] = set()
    for scan in re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*", text):
        names = {c.split("#")[0] for c in scan.split(",") if c}
        if any(n.startswith(table) for n in names):
            found |= names
    return found


def test_scans_are_pruned(spark):
    assert scanned(plan(QUERIES["popularity_stats"](spark, FOLDER)), "l_") == {"l_partkey", "l_quantity"}
    assert scanned(plan(QUERIES["user_counts"](spark, FOLDER)), "o_") == {"o_custkey"}


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["point_lookup"](spark, FOLDER))
    assert "EqualTo(c_custkey,7)" in text


def test_aggregates_combine_before_they_shuffle(spark):
    assert "partial_count" in plan(QUERIES["popularity_stats"](spark, FOLDER))


def test_top_lists_do_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["history_newest"](spark, FOLDER))
