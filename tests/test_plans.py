"""Shapes of plans that matter at scale."""

import re

import pytest

from __spark_entry__ import queries
from caretide.plans import stream_queries

FOLDER = "/root/testdata/sf0.001"
STREAMS = {n for n, f in queries().items() if f.__module__ == stream_queries.__name__}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in queries() if n not in STREAMS])
def test_no_cross_joins_and_no_row_udfs(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)


@pytest.mark.parametrize(
    "name,columns",
    [
        ("redaction_summary", {"doc_id", "lang", "text"}),
        ("status_counts", {"o_orderstatus"}),
        ("latest_audit_ref", {"event_id"}),
        ("rate_limit_breaches", {"ts", "user_id"}),
    ],
)
def test_scans_read_only_what_is_needed(spark, name, columns):
    plan = plan_of(queries()[name](spark, FOLDER))
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)))
    assert read <= columns


def test_top_k_limits_before_the_shuffle(spark):
    plan = plan_of(queries()["pending_feed"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(queries()["latest_sessions"](spark, FOLDER))


@pytest.mark.parametrize("name,shuffles", [("scan_pii", 0), ("strip_phi", 0), ("route_model", 0), ("validate_schema", 0), ("upsert_merge", 1), ("resolve_retries", 1), ("redaction_summary", 1), ("step_pivot", 1)])
def test_number_of_shuffles(spark, name, shuffles):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == shuffles
