import random

import pytest
from pyspark.sql import functions as F

from caretide.operators import approvals as A, dashboards as B, keyed as K, service_levels as L

EVENTS = "encounter_id string, ts timestamp_ntz, seq bigint"


def completed_frame(spark, rows):
    return spark.createDataFrame(rows, "encounter_id string, t int, seq bigint, routing_reason string, category string, confidence double").selectExpr(
        "encounter_id", "timestamp_seconds(t) as ts", "seq", "routing_reason", "category", "confidence"
    )


def decision_frame(spark, rows):
    return spark.createDataFrame(rows, "encounter_id string, t int, seq bigint, status string, reviewer_id string, corrected_category string").selectExpr(
        "encounter_id", "timestamp_seconds(t) as ts", "seq", "status", "reviewer_id", "corrected_category"
    )


def replay(completed, decisions, idempotent):
    """Sequential model of the status machine."""
    events = sorted([(c[1], 0, c[2], c) for c in completed] + [(d[1], 1, d[2], d) for d in decisions], key=lambda e: e[:3])
    status, entry, verdicts, feedback, approved = {}, {}, {}, set(), set()
    for _, kind, seq, e in events:
        key = e[0]
        if kind == 0:
            if key not in status or not idempotent:
                status[key], entry[key] = "pending_approval", e
            continue
        if key not in status:
            verdicts[(key, seq)] = "not_found"
        elif status[key] != "pending_approval":
            verdicts[(key, seq)] = "conflict"
        else:
            verdicts[(key, seq)] = "accepted"
            status[key] = e[3]
            if e[3] == "approved":
                approved.add((key, e[4]))
            if e[5] and e[5] != entry[key][3]:
                feedback.add((key, entry[key][3], e[5], entry[key][5]))
    return verdicts, status, feedback, approved


@pytest.mark.parametrize("idempotent", [False, True])
@pytest.mark.parametrize("chunk", [1, 7, 3600])
def test_machine_against_replay(spark, idempotent, chunk):
    rng = random.Random(7 + chunk)
    cats = ["x", "y", "z"]
    completed = [(f"e{rng.randrange(30)}", rng.randrange(40), i, rng.choice(cats), "c", i / 100) for i in range(120)]
    # one encounter holds a third of all decisions
    decisions = [
        ("e0" if i % 3 == 0 else f"e{rng.randrange(33)}", rng.randrange(40), 1000 + i, rng.choice(["approved", "rejected"]), f"r{i}", rng.choice([*cats, "", None]))
        for i in range(300)
    ]
    out = A.approval_state_machine(completed_frame(spark, completed), decision_frame(spark, decisions), idempotent=idempotent, chunk_seconds=chunk)
    verdicts, status, feedback, approved = replay(completed, decisions, idempotent)
    assert {(r["encounter_id"], r["seq"]): r["outcome"] for r in out.verdicts.collect()} == verdicts
    assert {r["encounter_id"]: r["status"] for r in out.queue.collect()} == status
    got = {(r["encounter_id"], r["original_category"], r["corrected_category"], r["classifier_confidence"]) for r in out.feedback.collect()}
    assert got == feedback
    assert {(r["encounter_id"], r["reviewer_id"]) for r in out.approved.collect()} == approved


def test_double_approval_conflicts(spark):
    c = [("e", 1, 1, "routine_vitals", "c", 0.75)]
    d = [("e", 2, 2, "approved", "r", "acute_presentation"), ("e", 3, 3, "approved", "r", None), ("e", 4, 4, "rejected", "r", None), ("x", 1, 5, "approved", "r", None)]
    out = A.approval_state_machine(completed_frame(spark, c), decision_frame(spark, d))
    assert {r["seq"]: r["outcome"] for r in out.verdicts.collect()} == {2: "accepted", 3: "conflict", 4: "conflict", 5: "not_found"}
    row = out.feedback.first()
    assert (row["original_category"], row["corrected_category"], row["classifier_confidence"]) == ("routine_vitals", "acute_presentation", 0.75)


def test_merge_keeps_absent_fields_and_explicit_nulls(spark):
    rows = [("k", 1, "a", True, "n1"), ("k", 2, "b", False, None), ("k", 3, "c", True, None), ("j", 1, "a", False, None)]
    log = spark.createDataFrame(rows, "k string, seq int, status string, has_note boolean, note string")
    got = {r["k"]: (r["status"], r["note"]) for r in K.upsert_merge(log, ["k"], ["seq"], {"status": F.lit(True), "note": F.col("has_note")}).collect()}
    assert got == {"k": ("c", None), "j": ("a", None)}
    got = K.upsert_merge(log.filter("seq < 3"), ["k"], ["seq"], {"note": F.col("has_note")}).filter("k = 'k'").first()
    assert got["note"] == "n1"


def test_update_existing_refuses_unknown_keys(spark):
    existing = spark.createDataFrame([("a", "pending", "n"), ("b", "pending", "n")], "k string, status string, note string")
    updates = spark.createDataFrame([("a", 1, "approved", None, True), ("z", 2, "approved", "x", True)], "k string, seq int, status string, note string, w boolean")
    merged, missed = K.update_existing(existing, updates, ["k"], ["seq"], {"status": F.lit(True), "note": F.col("w")})
    assert {tuple(r) for r in merged.collect()} == {("a", "approved", None), ("b", "pending", "n")}
    assert [(r["k"], r["reject_reason"]) for r in missed.collect()] == [("z", "not_found")]


def test_change_feed(spark):
    prev = spark.createDataFrame([("a", 1), ("b", 1), ("gone", 1)], "k string, v int")
    cur = spark.createDataFrame([("a", 1), ("b", None), ("c", 1)], "k string, v int")
    assert {(r["event"], r["k"]) for r in K.change_feed(prev, cur, "k").collect()} == {("updated", "b"), ("new_triage", "c")}


def test_top_model_tie_goes_to_first_seen(spark):
    rows = [(3, "x-opus"), (1, "x-haiku"), (2, "x-opus"), (4, "x-haiku"), (5, None)]
    df = spark.createDataFrame(rows, "seq int, selected_model string")
    assert B.top_model(df).first()[0] == "Haiku (2)"


def test_sustained_needs_every_period(spark):
    rows = [("s", t, v) for t, v in [(0, 9), (60, 9), (120, 9), (180, 1), (240, 9), (360, 9), (420, 9), (480, 9)]]
    df = spark.createDataFrame(rows, "service string, start bigint, value int")
    out = L.sustained(df, ["service"], F.col("value") > 5, 60, 180)
    assert sorted(r["start"] for r in out.filter("firing").collect()) == [120, 480]


@pytest.mark.parametrize("series", [["service"], []])
def test_sustained_over_spans_equals_one_window(spark, series):
    """Runs across borders of spans and days, gaps, unknown values."""
    rng, second = random.Random(8), 3600
    starts = [t * second for t in range(-60, 400) if rng.random() > 0.05]
    rows = [("s", t, rng.choice([9, 9, 9, 9, 9, 1, None])) for t in starts] + ([(None, t, 9) for t in starts] if series else [])
    df = spark.createDataFrame(rows, "service string, start bigint, value int")
    value = {(s, t): v for s, t, v in rows}
    out = L.sustained(df, series, F.col("value") > 5, second, 5 * second)
    assert out.columns == ["service", "start", "value", "firing"]
    got = {(r["service"], r["start"]): r["firing"] for r in out.collect()}
    assert got == {(s, t): all((value.get((s, t - i * second)) or 0) > 5 for i in range(5)) for s, t in value}
    assert any(got.values())


def test_percentile_reads_rows_once_and_keeps_null_keys(spark, tmp_path):
    spark.sql("select if(id % 3 = 0, null, 'k') as k, cast(id % 101 as double) as v from range(5000)").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    out = L.exact_percentile(df, ["k"], "v", 0.5, "p", 7.0)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in df.groupBy("k").agg(F.percentile("v", 0.5)).collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "Join" not in plan and "ReusedExchange" in final


def test_sketches_of_periods_merge(spark):
    df = spark.sql("select timestamp_seconds(id * 7 % 86400) as ts, if(id % 5 = 0, 'a', 'b') as k, cast(id * 7919 % 20011 as double) as v from range(20011)")
    hours = L.percentile_sketches(df, ["k"], "v", 3600)
    got = {r["k"]: (r["n"], r["p"]) for r in L.merged_percentile(hours, ["k"], 0.9, "p").collect()}
    assert got["a"][0] == 4003 and got["b"][0] == 16008
    assert all(abs(p / 20011 - 0.9) < 0.01 for _, p in got.values())


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_exact_percentile(spark, width, q):
    rng = random.Random(3)
    rows = [(f"k{i % 3}", rng.choice([5.0, rng.uniform(-20, 100)])) for i in range(500)] + [("one", 4.5), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["p"] for r in L.exact_percentile(df, ["k"], "v", q, "p", width).collect()}
    want = {r["k"]: r["p"] for r in df.filter("v is not null").groupBy("k").agg(F.percentile("v", q).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_burn_rate_fires_only_when_both_windows_burn(spark):
    rows = [(m * 60, m >= 330) for m in range(361)]
    df = spark.createDataFrame(rows, "t int, bad boolean").selectExpr(
        "timestamp_seconds(t) as ts", "'s' as service", "case when bad then '5xx' else '2xx' end as response_class"
    )
    out = L.burn_rate(df, F.col("response_class") == "2xx", 0.995).collect()
    fired = sorted(r["start"] // 60 for r in out if r["firing"])
    assert fired and fired[0] == 340  # 11 bad of 341 minutes (3.2 %) is the first slow burn over 6 x 0.5 %
    assert all((r["fast_burn"] > 14.4 and r["slow_burn"] > 6) == r["firing"] for r in out)


def test_cost_alert_and_rate_limit(spark):
    calls = spark.sql("select timestamp_seconds(86400 * (id % 2)) as ts, 'm' as model, 'n' as node, 1 as tokens_in, 1 as tokens_out, case when id % 2 = 0 then 30.0D else 20.0D end as cost_usd from range(4)")
    alert = L.daily_cost_alert(L.llm_usage_points(calls)).collect()
    assert [(r["start"], r["value"]) for r in alert] == [(0, 60.0)]
    logs = spark.sql("select timestamp_seconds(id) as ts, 'c' as client from range(61)")
    got = L.rate_limit_breaches(logs, 59, 60, 60).collect()
    assert [(r["start"], r["requests"], r["banned_until"]) for r in got] == [(0, 60, 120)]


def test_stores_that_disagree(spark):
    schema = "k string, t string, v int"
    a = spark.createDataFrame([("x", "2026-01-01", 1), ("x", "2026-01-01", 1), ("y", "2026-01-01", 2), ("z", "2026-01-02", None), (None, "2026-01-01", 1)], schema)
    b = spark.createDataFrame([("x", "2026-01-01", 1), ("y", "2026-01-01", 3), ("z", "2026-01-02", None)], schema)
    c = spark.createDataFrame([("x", "2026-01-01", 1), ("z", "2026-01-03", None)], schema)
    got = {(r["k"], str(r["day"])): (r["missing_in"], r["differs"]) for r in K.reconcile_stores({"a": a, "b": b, "c": c}, "k", "t", ["v"]).collect()}
    assert got == {("y", "2026-01-01"): ("c", True), ("z", "2026-01-02"): ("c", False), ("z", "2026-01-03"): ("a,b", False)}
