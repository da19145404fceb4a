"""Streams run to the end of their input must equal the batch form."""

import base64
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from caretide.operators import approvals as A
from caretide.plans.stream_queries import run_to_table
from caretide.sources.tables import scratch, write_partitioned
from caretide.streaming import approvals as SA, ingest as I
from tests.test_state import completed_frame, decision_frame


def as_stream(spark, tmp_path, df, name, files=1):
    path = str(tmp_path / name)
    df.coalesce(files).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_audit_stream_tables(spark, tmp_path):
    def doc(i):
        base = {"encounter_id": f"e{i}", "node": "extractor", "timestamp": f"2026-01-{1 + i % 3:02d}T10:00:00Z"}
        if i % 5 == 1:
            base |= {"event_type": "classifier_feedback", "original_category": "a", "corrected_category": "b", "reviewer_id": "r"}
        if i % 7 == 0:
            del base["encounter_id"]
        if i % 11 == 0:
            del base["timestamp"]
        return base

    rows = [(str(i), base64.b64encode(json.dumps(doc(i)).encode()).decode() if i % 13 else "!!") for i in range(1, 200)]
    stream = as_stream(spark, tmp_path, spark.createDataFrame(rows, "message_id string, data string"), "in")
    out = str(tmp_path / "out")
    I.audit_stream(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
    counts = {t: spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{t}").count() for t in ("audit_trail", "classifier_feedback", "rejects")}
    bad = [i for i in range(1, 200) if i % 13 == 0 or i % 7 == 0 or i % 11 == 0]
    feedback = [i for i in range(1, 200) if i not in bad and i % 5 == 1]
    assert counts == {"audit_trail": 199 - len(bad) - len(feedback), "classifier_feedback": len(feedback), "rejects": len(bad)}
    days = spark.read.parquet(f"{out}/audit_trail").select("day").distinct().count()
    assert days == 3
    I.compact(spark, f"{out}/audit_trail", f"{out}/closed", "2026-01-03", ["encounter_id"])
    I.compact(spark, f"{out}/audit_trail", f"{out}/closed", "2026-01-03", ["encounter_id"])
    closed = spark.read.parquet(f"{out}/audit_trail").filter("day < DATE '2026-01-03'").count()
    assert spark.read.parquet(f"{out}/closed").count() == closed


def test_late_and_repeated_messages(spark, tmp_path):
    def write(rows, mode):
        frame = [(m, base64.b64encode(json.dumps({"encounter_id": m, "timestamp": "2026-01-01T10:00:00Z"}).encode()).decode(), t) for m, t in rows]
        df = spark.createDataFrame(frame, "message_id string, data string, t int").withColumn("publish_time", F.timestamp_seconds("t")).drop("t")
        df.coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
        return df.schema

    for rows, mode in (([("a", 100_000), ("b", 100_000)], "overwrite"), ([("a", 100_000), ("late", 1_000), ("c", 140_000)], "append")):
        schema = write(rows, mode)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        I.audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = [r["encounter_id"] for r in spark.read.parquet(str(tmp_path / "out" / "audit_trail")).collect()]
    assert sorted(got) == ["a", "b", "c", "late"]


def test_audit_stream_resumes_from_its_checkpoint(spark, tmp_path):
    def rows(lo, hi):
        docs = [{"encounter_id": f"e{i}", "timestamp": "2026-01-01T10:00:00Z"} for i in range(lo, hi)]
        return spark.createDataFrame([(str(i), base64.b64encode(json.dumps(d).encode()).decode()) for i, d in enumerate(docs, lo)], "message_id string, data string")

    first = rows(0, 10)
    first.write.parquet(str(tmp_path / "in"))
    for lo, hi in ((10, 15), (15, 15)):
        stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
        I.audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
        if hi > lo:
            rows(lo, hi).write.mode("append").parquet(str(tmp_path / "in"))
    got = spark.read.parquet(str(tmp_path / "out" / "audit_trail"))
    assert got.count() == got.select("encounter_id").distinct().count() == 15


def test_approval_stream_equals_batch(spark, tmp_path):
    completed = [(f"e{i % 9}", i, i, "x", "c", 0.5) for i in range(0, 40, 3)]
    made = [(f"e{i % 11}", i, 100 + i, "approved" if i % 2 else "rejected", f"r{i}", "y" if i % 4 else None) for i in range(40)]
    c, d = completed_frame(spark, completed), decision_frame(spark, made)
    events = SA.union_events(c, d)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, SA.ROCKSDB)
    try:
        for idempotent in (False, True):
            stream = as_stream(spark, tmp_path, events, f"events{idempotent}")
            out = run_to_table(SA.approval_stream(stream, idempotent), "approvals", "append")
            want = A.approval_state_machine(c, d, idempotent=idempotent).verdicts
            cols = ["encounter_id", "seq", "status", "outcome", "reviewer_id"]
            assert {tuple(r) for r in out.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}
    finally:
        spark.conf.set(key, before)


def test_change_feed_stream(spark, tmp_path):
    schema = "encounter_id string, updated_at int, status string"
    first = spark.createDataFrame([("a", 1, "pending"), ("b", 2, "pending")], schema)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
        I.change_feed_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True, limit=2).awaitTermination()

    run()
    spark.createDataFrame([("a", 3, "approved"), ("c", 4, "pending")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r["batch"], r["event"], r["encounter_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "new_triage", "a"), (0, "new_triage", "b"), (1, "updated", "a"), (1, "new_triage", "c")}


def test_dead_letter_stream_counts(spark, tmp_path):
    rows = [("a", False, False, i) for i in range(5)] + [("b", False, True, 0), ("c", False, False, 0)]
    df = spark.createDataFrame(rows, "message_id string, ok boolean, permanent boolean, t int").withColumn("delivered_at", F.timestamp_seconds("t")).drop("t")
    df = df.unionByName(df.filter("message_id = 'b'").withColumns({"message_id": F.lit("d"), "ok": F.lit(True)}))
    stream = I.dead_letter_stream(as_stream(spark, tmp_path, df, "d"))
    out = I.latest_dead(run_to_table(stream, "dead", "update", ["message_id", "window_start"]))
    assert {r["message_id"]: (r["failures"], r["dead"]) for r in out.collect()} == {"a": (5, True), "b": (1, True), "c": (1, False)}


def test_partitioned_write_prunes_days(spark):
    path = scratch(spark, "pruned")
    df = spark.range(1000).selectExpr("timestamp_seconds(id * 3600) as created_at", "id % 7 as k", "id")
    write_partitioned(df, path, ["k"])
    back = spark.read.parquet(path)
    assert back.count() == 1000
    plan = back.filter("day >= date'1970-02-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_scratch_uses_the_shared_folder():
    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert scratch(session("/shared", "spark://host"), "x").startswith("/shared/x-")
    with pytest.raises(ValueError):
        scratch(session(None, "spark://host"), "x")


def test_approval_stream_asks_the_state_per_bucket(spark, tmp_path):
    completed = [(f"e{i}", 1, i, "x", "c", 0.5) for i in range(60)] + [(None, 1, 100, "x", "c", None)]
    made = [(f"e{i}", t, 1000 * t + i, "approved", "r", "y") for t in (2, 5) for i in range(0, 60, 2)] + [(None, 3, 9, "rejected", "r", None)]
    late = [("e1", 9, 9001, "approved", "r", None), ("e2", 9, 9002, "approved", "r", None), ("f", 9, 9003, "approved", "r", None)]
    c, schema = completed_frame(spark, completed), decision_frame(spark, made)
    folder = str(tmp_path / "buckets")
    SA.union_events(c, schema).coalesce(1).write.parquet(folder)
    SA.union_events(c.limit(0), decision_frame(spark, late)).coalesce(1).write.mode("append").parquet(folder)
    events = SA.union_events(c, schema)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, SA.ROCKSDB)
    try:
        query = SA.approval_stream(stream, buckets=2).writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "cp"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(key, before)
    got = {(r["encounter_id"], r["seq"]): r["outcome"] for r in spark.table("buckets").collect()}
    want = {(f"e{i}", 1000 * t + i): "accepted" if t == 2 else "conflict" for t in (2, 5) for i in range(0, 60, 2)}
    assert got == want | {(None, 9): "accepted", ("e1", 9001): "accepted", ("e2", 9002): "conflict", ("f", 9003): "not_found"}
    assert state and max(state) <= 2  # one value a bucket, not one an encounter


def test_audit_stream_spreads_a_busy_day(spark, tmp_path, monkeypatch):
    doc = {"node": "extractor", "timestamp": "2026-01-01T10:00:00Z"}
    rows = [(str(i), base64.b64encode(json.dumps(doc | {"encounter_id": f"e{i}"}).encode()).decode()) for i in range(1000)]
    stream = as_stream(spark, tmp_path, spark.createDataFrame(rows, "message_id string, data string"), "in")
    monkeypatch.setattr(I, "TASK_ROWS", 200)
    I.audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out" / "audit_trail"))
    assert written.count() == 1000 and len(written.inputFiles()) > 2  # it was one task and file for the day
