import base64
import json

from pyspark.sql import functions as F

from caretide.operators import incidents, records as R, screening
from caretide.sources import messages as M

FULL = {
    "encounter_id": "enc-1", "node": "extractor", "model": "m", "routing_decision": {"category": "c", "confidence": 0.9, "reason": None},
    "input_summary": "i", "output_summary": "o", "tokens": {"in": 10, "out": 20}, "cost_usd": 0.01, "compliance_flags": ["A", "B"],
    "sentinel_check": {"hallucination_score": 0.1, "confidence_score": 0.9, "circuit_breaker_tripped": False},
    "duration_ms": 823, "timestamp": "2026-01-15T10:00:00Z",
}
FEEDBACK = {
    "event_type": "classifier_feedback", "encounter_id": "enc-2", "original_category": "a", "corrected_category": "b",
    "classifier_confidence": 0.75, "reviewer_id": "dr", "timestamp": "2026-01-15T10:00:00+00:00",
}


def frame(spark, docs):
    rows = [(str(i), d if isinstance(d, str) else base64.b64encode(json.dumps(d).encode()).decode()) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "message_id string, data string")


def test_decode_rejects(spark):
    docs = ["!!", base64.b64encode(b"not json").decode(), base64.b64encode(b"\xff\xfe").decode(), [1], {"x": 1}, {"encounter_id": ""}, {"encounter_id": None}, FULL]
    df = frame(spark, docs)
    ok, bad = M.decode_envelope(df)
    assert {r["message_id"]: r["reject_reason"] for r in bad.collect()} == {
        "0": "invalid_payload", "1": "invalid_payload", "2": "invalid_payload", "3": "invalid_payload", "4": "missing_encounter_id",
    }
    assert {r["message_id"] for r in ok.collect()} == {"5", "6", "7"}
    ok, bad = M.decode_envelope(df, require="truthy")
    assert {r["message_id"] for r in ok.collect()} == {"7"}


def test_flatten_audit(spark):
    minimal = {"encounter_id": "enc-9", "timestamp": "2026-01-15T10:00:00.123456+00:00"}
    nulls = {**FULL, "node": None, "sentinel_check": None, "tokens": None, "compliance_flags": None}
    ok, _ = M.decode_envelope(frame(spark, [FULL, minimal, nulls]))
    rows = {r["encounter_id"] + str(r["duration_ms"]) + str(r["node_name"]): r for r in R.flatten_audit(ok).collect()}
    full = rows["enc-1823extractor"]
    assert (full["input_tokens"], full["output_tokens"], full["routing_category"], full["compliance_flags"]) == (10, 20, "c", ["A", "B"])
    assert full["circuit_breaker_tripped"] is False and full["created_at"].isoformat() == "2026-01-15T10:00:00"
    assert json.loads(full["reasoning_snapshot"]) == FULL
    least = rows["enc-9None"]
    assert (least["node_name"], least["model_used"], least["compliance_flags"], least["cost_usd"]) == ("", "", [], None)
    null = rows["enc-1823None"]
    assert null["node_name"] is None and null["compliance_flags"] is None and null["sentinel_confidence_score"] is None


def test_routing_and_feedback(spark):
    broken = {k: v for k, v in FEEDBACK.items() if k != "reviewer_id"}
    ok, _ = M.decode_envelope(frame(spark, [FULL, FEEDBACK, broken]))
    audit, feedback = M.route_events(ok)
    rows, rejects = R.flatten_feedback(feedback)
    assert audit.count() == 1 and rejects.count() == 1
    row = rows.first()
    assert (row["original_category"], row["corrected_category"], row["classifier_confidence"]) == ("a", "b", 0.75)


def test_messages_are_decoded_once(spark):
    ok, _ = M.decode_envelope(frame(spark, [FULL]))
    plan = R.flatten_audit(M.route_events(ok)[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_publish_keeps_nulls(spark):
    df = spark.createDataFrame([("e", None)], "encounter_id string, x int")
    assert json.loads(M.publish_frame(df, "encounter_id").first()["value"]) == {"encounter_id": "e", "x": None}


def test_dead_letter(spark):
    rows = [("a", False, False, i) for i in range(5)] + [("b", False, False, i) for i in range(4)]
    rows += [("c", False, True, 0)] + [("d", False, False, 0), ("d", True, False, 1)]
    dead, retrying = incidents.dead_letter(spark.createDataFrame(rows, "message_id string, ok boolean, permanent boolean, delivered_at int"))
    assert {r["message_id"] for r in dead.collect()} == {"a", "c"}
    assert {r["message_id"] for r in retrying.collect()} == {"b"}


def test_builders(spark):
    trail = "array<struct<audit_ref:string>>"
    df = spark.sql(
        f"""select 'e' as encounter_id, 'p' as patient_id, cast(null as string) as category, cast(null as boolean) as circuit_breaker_tripped,
        cast(null as struct<level:string,confidence:double,reasoning_summary:string,model_used:string,routing_reason:string>) as decision,
        cast(null as struct<passed:boolean,hallucination_score:double,confidence_score:double>) as sentinel_check, cast(array() as {trail}) as audit_trail"""
    )
    event = R.build_triage_completed(df, F.lit("t")).first()
    assert tuple(event["triage_result"]) == ("Unknown", 0.0, "", "", "") and tuple(event["sentinel_check"]) == (False, 1.0, 0.0)
    assert event["audit_ref"] == ""
    queue = R.build_queue_entry(R.build_triage_completed(df, F.lit("t")), F.lit("now")).first()
    assert (queue["status"], queue["created_at"], queue["updated_at"]) == ("pending_approval", "t", "t")


def test_constraints_and_enums(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y")], "id string, v string")
    assert [tuple(r) for r in screening.null_violations(df, ["id", "v"]).collect()] == [("not_null:v", 1)]
    assert [tuple(r) for r in screening.unique_violations(df, ["id"]).collect()] == [("a", 2)]
    ok, bad = screening.check_enums(df, {"v": ["x", "z"]})
    assert ok.count() == 1 and bad.count() == 2


def test_not_expired_at_midnight(spark):
    df = spark.sql("select * from values (date'2024-07-01'), (date'2024-07-02'), (null) t(expiry_date)")
    kept = screening.filter_not_expired(df, F.lit("2024-07-01 00:00:00").cast("timestamp")).collect()
    assert len(kept) == 2
