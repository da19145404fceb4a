import json

import pytest
from pyspark.sql import functions as F

from caretide.operators import outputs as O

EXTRACTION = {
    "vitals": {"heart_rate": 88, "blood_pressure": "130/85", "temperature": 38.2, "respiratory_rate": None, "spo2": 97},
    "symptoms": [{"description": "cough", "onset": "3 days", "severity": "mild"}],
    "medications": [{"name": "aspirin", "dose": None, "frequency": "daily"}],
    "history": {"conditions": [], "allergies": ["penicillin"], "surgeries": []},
    "chief_complaint": None,
    "assessment_notes": "ok",
}
DECISION = {"level": "Urgent", "confidence": 0.9, "reasoning_summary": "why"}
CHECK = {"hallucination_score": 0.05, "confidence_assessment": 0.9, "vitals_consistent": True, "medication_safe": True}


def changed(base, **fields):
    return {**base, **fields}


CASES = [
    ("extractor", EXTRACTION, []),
    ("extractor", {"vitals": EXTRACTION["vitals"]}, [" required:symptoms", " required:medications", " required:history", " required:chief_complaint"]),
    ("extractor", changed(EXTRACTION, vitals=changed(EXTRACTION["vitals"], heart_rate="88")), [".vitals.heart_rate type"]),
    ("extractor", changed(EXTRACTION, vitals=changed(EXTRACTION["vitals"], heart_rate=True)), [".vitals.heart_rate type"]),
    ("extractor", changed(EXTRACTION, vitals=7), [".vitals type"]),
    ("extractor", changed(EXTRACTION, symptoms=[{"description": "a"}, {"onset": "b"}, "c"]), [".symptoms.1 required:description", ".symptoms.2 type"]),
    ("extractor", changed(EXTRACTION, history={"conditions": [1], "allergies": []}), [".history.conditions.0 type", ".history required:surgeries"]),
    ("reasoner", DECISION, []),
    ("reasoner", changed(DECISION, level="Critical"), [".level enum"]),
    ("reasoner", changed(DECISION, level=None), [".level type", ".level enum"]),
    ("reasoner", changed(DECISION, confidence=1.5), [".confidence maximum"]),
    ("reasoner", changed(DECISION, confidence=-0.1), [".confidence minimum"]),
    ("reasoner", changed(DECISION, reasoning_summary=""), [".reasoning_summary minLength"]),
    ("reasoner", changed(DECISION, key_findings=["a", None]), [".key_findings.1 type"]),
    ("reasoner", [1], [" type"]),
    ("sentinel", CHECK, []),
    ("sentinel", changed(CHECK, hallucination_score=1.5), [".hallucination_score maximum"]),
    ("sentinel", changed(CHECK, medication_safe="yes"), [".medication_safe type"]),
    ("sentinel", {}, [" required:hallucination_score", " required:confidence_assessment", " required:vitals_consistent", " required:medication_safe"]),
    ("planner", {}, []),
]


def test_schema_rules(spark):
    rows = [(i, n, json.dumps(c)) for i, (n, c, _) in enumerate(CASES)]
    df = O.validate_schema(spark.createDataFrame(rows, "i int, node string, content string"), "content", "node")
    got = {r["i"]: r for r in df.collect()}
    for i, (node, _, errors) in enumerate(CASES):
        assert got[i]["schema_errors"] == errors, CASES[i]
        prefix = "FHIR_SCHEMA_MISSING_" if node == "planner" else "FHIR_INVALID_" if errors else "FHIR_VALID_"
        assert got[i]["schema_flags"] == [prefix + node.upper()]


def test_bad_json_and_error_cap(spark):
    rows = [("not valid json {{{", "extractor"), ("{}", "extractor"), ('{"vitals":{}}', "extractor")]
    got = O.validate_schema(spark.createDataFrame(rows, "content string, node string"), "content", "node").collect()
    assert got[0]["schema_errors"] == ["invalid_json"] and not got[0]["schema_valid"]
    assert len(got[1]["schema_errors"]) == 5 and len(got[2]["schema_errors"]) == 5


@pytest.mark.parametrize(
    "content,level,failed,summary",
    [
        (json.dumps(DECISION), "Urgent", False, "why"),
        ("nope", "Manual_Review_Required", True, "Reasoner parse error: JSONDecodeError"),
        ('{"level":"Urgent"}', "Manual_Review_Required", True, "Reasoner parse error: KeyError"),
        (json.dumps(changed(DECISION, level="Critical")), "Critical", False, "why"),
    ],
)
def test_decision(spark, content, level, failed, summary):
    df = spark.createDataFrame([(content, "m", None)], "c string, m string, r string")
    row = O.parse_decision(df, "c", "m", "r").first()
    assert (row["decision"]["level"], row["decision_failed"], row["decision"]["reasoning_summary"]) == (level, failed, summary)
    assert row["decision"]["recommended_actions"] == (["Manual clinical review required"] if failed else [])
    assert row["decision"]["routing_reason"] == ("parse_failure_fallback" if failed else None)


def test_check_fails_safe(spark):
    rows = [(json.dumps(CHECK),), ("{",), ('{"hallucination_score":0.1}',)]
    got = O.circuit_breaker(O.parse_sentinel(spark.createDataFrame(rows, "c string"), "c"), F.col("check_failed")).collect()
    assert got[0]["sentinel_check"]["passed"] and got[0]["sentinel_check"]["failure_reasons"] == []
    for r in got[1:]:
        assert r["hallucination_score"] == 1.0 and r["confidence_score"] == 0.0
        assert r["sentinel_check"]["circuit_breaker_tripped"] and len(r["sentinel_check"]["failure_reasons"]) == 5


def test_classification(spark):
    rows = [
        ('{"category":"pediatric","confidence":0.9,"reason":"r"}', True), ("x", True), ('{"category":"a"}', True), ("x", False), (None, None),
    ]
    got = O.parse_classification(spark.createDataFrame(rows, "c string, ok boolean"), "c", "ok").collect()
    assert [(r["category"], r["confidence"], r["reason"]) for r in got] == [
        ("pediatric", 0.9, "r"),
        ("symptom_assessment", 0.0, "classifier_parse_error: JSONDecodeError"),
        ("symptom_assessment", 0.0, "classifier_parse_error: KeyError"),
        ("symptom_assessment", 0.0, "classifier_timeout: TimeoutError"),
        ("symptom_assessment", 0.0, "classifier_timeout: TimeoutError"),
    ]


def test_dispatch(spark):
    rows = [
        ("in", "Patient has mild headache and fever", "extractor", "input", 100, 0),
        ("out", json.dumps(changed(DECISION, level="Critical")), "reasoner", "output", 0, 100),
        ("aud", "Patient: John Smith, SSN 123-45-6789", "extractor", "audit", 0, 0),
        ("zero", "Patient has mild headache", "extractor", "input", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, content string, node_name string, validation_type string, tokens_in int, tokens_out int")
    got = {r["id"]: r for r in O.validate(df).collect()}
    assert got["in"]["validated"] and got["in"]["compliance_flags"] == ["PII_CLEAN", "TOKEN_INPUT_OK"]
    assert not got["out"]["validated"] and got["out"]["should_retry"] and "FHIR_INVALID_REASONER" in got["out"]["compliance_flags"]
    assert got["aud"]["validated"] and got["aud"]["compliance_flags"][0] == "PHI_REDACTED" and "John" not in got["aud"]["clean_content"]
    assert got["zero"]["compliance_flags"][-1] == "TOKEN_INPUT_SUSPICIOUSLY_SHORT" and not got["zero"]["should_retry"]


def test_retries(spark):
    rows = [
        ("a", 0, False, True, ["A0"]),
        ("b", 0, True, False, ["B0"]), ("b", 1, False, True, ["B1"]), ("b", 2, False, True, ["B2"]),
        ("c", 0, True, False, ["C0"]), ("c", 1, True, False, ["C1"]), ("c", 2, True, False, ["C2"]), ("c", 3, False, True, ["C3"]),
        ("d", 0, True, False, ["D0"]),
    ]
    df = spark.createDataFrame(rows, "encounter_id string, attempt int, should_retry boolean, validated boolean, compliance_flags array<string>")
    got = {r["encounter_id"]: (r["attempt"], r["compliance_flags"]) for r in O.resolve_retries(df, ["encounter_id"], []).collect()}
    assert got == {"a": (0, ["A0"]), "b": (1, ["B0", "B1"]), "c": (2, ["C0", "C1", "C2", "FHIR_RETRY_EXHAUSTED"])}


def test_one_row_group_of_responses_becomes_several_tasks(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries
    from caretide.plans import inputs

    ids = F.when(F.col("id") % 50 > 0, F.col("id") % 900)  # null and repeated ids too
    spark.range(1000).select(ids.alias("event_id"), (F.col("id") % 7).alias("user_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = sorted(map(str, queries()["validate"](spark, str(tmp_path)).collect()))
    assert len(whole) == 1000
    monkeypatch.setattr(inputs, "TASK_ROWS", 150)
    dealt = inputs.load(spark, str(tmp_path), "responses")
    assert dealt.rdd.getNumPartitions() == 7
    assert sorted(map(str, queries()["validate"](spark, str(tmp_path)).collect())) == whole
