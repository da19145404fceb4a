"""Envelope, audit ingest, dead-letter and record-building queries."""

import re

from pyspark.sql import functions as F

from caretide import settings as S
from caretide.functions import decisions as D, variants as V
from caretide.operators import incidents, records as R, screening
from caretide.plans.inputs import ctes, load
from caretide.plans.registry import at, bar, epoch, query, sql_epoch
from caretide.plans.text_queries import found_sql, mask_sql
from caretide.sources import messages as M

_data_spark = "CASE WHEN event_id % 23 = 0 THEN '!!broken' ELSE base64(encode(json_body, 'UTF-8')) END"
_data_sql = "CASE WHEN event_id % 23 = 0 THEN '!!broken' ELSE to_base64(encode(json_body)) END"

_decoded = f"""{ctes('audit_bodies')},
e AS (SELECT * , {_data_sql} AS data FROM audit_bodies),
b AS (SELECT *, CASE WHEN regexp_full_match(data, '[A-Za-z0-9+/]*=*') THEN decode(from_base64(CASE WHEN regexp_full_match(data, '[A-Za-z0-9+/]*=*') THEN data END)) END AS body FROM e),
v AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM b),
d AS (SELECT *, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'invalid_payload' WHEN NOT json_exists(j, '$.encounter_id') THEN 'missing_encounter_id' END AS reject_reason FROM v)"""


def envelopes(spark, d):
    return load(spark, d, "audit_bodies").selectExpr("event_id", "message_id", "topic", "publish_time", f"{_data_spark} AS data")


@query("decode_envelope", f"{_decoded} SELECT message_id, CASE WHEN reject_reason IS NULL THEN json_extract_string(j, '$.encounter_id') END AS encounter_id, reject_reason FROM d")
def decode_envelope(spark, d):
    usable = F.col("reject_reason").isNull()
    encounter = F.when(usable, V.get(F.col("doc"), "encounter_id", "string"))
    return M.decode_message(envelopes(spark, d)).select("message_id", encounter.alias("encounter_id"), "reject_reason")


@query(
    "route_events",
    f"""{_decoded} SELECT CASE WHEN json_extract_string(j, '$.event_type') = 'classifier_feedback' THEN 'feedback' ELSE 'audit' END AS route, count(*) AS n
FROM d WHERE reject_reason IS NULL GROUP BY 1""",
)
def route_events(spark, d):
    ok, _ = M.decode_envelope(envelopes(spark, d))
    return ok.groupBy(M.route(F.col("doc")).alias("route")).agg(F.count("*").alias("n"))


def _str(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


_is_audit = "reject_reason IS NULL AND coalesce(json_extract_string(j, '$.event_type'), '') <> 'classifier_feedback'"


@query(
    "flatten_audit",
    f"""{_decoded} SELECT {_str('encounter_id')} AS encounter_id,
  CASE WHEN json_exists(j, '$.node') THEN {_str('node')} ELSE '' END AS node_name, CASE WHEN json_exists(j, '$.model') THEN {_str('model')} ELSE '' END AS model_used,
  {_str('routing_decision.category')} AS routing_category, CAST({_str('routing_decision.confidence')} AS DOUBLE) AS routing_confidence,
  CAST({_str('tokens.in')} AS BIGINT) AS input_tokens, CAST({_str('tokens.out')} AS BIGINT) AS output_tokens, CAST({_str('cost_usd')} AS DOUBLE) AS cost_usd,
  body AS reasoning_snapshot, coalesce(array_to_string(json_extract_string(j, '$.compliance_flags[*]'), '|'), '') AS compliance_flags,
  CAST({_str('sentinel_check.hallucination_score')} AS DOUBLE) AS sentinel_hallucination_score, CAST({_str('sentinel_check.confidence_score')} AS DOUBLE) AS sentinel_confidence_score,
  CAST({_str('sentinel_check.circuit_breaker_tripped')} AS BOOLEAN) AS circuit_breaker_tripped, CAST({_str('duration_ms')} AS BIGINT) AS duration_ms,
  {sql_epoch("CAST(replace(replace(" + _str('timestamp') + ", 'T', ' '), 'Z', '') AS TIMESTAMP)")} AS created_at
FROM d WHERE {_is_audit}""",
)
def flatten_audit(spark, d):
    ok, _ = M.decode_envelope(envelopes(spark, d))
    rows = R.flatten_audit(M.route_events(ok)[0])
    return rows.withColumns({"compliance_flags": bar("compliance_flags"), "created_at": epoch("created_at")})


@query(
    "flatten_feedback",
    f"""{_decoded} SELECT {_str('encounter_id')} AS encounter_id, {_str('original_category')} AS original_category, {_str('corrected_category')} AS corrected_category,
  {_str('reviewer_id')} AS reviewer_id, CASE WHEN NOT json_exists(j, '$.corrected_category') THEN 'missing_feedback_field' END AS reject_reason
FROM d WHERE reject_reason IS NULL AND json_extract_string(j, '$.event_type') = 'classifier_feedback'""",
)
def flatten_feedback(spark, d):
    ok, _ = M.decode_envelope(envelopes(spark, d))
    judged = R.judge_feedback(M.route_events(ok)[1])
    fields = ["encounter_id", "original_category", "corrected_category", "reviewer_id"]
    return judged.select(*[V.get(F.col("doc"), f, "string").alias(f) for f in fields], "reject_reason")


@query("snapshot", f"{_decoded} SELECT message_id, body FROM d WHERE {_is_audit}")
def snapshot(spark, d):
    """The document is kept as it came, byte for byte."""
    ok, _ = M.decode_envelope(envelopes(spark, d))
    return M.route_events(ok)[0].select("message_id", "body")


@query(
    "dlq_decode_inspect",
    f"""{_decoded} SELECT message_id, {sql_epoch('publish_time')} AS published, {_str('encounter_id')} AS encounter_id, {_str('patient_id')} AS patient_id, {_str('timestamp')} AS event_timestamp, reject_reason
FROM (SELECT * EXCLUDE (j), CASE WHEN reject_reason = 'invalid_payload' THEN NULL ELSE j END AS j FROM d)""",
)
def dlq_decode_inspect(spark, d):
    out = M.dlq_inspect(envelopes(spark, d))
    return out.withColumn("publish_time", epoch("publish_time")).withColumnRenamed("publish_time", "published")


@query("publish", f"{ctes('calls')} SELECT encounter_id AS key, encounter_id || '/' || node || '/' || tokens_in AS value FROM calls")
def publish(spark, d):
    """Rows to JSON messages and back through the parser."""
    frame = M.publish_frame(load(spark, d, "calls").select("encounter_id", "node", "tokens_in"), "encounter_id")
    v = F.try_parse_json("value")
    back = F.concat_ws("/", V.get(v, "encounter_id", "string"), V.get(v, "node", "string"), V.get(v, "tokens_in", "string"))
    return frame.select("key", back.alias("value"))


# --- dead letters ------------------------------------------------------------

_deliveries = {
    "message_id": "concat('m-', CAST(CAST(floor(event_id / 7) AS BIGINT) AS STRING))",
    "ok": "event_type = 'click' AND user_id % 2 = 0",
    "permanent": "event_type = 'error' AND user_id % 20 = 0",
    "delivered_at": "ts",
}
_deliveries_sql = "deliveries AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _deliveries.items()) + " FROM events)"


@query(
    "dead_letter",
    f"""WITH {_deliveries_sql}, p AS (SELECT message_id, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failures, bool_or(ok) AS delivered, bool_or(permanent AND NOT ok) AS permanent FROM deliveries GROUP BY 1)
SELECT message_id, failures, permanent OR failures >= 5 AS dead FROM p WHERE NOT delivered""",
)
def dead_letter(spark, d):
    from caretide.sources.tables import table

    log = table(spark, d, "events").selectExpr(*[f"{e} AS {c}" for c, e in _deliveries.items()])
    dead, retrying = incidents.dead_letter(log)
    both = dead.withColumn("dead", F.lit(True)).unionByName(retrying.withColumn("dead", F.lit(False)))
    return both.select("message_id", "failures", "dead")


_repeated = "concat('m-', CAST(user_id AS STRING), '-', CAST(CAST(floor(value / 50) AS BIGINT) AS STRING))"


@query(
    "dedup_messages",
    f"SELECT message_id, event_id FROM (SELECT {_repeated} AS message_id, event_id, row_number() OVER (PARTITION BY {_repeated} ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)
def dedup_messages(spark, d):
    from caretide.sources.tables import table

    log = table(spark, d, "events").selectExpr(f"{_repeated} AS message_id", "event_id", "ts")
    return incidents.dedup_messages(log, ["ts", "event_id"]).select("message_id", "event_id")


@query("retention", f"{ctes('audit_bodies')} SELECT message_id FROM audit_bodies WHERE publish_time > TIMESTAMP '2024-01-31' - INTERVAL 604800 SECONDS")
def retention(spark, d):
    return incidents.retention(load(spark, d, "audit_bodies"), at("2024-01-31")).select("message_id")


_dead_cols = {
    "message_id": "concat('m-', CAST(log_id AS STRING))",
    "encounter_id": "client",
    "topic": "CASE log_id % 3 WHEN 0 THEN 'triage-completed-dlq' WHEN 1 THEN 'audit-events-dlq' ELSE 'triage-approved-dlq' END",
    "status": "CASE WHEN log_id % 5 = 0 THEN NULL ELSE status END",
    "error_message": "message",
    "detected_at": "ts",
    "resolved_at": "CASE WHEN log_id % 2000 = 7 THEN NULL ELSE ts + INTERVAL 3 HOURS END",
}
_dead_sql = f"""{ctes('requests')}, dead AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _dead_cols.items())} FROM requests WHERE response_class <> '2xx'),
causes AS (SELECT *, CASE WHEN status IN (401, 403) THEN 'authentication' WHEN coalesce(status = 400, false) THEN 'invalid_payload'
  WHEN error_message LIKE 'Permission denied%' THEN 'write_failure' WHEN error_message = 'connection timeout' THEN 'network'
  WHEN coalesce(status >= 500, false) OR error_message LIKE '%crash loop' THEN 'consumer_down' ELSE 'unknown' END AS root_cause,
  CASE topic WHEN 'triage-completed-dlq' THEN 'P1' WHEN 'audit-events-dlq' THEN 'P2' ELSE 'P3' END AS severity FROM dead)"""


def _dead(spark, d):
    failed = screening.non_2xx(load(spark, d, "requests"))
    return incidents.diagnose(failed.selectExpr(*[f"{e} AS {c}" for c, e in _dead_cols.items()]))


@query("dlq_root_cause", f"{_dead_sql} SELECT message_id, root_cause, root_cause <> 'invalid_payload' AS replayable FROM causes")
def dlq_root_cause(spark, d):
    return _dead(spark, d).select("message_id", "root_cause", "replayable")


@query("dlq_severity", f"{_dead_sql} SELECT severity, count(*) AS n FROM causes GROUP BY 1")
def dlq_severity(spark, d):
    return _dead(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "replay_dlq",
    f"""{_dead_sql}, all_messages AS (SELECT concat('m-', CAST(log_id AS STRING)) AS message_id, client AS encounter_id FROM requests WHERE response_class = '2xx'
  UNION SELECT message_id, encounter_id FROM causes WHERE root_cause <> 'invalid_payload') SELECT message_id, encounter_id FROM all_messages""",
)
def replay_dlq(spark, d):
    """Delivered messages plus the dead letters worth another try."""
    source = load(spark, d, "requests").filter("response_class = '2xx'").selectExpr("concat('m-', CAST(log_id AS STRING)) AS message_id", "client AS encounter_id")
    return incidents.replay_dlq(source, _dead(spark, d), ["encounter_id"])


@query(
    "incident_report",
    f"""{_dead_sql} SELECT topic, count(*) AS message_count, count(DISTINCT encounter_id) AS affected_encounters, {sql_epoch('min(detected_at)')} AS detected_at,
  {sql_epoch('max(resolved_at)')} AS resolved_at, count(*) FILTER (root_cause <> 'invalid_payload') AS replayable, count(*) FILTER (resolved_at IS NULL) AS open, any_value(severity) AS severity,
  count(*) FILTER (resolved_at IS NULL) = 0 AND epoch(max(resolved_at)) - epoch(min(detected_at)) <= 86400 AS sla_met FROM causes GROUP BY topic""",
)
def incident_report(spark, d):
    return incidents.incident_report(_dead(spark, d)).withColumns({c: epoch(c) for c in ("detected_at", "resolved_at")})


@query("incident_encounters", f"{_dead_sql} SELECT topic, encounter_id, count(*) AS n_messages FROM causes GROUP BY 1, 2")
def incident_encounters(spark, d):
    return incidents.incident_encounters(_dead(spark, d))


@query(
    "escalation_stage",
    f"""{_dead_sql}, a AS (SELECT message_id, epoch(TIMESTAMP '2024-01-31' - detected_at) AS age FROM causes)
SELECT CASE WHEN age <= 3600 THEN 'on_call_engineer' WHEN age <= 14400 THEN 'platform_team_lead' WHEN age <= 43200 THEN 'engineering_manager_and_compliance'
  WHEN age <= 86400 THEN 'vp_engineering_and_privacy_officer' ELSE 'sla_breach' END AS stage, count(*) AS n FROM a GROUP BY 1""",
)
def escalation_stage(spark, d):
    age = F.unix_micros(at("2024-01-31")) / 1e6 - F.unix_micros(F.col("detected_at").cast("timestamp")) / 1e6
    return _dead(spark, d).groupBy(D.escalation_stage(age).alias("stage")).agg(F.count("*").alias("n"))


@query(
    "consumer_errors",
    f"{ctes('requests')} SELECT log_id, severity, status, {sql_epoch('ts')} AS ts FROM requests WHERE service = 'svc-1' AND (status = 400 OR severity = 'ERROR') ORDER BY requests.ts DESC, log_id DESC LIMIT 20",
)
def consumer_errors(spark, d):
    out = screening.consumer_errors(load(spark, d, "requests"), "svc-1")
    return out.select("log_id", "severity", "status", epoch("ts").alias("ts"))


# --- events, sessions, queue entries ----------------------------------------

_decided = {
    "encounter_id": "encounter_id",
    "patient_id": "concat('pat-', CAST(event_id % 97 AS STRING))",
    "category": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE 'pediatric' END",
    "has_decision": "event_id % 10 <> 0",
    "level": "CASE event_id % 4 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Urgent' WHEN 2 THEN 'Semi-Urgent' ELSE 'Non-Urgent' END",
    "confidence": "CAST(event_id % 100 AS DOUBLE) / 100.0",
    "reason": "CASE WHEN event_id % 6 = 0 THEN 'Unknown category fallback' END",
    "has_check": "event_id % 7 <> 0",
    "tripped": "event_id % 3 = 0",
    "model": "model",
    "n_steps": "event_id % 4",
}


def _decided_frame(spark, d):
    df = load(spark, d, "responses").selectExpr(*[f"{e} AS {c}" for c, e in _decided.items()])
    step = F.struct(F.concat(F.lit("ref/"), F.col("encounter_id"), F.lit("/"), F.col("n_steps")).alias("audit_ref"))
    return df.select(
        "encounter_id", "patient_id", "category",
        F.when(F.col("has_decision"), F.struct("level", "confidence", F.lit("why").alias("reasoning_summary"), F.col("model").alias("model_used"), F.col("reason").alias("routing_reason"))).alias("decision"),
        F.when(F.col("has_check"), F.struct((~F.col("tripped")).alias("passed"), F.col("confidence").alias("hallucination_score"), F.col("confidence").alias("confidence_score"))).alias("sentinel_check"),
        F.when(F.col("has_check"), F.col("tripped")).alias("circuit_breaker_tripped"),
        F.when(F.col("n_steps") > 0, F.array(step)).otherwise(F.array().cast("array<struct<audit_ref:string>>")).alias("audit_trail"),
    )


_decided_sql = f"""{ctes('responses')}, decided AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _decided.items())} FROM responses),
refs AS (SELECT *, CASE WHEN n_steps > 0 THEN 'ref/' || encounter_id || '/' || n_steps ELSE '' END AS audit_ref FROM decided)"""


@query(
    "build_triage_completed",
    f"""{_decided_sql} SELECT encounter_id, patient_id, CASE WHEN has_decision THEN level ELSE 'Unknown' END AS level, CASE WHEN has_decision THEN confidence ELSE 0.0 END AS confidence,
  CASE WHEN has_decision THEN reason ELSE '' END AS routing_reason, CASE WHEN has_check THEN NOT tripped ELSE false END AS passed, CASE WHEN has_check THEN confidence ELSE 1.0 END AS hallucination_score,
  audit_ref FROM refs""",
)
def build_triage_completed(spark, d):
    out = R.build_triage_completed(_decided_frame(spark, d), F.lit("2024-01-01T00:00:00Z"))
    return out.select(
        "encounter_id", "patient_id", "triage_result.level", "triage_result.confidence", "triage_result.routing_reason",
        "sentinel_check.passed", "sentinel_check.hallucination_score", "audit_ref",
    )


@query("build_session", f"{_decided_sql} SELECT encounter_id, 'pending' AS status, CASE WHEN has_decision THEN level ELSE 'Unknown' END AS triage_level, CASE WHEN has_check THEN tripped ELSE false END AS circuit_breaker_tripped FROM refs")
def build_session(spark, d):
    return R.build_session(_decided_frame(spark, d), F.lit("2024-01-01T00:00:00Z")).drop("updated_at")


@query(
    "build_triage_response",
    f"""{_decided_sql} SELECT encounter_id, patient_id, CASE WHEN has_decision THEN level ELSE 'Unknown' END AS triage_level, CASE WHEN has_decision THEN confidence ELSE 0.0 END AS confidence,
  CASE WHEN has_decision THEN 'why' ELSE '' END AS reasoning_summary, CASE WHEN has_decision THEN model ELSE '' END AS model_used, coalesce(category, '') AS routing_category,
  CASE WHEN has_check THEN NOT tripped ELSE false END AS sentinel_passed, CASE WHEN has_check THEN confidence ELSE 1.0 END AS hallucination_score,
  CASE WHEN has_check THEN tripped ELSE false END AS circuit_breaker_tripped, audit_ref FROM refs""",
)
def build_triage_response(spark, d):
    return R.build_triage_response(_decided_frame(spark, d), F.lit("2024-01-01T00:00:00Z")).drop("timestamp")


@query("build_queue_entry", f"{_decided_sql} SELECT encounter_id, patient_id, 'pending_approval' AS status, '2024-01-01T00:00:00Z' AS created_at, audit_ref FROM refs")
def build_queue_entry(spark, d):
    events = R.build_triage_completed(_decided_frame(spark, d), F.lit("2024-01-01T00:00:00Z"))
    return R.build_queue_entry(events, F.lit("now")).select("encounter_id", "patient_id", "status", "created_at", "audit_ref")


@query("latest_audit_ref", f"{_decided_sql} SELECT encounter_id, audit_ref FROM refs")
def latest_audit_ref(spark, d):
    return _decided_frame(spark, d).select("encounter_id", R.latest_audit_ref(F.col("audit_trail")).alias("audit_ref"))


_phi_found = found_sql(S.PHI_PATTERNS, "'PHI_STRIPPED_{name}'")
_phi_flags = f"CASE WHEN {_phi_found} = '' THEN 'PHI_CLEAN' ELSE 'PHI_REDACTED|' || {_phi_found} END"


@query(
    "build_audit_doc",
    f"""{ctes('encounters')},
{mask_sql('encounters', 'encounter_text', S.PHI_PATTERNS, S.PHI_TAG)},
{re.sub(r"\bm(\d+)\b", r"k\1", mask_sql('encounters', 'left(encounter_text, 120)', S.PHI_PATTERNS, S.PHI_TAG))},
i AS (SELECT encounter_id, t, {_phi_flags} AS flags FROM m{len(S.PHI_PATTERNS)}), o AS (SELECT encounter_id, t, {_phi_flags} AS flags FROM k{len(S.PHI_PATTERNS)})
SELECT i.encounter_id, 'extractor' AS node, 10 AS tokens_in, 20 AS tokens_out, 'pediatric' AS category, i.t AS input_summary, o.t AS output_summary,
  'PII_CLEAN|' || i.flags || '|' || o.flags AS flags FROM i JOIN o USING (encounter_id)""",
)
def build_audit_doc(spark, d):
    c = load(spark, d, "encounters").select("encounter_id", "encounter_text").withColumns({"tokens_in": F.lit(10), "tokens_out": F.lit(20)})
    flat = c.select(
        "encounter_id", F.lit("extractor").alias("node"), F.lit("m").alias("model"), F.lit(0.001).alias("cost_usd"), F.lit(5).alias("duration_ms"),
        F.struct(F.lit("pediatric").alias("category"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason")).alias("routing_decision"),
        F.col("encounter_text").alias("input_summary"), F.substring("encounter_text", 1, 120).alias("output_summary"),
        F.struct(F.col("tokens_in").alias("in"), F.col("tokens_out").alias("out")).alias("tokens"),
        F.array(F.lit("PII_CLEAN")).alias("compliance_flags"), F.lit(None).cast("struct<passed:boolean>").alias("sentinel_check"),
    )
    doc = R.build_audit_doc(flat, F.lit("2024-01-01T00:00:00Z"))
    return doc.select(
        "encounter_id", "node", F.col("tokens.in").alias("tokens_in"), F.col("tokens.out").alias("tokens_out"), "routing_decision.category",
        "input_summary", "output_summary", bar("compliance_flags").alias("flags"),
    )


@query(
    "audit_trail_entry",
    f"""{ctes('steps')}, r AS (SELECT *, row_number() OVER (PARTITION BY encounter_id, node ORDER BY seq DESC) AS rn FROM steps)
SELECT encounter_id, string_agg(node || ':' || seq, '|' ORDER BY CASE node WHEN 'classifier' THEN 0 WHEN 'extractor' THEN 1 WHEN 'reasoner' THEN 2 ELSE 3 END) AS trail FROM r WHERE rn = 1 GROUP BY 1""",
)
def audit_trail_entry(spark, d):
    steps = load(spark, d, "steps").withColumns({"ts": F.col("seq"), "tokens": F.lit(0), "audit_ref": F.col("seq").cast("string")})
    out = R.audit_trail_entry(steps, S.STEP_NODES)
    return out.select("encounter_id", bar(F.transform("audit_trail", lambda e: F.concat(e["node"], F.lit(":"), e["audit_ref"]))).alias("trail"))


@query(
    "check_enums",
    f"""{ctes('calls')}, k AS (SELECT *, concat_ws('|', CASE WHEN node NOT IN ('extractor', 'reasoner') THEN 'node' END, CASE WHEN model = 'other-model' THEN 'model' END) AS v FROM calls)
SELECT v AS violations, count(*) AS n FROM k GROUP BY 1""",
)
def check_enums(spark, d):
    marked = screening.mark_enums(load(spark, d, "calls"), {"node": ["extractor", "reasoner"], "model": S.MODEL_TIERS})
    return marked.groupBy(bar("enum_violations").alias("violations")).agg(F.count("*").alias("n"))


@query(
    "check_constraints",
    f"""{ctes('reviews')} SELECT 'not_null:corrected_category' AS rule, count(*) AS n_rows FROM reviews WHERE corrected_category IS NULL
UNION ALL SELECT 'unique:' || encounter_id, count(*) FROM reviews GROUP BY encounter_id HAVING count(*) > 1""",
)
def check_constraints(spark, d):
    reviews = load(spark, d, "reviews")
    nulls = screening.null_violations(reviews, ["encounter_id", "reviewer_id", "corrected_category"])
    repeats = screening.unique_violations(reviews, ["encounter_id"])
    return nulls.unionByName(repeats.select(F.concat(F.lit("unique:"), "encounter_id").alias("rule"), "n_rows"))


@query("apply_defaults", f"{ctes('approvals')} SELECT encounter_id, coalesce(CASE WHEN status = 'rejected' THEN NULL ELSE status END, 'pending') AS status, 1 AS version FROM approvals")
def apply_defaults(spark, d):
    df = load(spark, d, "approvals").selectExpr("encounter_id", "nullif(status, 'rejected') AS status", "CAST(NULL AS INT) AS version")
    return screening.apply_defaults(df, {"status": F.lit("pending"), "version": F.lit(1)})


@query(
    "accumulate_flags",
    f"{ctes('attempts')} SELECT encounter_id, attempt, flag || '|PII_CLEAN|' || flag AS flags FROM attempts",
)
def accumulate_flags(spark, d):
    from caretide.operators.outputs import accumulate_flags as accumulate

    flags = accumulate(F.array("flag"), F.array(F.lit("PII_CLEAN")), F.lit(None).cast("array<string>"), F.array("flag"))
    return load(spark, d, "attempts").select("encounter_id", "attempt", bar(flags).alias("flags"))


@query(
    "append_trail",
    f"{ctes('attempts')} SELECT encounter_id, attempt, CASE WHEN attempt = 0 THEN flag ELSE flag || '|' || content END AS trail FROM attempts",
)
def append_trail(spark, d):
    new = F.when(F.col("attempt") == 0, F.array().cast("array<string>")).otherwise(F.array("content"))
    return load(spark, d, "attempts").select("encounter_id", "attempt", bar(R.append_trail(F.array("flag"), new)).alias("trail"))


@query(
    "prompts",
    f"{ctes('responses')} SELECT encounter_id, 'Clinical data:' AS first_line, event_id % 2 = 0 AS has_cases FROM responses",
)
def prompts(spark, d):
    """Reasoner prompt: first line, and the retrieved-cases section only when there are cases."""
    df = load(spark, d, "responses")
    cases = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("t").alias("title"))))
    text = R.reasoner_prompt(F.struct("model", "tokens_in"), cases)
    return df.select("encounter_id", F.split_part(text, F.lit("\n"), F.lit(1)).alias("first_line"), text.contains("Similar cases for reference:").alias("has_cases"))


@query(
    "sentinel_prompts",
    f"""{ctes('calls')} SELECT event_id, model AS context_model, CAST(tokens_in AS VARCHAR) AS context_tokens, node AS decision_node, CAST(tokens_out AS VARCHAR) AS decision_tokens, 'Original clinical data:' AS first_line FROM calls""",
)
def sentinel_prompts(spark, d):
    """Sentinel prompts, taken apart again: both parts must parse and hold every field."""
    calls = load(spark, d, "calls")
    text = R.sentinel_prompt(F.struct("model", "tokens_in"), F.struct("node", "tokens_out"))
    parts = calls.select("event_id", text.alias("prompt")).select(
        "event_id",
        F.substring_index("prompt", "\n", 1).alias("first_line"),
        F.substring_index(F.split_part("prompt", F.lit("\n\nTriage decision:\n"), F.lit(1)), "clinical data:\n", -1).alias("context"),
        F.split_part("prompt", F.lit("\n\nTriage decision:\n"), F.lit(2)).alias("decision"),
    )
    return parts.select(
        "event_id",
        F.get_json_object("context", "$.model").alias("context_model"),
        F.get_json_object("context", "$.tokens_in").alias("context_tokens"),
        F.get_json_object("decision", "$.node").alias("decision_node"),
        F.get_json_object("decision", "$.tokens_out").alias("decision_tokens"),
        "first_line",
    )


@query("classifier_prompts", f"{ctes('encounters')} SELECT encounter_id, '{', '.join(S.CATEGORY_ROUTING)}' AS listed, encounter_text AS user_message FROM encounters")
def classifier_prompts(spark, d):
    """What the classifier is asked about every encounter: the categories that its instruction lists, and the message."""
    listed = F.regexp_extract(F.lit(R.classifier_prompt(list(S.CATEGORY_ROUTING))), r"Categories: ([^\n]*)", 1)
    return load(spark, d, "encounters").select("encounter_id", listed.alias("listed"), F.col("encounter_text").alias("user_message"))
