"""Routing, cost, parsing, validation and retry queries."""

from pyspark.sql import functions as F

from caretide import settings as S
from caretide.functions import decisions as D
from caretide.operators import approvals, dashboards, outputs as O
from caretide.plans.inputs import ctes, load, quoted
from caretide.plans.registry import bar, query
from caretide.plans.text_queries import _critical, found_sql, guard_sql, mask_sql

_routing = "routing(category, base, threshold, threshold_text, flagged) AS (VALUES " + ", ".join(
    f"('{c}', {t}, CAST({x} AS DOUBLE), '{x}', {str(f).lower()})" for c, (t, x, f) in S.CATEGORY_ROUTING.items()
) + ")"
_prices = "prices(model, p_in, p_out) AS (VALUES " + ", ".join(
    f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, (a, b) in S.MODEL_PRICES.items()
) + ")"


def cost_sql(model_in: str, model_out: str) -> str:
    return f"round((tokens_in * coalesce({model_in}, 0.0) + tokens_out * coalesce({model_out}, 0.0)) / CAST(1000000 AS DOUBLE), 8)"


@query(
    "route_model",
    f"""{ctes('encounters')}, {_routing},
r AS (SELECT encounter_id, confidence, {_critical} AS critical, base, threshold, threshold_text, flagged
      FROM encounters LEFT JOIN routing USING (category)),
t AS (SELECT *, CASE WHEN critical THEN 2 WHEN base IS NULL THEN 1
   ELSE greatest(least(2, base + CASE WHEN confidence < threshold THEN 1 ELSE 0 END),
                 CASE WHEN confidence < 0.70 OR flagged THEN 1 ELSE 0 END) END AS tier FROM r)
SELECT encounter_id, CASE tier WHEN 0 THEN '{S.LOW_TIER}' WHEN 1 THEN '{S.MIDDLE_TIER}' ELSE '{S.TOP_TIER}' END AS selected_model,
  CASE WHEN critical THEN 'Critical keyword safety override' WHEN base IS NULL THEN 'Unknown category fallback'
       WHEN confidence < threshold THEN 'Confidence ' || printf('%.2f', confidence) || ' below threshold ' || threshold_text END AS escalation_reason,
  critical AS safety_override FROM t""",
)
def route_model(spark, d):
    df = load(spark, d, "encounters")
    routed = D.route(F.col("encounter_text"), F.col("category"), F.col("confidence"))
    return df.select("encounter_id", routed.alias("r")).select("encounter_id", "r.*")


@query("llm_cost", f"{ctes('encounters')}, {_prices} SELECT encounter_id, model, {cost_sql('p_in', 'p_out')} AS cost_usd FROM encounters LEFT JOIN prices USING (model)")
def llm_cost(spark, d):
    df = load(spark, d, "encounters")
    return df.select("encounter_id", "model", D.call_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")).alias("cost_usd"))


_top = S.MODEL_PRICES[S.TOP_TIER]


@query(
    "routing_savings",
    f"""{ctes('encounters')}, {_prices}, c AS (SELECT category, {cost_sql('p_in', 'p_out')} AS a, {cost_sql(str(_top[0]), str(_top[1]))} AS b FROM encounters LEFT JOIN prices USING (model))
SELECT category, round(sum(a), 6) AS actual_usd, round(sum(b), 6) AS all_top_usd, round(1 - sum(a) / sum(b), 6) AS saved_fraction FROM c GROUP BY category""",
)
def routing_savings(spark, d):
    out = dashboards.routing_savings(load(spark, d, "encounters"), ["category"])
    return out.select("category", *[F.round(c, 6).alias(c) for c in ("actual_usd", "all_top_usd", "saved_fraction")])


def _parsed(column: str) -> str:
    return f"""{ctes('responses')}, p AS (SELECT *, CASE WHEN json_valid({column}) AND json_type(CASE WHEN json_valid({column}) THEN {column} END) = 'OBJECT' THEN {column} END AS j,
  json_valid({column}) AS is_json FROM responses)"""


_NUMERIC = "('UBIGINT', 'BIGINT', 'DOUBLE')"


def _error(missing: str) -> str:
    return f"CASE WHEN NOT is_json THEN 'JSONDecodeError' WHEN j IS NOT NULL AND ({missing}) THEN 'KeyError' ELSE 'TypeError' END"


def _absent(*keys: str) -> str:
    return " OR ".join(f"NOT json_exists(j, '$.{k}')" for k in keys)


@query(
    "parse_classification",
    f"""{_parsed('classification')}, g AS (SELECT *, coalesce(call_ok AND j IS NOT NULL AND NOT ({_absent('category', 'confidence', 'reason')})
   AND json_type(j, '$.confidence') IN {_NUMERIC}, false) AS good FROM p)
SELECT encounter_id, CASE WHEN good THEN json_extract_string(j, '$.category') ELSE 'symptom_assessment' END AS category,
  CASE WHEN good THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) ELSE 0.0 END AS confidence,
  CASE WHEN good THEN json_extract_string(j, '$.reason') WHEN NOT call_ok THEN 'classifier_timeout: TimeoutError'
       ELSE 'classifier_parse_error: ' || {_error(_absent('category', 'confidence', 'reason'))} END AS reason FROM g""",
)
def parse_classification(spark, d):
    df = O.parse_classification(load(spark, d, "responses"), "classification", "call_ok")
    return df.select("encounter_id", "category", "confidence", "reason")


@query(
    "parse_extraction",
    f"""{_parsed('extraction_json')} SELECT encounter_id, CAST(json_extract_string(j, '$.vitals.heart_rate') AS DOUBLE) AS heart_rate,
  json_extract_string(j, '$.vitals.blood_pressure') AS blood_pressure, CAST(json_extract_string(j, '$.vitals.spo2') AS DOUBLE) AS spo2,
  CAST(coalesce(len(json_extract_string(j, '$.symptoms[*].description')), -1) AS INT) AS n_symptoms,
  coalesce(array_to_string(json_extract_string(j, '$.history.allergies[*]'), '|'), '') AS allergies,
  CAST(coalesce(json_array_length(j, '$.history.conditions'), -1) AS INT) AS n_conditions,
  json_extract_string(j, '$.chief_complaint') AS chief_complaint, j IS NULL AS failed,
  CASE WHEN j IS NULL THEN 'Extractor failed to parse LLM output' END AS error FROM p""",
)
def parse_extraction(spark, d):
    df = O.parse_extraction(load(spark, d, "responses"), "extraction_json")
    e = F.col("extraction")
    return df.select(
        "encounter_id", e["vitals"]["heart_rate"].alias("heart_rate"), e["vitals"]["blood_pressure"].alias("blood_pressure"),
        e["vitals"]["spo2"].alias("spo2"), F.coalesce(F.size(e["symptoms"]), F.lit(-1)).alias("n_symptoms"),
        F.coalesce(bar(e["history"]["allergies"]), F.lit("")).alias("allergies"),
        F.coalesce(F.size(e["history"]["conditions"]), F.lit(-1)).alias("n_conditions"),
        e["chief_complaint"].alias("chief_complaint"), F.col("extraction_failed").alias("failed"), F.col("extraction_error").alias("error"),
    )


@query(
    "parse_decision",
    f"""{_parsed('decision_json')}, g AS (SELECT *, coalesce(j IS NOT NULL AND NOT ({_absent('level', 'confidence', 'reasoning_summary')})
   AND json_type(j, '$.confidence') IN {_NUMERIC}, false) AS good FROM p)
SELECT encounter_id, CASE WHEN good THEN json_extract_string(j, '$.level') ELSE 'Manual_Review_Required' END AS level,
  CASE WHEN good THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) ELSE 0.0 END AS confidence,
  CASE WHEN good THEN json_extract_string(j, '$.reasoning_summary') ELSE 'Reasoner parse error: ' || {_error(_absent('level', 'confidence', 'reasoning_summary'))} END AS reasoning_summary,
  CASE WHEN good THEN coalesce(array_to_string(json_extract_string(j, '$.recommended_actions[*]'), '|'), '') ELSE 'Manual clinical review required' END AS actions,
  CASE WHEN good THEN model ELSE 'parse_failure_fallback' END AS routing_reason, NOT good AS failed FROM g""",
)
def parse_decision(spark, d):
    df = O.parse_decision(load(spark, d, "responses"), "decision_json", "model", "model")
    return df.select(
        "encounter_id", "decision.level", "decision.confidence", "decision.reasoning_summary",
        F.coalesce(bar("decision.recommended_actions"), F.lit("")).alias("actions"), "decision.routing_reason", F.col("decision_failed").alias("failed"),
    )


_check = f"""{_parsed('check_json')}, g AS (SELECT *, coalesce(json_type(j, '$.hallucination_score') IN {_NUMERIC} AND json_type(j, '$.confidence_assessment') IN {_NUMERIC}
   AND json_type(j, '$.vitals_consistent') = 'BOOLEAN' AND json_type(j, '$.medication_safe') = 'BOOLEAN', false) AS good FROM p),
s AS (SELECT encounter_id, good, CASE WHEN good THEN CAST(json_extract_string(j, '$.hallucination_score') AS DOUBLE) ELSE 1.0 END AS h,
  CASE WHEN good THEN CAST(json_extract_string(j, '$.confidence_assessment') AS DOUBLE) ELSE 0.0 END AS c,
  good AND json_extract_string(j, '$.vitals_consistent') = 'true' AS v, good AND json_extract_string(j, '$.medication_safe') = 'true' AS m FROM g)"""


@query("parse_sentinel", f"{_check} SELECT encounter_id, h AS hallucination_score, c AS confidence_score, coalesce(v, false) AS vitals_ok, coalesce(m, false) AS meds_ok, NOT good AS check_failed FROM s")
def parse_sentinel(spark, d):
    df = O.parse_sentinel(load(spark, d, "responses"), "check_json")
    return df.select("encounter_id", "hallucination_score", "confidence_score", "vitals_ok", "meds_ok", "check_failed")


@query(
    "circuit_breaker",
    f"""{_check} SELECT encounter_id, NOT (h > 0.15 OR c < 0.85) AS passed, (h > 0.15 OR c < 0.85) AS tripped,
  concat_ws('|', CASE WHEN NOT good THEN 'Sentinel validation parse error — manual review required' END,
    CASE WHEN h > 0.15 THEN 'Hallucination score ' || printf('%.2f', h) || ' exceeds threshold 0.15' END,
    CASE WHEN c < 0.85 THEN 'Confidence ' || printf('%.2f', c) || ' below threshold 0.85' END,
    CASE WHEN NOT coalesce(v, false) THEN 'Vitals inconsistent with triage level' END,
    CASE WHEN NOT coalesce(m, false) THEN 'Medication safety concern detected' END) AS reasons FROM s""",
)
def circuit_breaker(spark, d):
    df = O.parse_sentinel(load(spark, d, "responses"), "check_json")
    df = O.circuit_breaker(df, F.col("check_failed"))
    c = F.col("sentinel_check")
    return df.select("encounter_id", c["passed"].alias("passed"), c["circuit_breaker_tripped"].alias("tripped"), bar(c["failure_reasons"]).alias("reasons"))


# --- schema validation -------------------------------------------------------

def _kind(path: str) -> str:
    return f"json_type(j, '$.{path}')"


def _bad(path: str, *kinds: str) -> str:
    """1 when a present member has none of the JSON kinds."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"CASE WHEN json_exists(j, '$.{path}') AND {_kind(path)} NOT IN ({listed}) THEN 1 ELSE 0 END"


def _missing(parent: str, *keys: str) -> str:
    prefix = f"{parent}." if parent else ""
    guard = f"json_type(j, '$.{parent}') = 'OBJECT' AND " if parent else ""
    return " + ".join(f"CASE WHEN {guard}NOT json_exists(j, '$.{prefix}{k}') THEN 1 ELSE 0 END" for k in keys)


def _non_strings(path: str) -> str:
    return f"coalesce(len(list_filter(json_type(j, '$.{path}[*]'), lambda x: x <> 'VARCHAR')), 0)"


_num = ["UBIGINT", "BIGINT", "DOUBLE"]


def _unit(path: str) -> str:
    value = f"CAST(json_extract_string(j, '$.{path}') AS DOUBLE)"
    return f"{_bad(path, *_num)} + CASE WHEN {_kind(path)} IN {_NUMERIC} THEN CASE WHEN {value} < 0 OR {value} > 1 THEN 1 ELSE 0 END ELSE 0 END"


_levels = ", ".join(quoted(x) for x in S.TRIAGE_LEVELS)
_ERRORS = {
    "reasoner": " + ".join([
        _missing("", "level", "confidence", "reasoning_summary"), _bad("level", "VARCHAR"),
        f"CASE WHEN json_exists(j, '$.level') AND coalesce(json_extract_string(j, '$.level') NOT IN ({_levels}), true) THEN 1 ELSE 0 END",
        _unit("confidence"), _bad("reasoning_summary", "VARCHAR"),
        "CASE WHEN json_extract_string(j, '$.reasoning_summary') = '' THEN 1 ELSE 0 END",
        _bad("recommended_actions", "ARRAY"), _non_strings("recommended_actions"), _bad("key_findings", "ARRAY"), _non_strings("key_findings"),
    ]),
    "sentinel": " + ".join([
        _missing("", "hallucination_score", "confidence_assessment", "vitals_consistent", "medication_safe"),
        _unit("hallucination_score"), _unit("confidence_assessment"), _bad("vitals_consistent", "BOOLEAN"), _bad("medication_safe", "BOOLEAN"),
        _bad("issues_found", "ARRAY"), _non_strings("issues_found"),
    ]),
    "extractor": " + ".join([
        _missing("", "vitals", "symptoms", "medications", "history", "chief_complaint"), _bad("vitals", "OBJECT"),
        _missing("vitals", "heart_rate", "blood_pressure", "temperature", "respiratory_rate", "spo2"),
        *[_bad(f"vitals.{v}", *_num, "NULL") for v in ("heart_rate", "temperature", "respiratory_rate", "spo2")],
        _bad("vitals.blood_pressure", "VARCHAR", "NULL"), _bad("symptoms", "ARRAY"), _bad("medications", "ARRAY"), _bad("history", "OBJECT"),
        "coalesce(len(json_extract(j, '$.symptoms[*]')) - len(json_extract(j, '$.symptoms[*].description')), 0)",
        "coalesce(len(json_extract(j, '$.medications[*]')) - len(json_extract(j, '$.medications[*].name')), 0)",
        _missing("history", "conditions", "allergies", "surgeries"), _bad("chief_complaint", "VARCHAR", "NULL"), _bad("assessment_notes", "VARCHAR", "NULL"),
    ]),
}
_BODY = {"extractor": "extraction_json", "reasoner": "decision_json", "sentinel": "check_json", "planner": "check_json"}
_NODES = list(_BODY)

_content = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN {_BODY[n]}" for i, n in enumerate(_NODES)) + " END"
_node = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NODES)) + " END"
_outputs = f"o AS (SELECT encounter_id, event_id, tokens_in, tokens_out, {_content} AS content, {_node} AS node_name FROM responses)"


def _schema_sql(source: str, content: str) -> str:
    per_node = " ".join(f"WHEN '{n}' THEN {e}" for n, e in _ERRORS.items())
    return f"""v AS (SELECT *, CASE WHEN json_valid({content}) THEN {content} END AS j FROM {source}),
n AS (SELECT *, CASE WHEN node_name NOT IN ('extractor', 'reasoner', 'sentinel') THEN 0 WHEN j IS NULL THEN 1
   ELSE least(5, CASE WHEN json_type(j) <> 'OBJECT' THEN 1 ELSE CASE node_name {per_node} END END) END AS n_errors FROM v),
f AS (SELECT *, n_errors = 0 AS valid, CASE WHEN node_name NOT IN ('extractor', 'reasoner', 'sentinel') THEN 'FHIR_SCHEMA_MISSING_' WHEN n_errors = 0 THEN 'FHIR_VALID_' ELSE 'FHIR_INVALID_' END || upper(node_name) AS flag FROM n)"""


def _model_outputs(spark, d):
    return load(spark, d, "responses").selectExpr("encounter_id", "event_id", "tokens_in", "tokens_out", f"{_content} AS content", f"{_node} AS node_name")


@query("validate_schema", f"{ctes('responses')}, {_outputs}, {_schema_sql('o', 'content')} SELECT encounter_id, node_name, valid, flag, CAST(n_errors AS INT) AS n_errors FROM f")
def validate_schema(spark, d):
    df = O.validate_schema(_model_outputs(spark, d), "content", "node_name")
    return df.select("encounter_id", "node_name", F.col("schema_valid").alias("valid"), bar("schema_flags").alias("flag"), F.size("schema_errors").alias("n_errors"))


_kinds = "CASE event_id % 3 WHEN 0 THEN 'output' WHEN 1 THEN 'input' ELSE 'audit' END"
_noted = f"CASE WHEN event_id % 3 = 0 THEN content ELSE content || ' Patient: John Smith, SSN 123-45-6789, mail a.b@example.com' END"
_in_flag, _in_err = guard_sql("tokens_in", "input")
_out_flag, _out_err = guard_sql("tokens_out", "output")
_pii_flags = found_sql(S.PII_PATTERNS, "'PII_MASKED_{name}'")
_phi_flags = found_sql(S.PHI_PATTERNS, "'PHI_STRIPPED_{name}'")


@query(
    "validate",
    f"""{ctes('responses')}, {_outputs}, k AS (SELECT * EXCLUDE (content), {_kinds} AS validation_type, {_noted} AS content FROM o),
pii AS (WITH {mask_sql('k', 'content', S.PII_PATTERNS, S.PII_TAG)} SELECT encounter_id, t AS pii_text, {_pii_flags} AS pii_found FROM m{len(S.PII_PATTERNS)}),
phi AS (WITH {mask_sql('k', 'content', S.PHI_PATTERNS, S.PHI_TAG)} SELECT encounter_id, t AS phi_text, {_phi_flags} AS phi_found FROM m{len(S.PHI_PATTERNS)}),
a AS (SELECT * FROM k JOIN pii USING (encounter_id) JOIN phi USING (encounter_id)), {_schema_sql('a', 'pii_text')},
g AS (SELECT *, CASE WHEN pii_found = '' THEN 'PII_CLEAN' ELSE pii_found END AS pii_flags, CASE WHEN phi_found = '' THEN 'PHI_CLEAN' ELSE 'PHI_REDACTED|' || phi_found END AS phi_flags,
  CASE WHEN validation_type = 'input' THEN {_in_flag} ELSE {_out_flag} END AS guard_flag,
  CASE WHEN validation_type = 'audit' THEN 0 WHEN validation_type = 'input' THEN CASE WHEN {_in_err} IS NULL THEN 0 ELSE 1 END
       ELSE CASE WHEN {_out_err} IS NULL THEN 0 ELSE 1 END + n_errors END AS n FROM f)
SELECT encounter_id, validation_type, CASE WHEN validation_type = 'audit' THEN phi_text ELSE pii_text END AS content,
  CASE validation_type WHEN 'audit' THEN phi_flags WHEN 'input' THEN pii_flags || '|' || guard_flag ELSE pii_flags || '|' || guard_flag || '|' || flag END AS flags,
  CAST(n AS INT) AS n_errors, n = 0 AS validated, validation_type = 'output' AND NOT valid AS should_retry FROM g""",
)
def validate(spark, d):
    df = _model_outputs(spark, d).selectExpr("*", f"{_kinds} AS validation_type").withColumn("content", F.expr(_noted))
    out = O.validate(df)
    return out.select(
        "encounter_id", "validation_type", F.col("clean_content").alias("content"), bar("compliance_flags").alias("flags"),
        F.size("errors").alias("n_errors"), "validated", "should_retry",
    )


@query(
    "resolve_retries",
    f"""{ctes('attempts')}, m AS (SELECT * FROM attempts WHERE attempt <= 2),
a AS (SELECT encounter_id, node, min(attempt) AS accepted FROM m WHERE NOT should_retry OR attempt = 2 GROUP BY ALL),
f AS (SELECT encounter_id, node, string_agg(flag, '|' ORDER BY attempt) AS flags FROM m JOIN a USING (encounter_id, node) WHERE attempt <= accepted GROUP BY ALL)
SELECT encounter_id, node, accepted AS attempt, flags || CASE WHEN accepted = 2 AND NOT validated THEN '|FHIR_RETRY_EXHAUSTED' ELSE '' END AS flags, validated, content
FROM a JOIN f USING (encounter_id, node) JOIN m ON m.encounter_id = a.encounter_id AND m.node = a.node AND m.attempt = a.accepted""".replace(
        "SELECT encounter_id, node, accepted AS attempt", "SELECT a.encounter_id AS encounter_id, a.node AS node, accepted AS attempt"
    ),
)
def resolve_retries(spark, d):
    df = load(spark, d, "attempts").withColumn("compliance_flags", F.array("flag"))
    out = O.resolve_retries(df, ["encounter_id", "node"], ["content"])
    return out.select("encounter_id", "node", "attempt", bar("compliance_flags").alias("flags"), "validated", "content")


@query(
    "retries_unsettled",
    f"""{ctes('attempts')} SELECT encounter_id, node, count(DISTINCT attempt) AS attempts_made FROM attempts GROUP BY 1, 2
HAVING NOT bool_or(attempt BETWEEN 0 AND 2 AND (NOT should_retry OR attempt = 2))""",
)
def retries_unsettled(spark, d):
    return O.unsettled_retries(load(spark, d, "attempts"), ["encounter_id", "node"])


@query(
    "unavailable_result",
    f"""{ctes('attempts')}, r AS (SELECT * FROM attempts WHERE validated)
SELECT a.encounter_id, a.attempt, r.attempt IS NOT NULL AS validated, CASE WHEN r.attempt IS NULL THEN '' ELSE r.content END AS content,
  CASE WHEN r.attempt IS NULL THEN 'SIDECAR_UNAVAILABLE' ELSE r.flag END AS flags, CASE WHEN r.attempt IS NULL THEN true ELSE r.should_retry END AS should_retry
FROM attempts a LEFT JOIN r ON a.encounter_id = r.encounter_id AND a.attempt = r.attempt""",
)
def unavailable_result(spark, d):
    attempts = load(spark, d, "attempts")
    results = attempts.filter("validated").select(
        "encounter_id", "attempt", "validated", F.col("content").alias("clean_content"), F.array("flag").alias("compliance_flags"),
        F.array().cast("array<string>").alias("errors"), "should_retry",
    )
    out = O.unavailable_result(attempts.select("encounter_id", "attempt"), results, ["encounter_id", "attempt"])
    return out.select("encounter_id", "attempt", "validated", F.col("clean_content").alias("content"), bar("compliance_flags").alias("flags"), "should_retry")


@query(
    "is_misroute",
    f"{ctes('corrections')} SELECT encounter_id, original_category, corrected_category FROM corrections WHERE corrected_category <> '' AND corrected_category <> original_category",
)
def is_misroute(spark, d):
    df = load(spark, d, "corrections")
    return df.filter(D.is_misroute(F.col("original_category"), F.col("corrected_category"))).select("encounter_id", "original_category", "corrected_category")


@query(
    "misroute_matrix",
    f"""{ctes('corrections')} SELECT original_category, corrected_category, count(*) AS n, round(avg(classifier_confidence), 6) AS avg_confidence
FROM corrections WHERE corrected_category <> '' AND corrected_category <> original_category GROUP BY ALL""",
)
def misroute_matrix(spark, d):
    df = load(spark, d, "corrections")
    out = approvals.misroute_matrix(df.filter(D.is_misroute(F.col("original_category"), F.col("corrected_category"))))
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "vitals_contradiction",
    f"""{_parsed('extraction_json')} SELECT encounter_id, coalesce(CAST(split_part(json_extract_string(j, '$.vitals.blood_pressure'), '/', 1) AS DOUBLE) > 180
  AND json_extract_string(CASE WHEN json_valid(decision_json) THEN decision_json END, '$.level') = 'Non-Urgent', false) AS contradiction FROM p""",
)
def vitals_contradiction(spark, d):
    df = O.parse_extraction(load(spark, d, "responses"), "extraction_json")
    df = O.parse_decision(df, "decision_json", "model", "model")
    return df.select("encounter_id", D.vitals_contradiction(F.col("decision.level"), F.col("extraction.vitals.blood_pressure")).alias("contradiction"))


@query(
    "medication_interaction",
    """WITH taken AS (SELECT DISTINCT l_orderkey AS encounter_id, 'drug-' || (l_partkey % 50) AS drug FROM lineitem),
rules AS (SELECT DISTINCT 'drug-' || (p_partkey % 50) AS drug_a, 'drug-' || ((p_partkey % 50 + 7) % 50) AS drug_b FROM part)
SELECT CAST(a.encounter_id AS STRING) AS encounter_id, drug_a, drug_b FROM rules JOIN taken a ON a.drug = drug_a JOIN taken b ON b.drug = drug_b AND b.encounter_id = a.encounter_id""",
)
def medication_interaction(spark, d):
    from caretide.sources.tables import table

    taken = table(spark, d, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS encounter_id", "'drug-' || (l_partkey % 50) AS drug")
    rules = table(spark, d, "part").selectExpr("'drug-' || (p_partkey % 50) AS drug_a", "'drug-' || ((p_partkey % 50 + 7) % 50) AS drug_b", "'risk' AS effect").distinct()
    return dashboards.medication_interactions(taken, rules).drop("effect")
