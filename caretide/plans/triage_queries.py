"""The whole triage plan over encounters and model responses."""

from pyspark.sql import functions as F

from caretide import settings as S
from caretide.plans import triage as T
from caretide.plans.decision_queries import _NUMERIC, _absent, _routing
from caretide.plans.inputs import ctes, load
from caretide.plans.registry import query
from caretide.plans.text_queries import _critical, _injected


def responses_by_node(spark, d):
    """Every attempt of every node; all attempts of a node answer alike."""
    r = load(spark, d, "responses")
    answers = F.array(
        F.struct(F.lit("classifier").alias("node_name"), F.col("classification").alias("content")),
        F.struct(F.lit("extractor").alias("node_name"), F.col("extraction_json").alias("content")),
        F.struct(F.lit("reasoner").alias("node_name"), F.col("decision_json").alias("content")),
        F.struct(F.lit("sentinel").alias("node_name"), F.col("check_json").alias("content")),
    )
    rows = r.select("encounter_id", "call_ok", "model", "tokens_in", "tokens_out", F.explode(answers).alias("a"))
    rows = rows.select("encounter_id", "call_ok", "model", "tokens_in", "tokens_out", "a.*")
    attempts = rows.withColumn("attempt", F.explode(F.array(*[F.lit(i) for i in range(S.MAX_RETRIES + 1)])))
    return attempts.withColumns({"cost_usd": F.lit(0.001), "duration_ms": F.lit(100)})


def _object(column: str, name: str) -> str:
    return f"CASE WHEN json_valid({column}) AND json_type(CASE WHEN json_valid({column}) THEN {column} END) = 'OBJECT' THEN {column} END AS {name}"


def _good(name: str, keys: tuple[str, ...]) -> str:
    return f"coalesce({name} IS NOT NULL AND NOT ({_absent(*keys).replace('(j,', f'({name},')}) AND json_type({name}, '$.confidence') IN {_NUMERIC}, false)"


_triage_sql = f"""{ctes('encounters', 'responses')}, {_routing},
fit AS (SELECT encounter_id, encounter_text FROM encounters WHERE length(encounter_text) BETWEEN {S.MIN_TEXT_CHARS} AND {S.MAX_TEXT_CHARS} AND NOT {_injected}),
p AS (SELECT f.*, coalesce(r.call_ok, false) AS called, r.model, {_object('classification', 'cj')}, {_object('decision_json', 'dj')}, {_object('check_json', 'sj')}, {_object('extraction_json', 'xj')}
  FROM fit f LEFT JOIN responses r USING (encounter_id)),
g AS (SELECT *, called AND {_good('cj', ('category', 'confidence', 'reason'))} AS cg, {_good('dj', ('level', 'confidence', 'reasoning_summary'))} AS dg,
  coalesce(json_type(sj, '$.hallucination_score') IN {_NUMERIC} AND json_type(sj, '$.confidence_assessment') IN {_NUMERIC} AND json_type(sj, '$.vitals_consistent') = 'BOOLEAN' AND json_type(sj, '$.medication_safe') = 'BOOLEAN', false) AS sg FROM p),
c AS (SELECT *, CASE WHEN cg THEN json_extract_string(cj, '$.category') ELSE 'symptom_assessment' END AS category, CASE WHEN cg THEN CAST(json_extract_string(cj, '$.confidence') AS DOUBLE) ELSE 0.0 END AS confidence,
  CASE WHEN sg THEN CAST(json_extract_string(sj, '$.hallucination_score') AS DOUBLE) ELSE 1.0 END AS h, CASE WHEN sg THEN CAST(json_extract_string(sj, '$.confidence_assessment') AS DOUBLE) ELSE 0.0 END AS s FROM g),
t AS (SELECT c.*, CASE WHEN {_critical} THEN 2 WHEN base IS NULL THEN 1 ELSE greatest(least(2, base + CASE WHEN confidence < threshold THEN 1 ELSE 0 END), CASE WHEN confidence < 0.70 OR flagged THEN 1 ELSE 0 END) END AS tier
  FROM c LEFT JOIN routing USING (category))
SELECT encounter_id, category, CASE tier WHEN 0 THEN '{S.LOW_TIER}' WHEN 1 THEN '{S.MIDDLE_TIER}' ELSE '{S.TOP_TIER}' END AS selected_model,
  CASE WHEN dg THEN json_extract_string(dj, '$.level') ELSE 'Manual_Review_Required' END AS level, CASE WHEN dg THEN CAST(json_extract_string(dj, '$.confidence') AS DOUBLE) ELSE 0.0 END AS confidence,
  NOT (h > 0.15 OR s < 0.85) AS passed, (h > 0.15 OR s < 0.85) AS tripped, (xj IS NULL OR NOT dg) AS stage_breaker FROM t"""


@query(
    "triage_rejects",
    f"""{ctes('encounters')}, j AS (SELECT encounter_id, CASE WHEN NOT length(encounter_text) BETWEEN {S.MIN_TEXT_CHARS} AND {S.MAX_TEXT_CHARS} THEN 'length'
  WHEN {_injected} THEN 'prompt_injection' END AS reject_reason FROM encounters) SELECT * FROM j WHERE reject_reason IS NOT NULL""",
)
def triage_rejects(spark, d):
    return T.accept(load(spark, d, "encounters").select("encounter_id", "encounter_text"))[1].select("encounter_id", "reject_reason")


@query("triage", _triage_sql)
def triage(spark, d):
    out = T.triage(load(spark, d, "encounters").select("encounter_id", "encounter_text"), responses_by_node(spark, d))
    return out.select(
        "encounter_id", "category", "routing.selected_model", "decision.level", "decision.confidence",
        "sentinel_check.passed", F.col("circuit_breaker_tripped").alias("tripped"), "stage_breaker",
    )
