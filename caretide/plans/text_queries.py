"""Masking, screening and label queries over encounter texts."""

from pyspark.sql import functions as F

from caretide import settings as S
from caretide.functions import text as tx
from caretide.operators import outputs as O, redaction as R, screening
from caretide.plans.inputs import ctes, load, quoted
from caretide.plans.registry import bar, query


def mask_sql(source: str, text: str, patterns: list[tuple[str, str]], tag: str, extra: str = "") -> str:
    """CTEs m0..mN: each step counts one pattern and replaces it in the text left by the step before."""
    steps = [f"m0 AS (SELECT encounter_id{extra}, {text} AS t FROM {source})"]
    for i, (name, pattern) in enumerate(patterns):
        p = quoted(pattern)
        steps.append(
            f"m{i + 1} AS (SELECT * EXCLUDE (t), CAST(len(regexp_extract_all(t, {p})) AS INT) AS n_{name}, "
            f"regexp_replace(t, {p}, {quoted(tag)}, 'g') AS t FROM m{i})"
        )
    return ",\n".join(steps)


def found_sql(patterns: list[tuple[str, str]], cell: str) -> str:
    cells = ", ".join(f"CASE WHEN n_{n} > 0 THEN {cell.format(name=n)} END" for n, _ in patterns)
    return f"concat_ws('|', {cells})"


def _redactions(column: str):
    return bar(F.transform(column, lambda r: F.concat(r["type"], F.lit(":"), r["count"].cast("string"))))


def _scan_sql(patterns, tag, flag, clean, first=""):
    n = len(patterns)
    names = found_sql(patterns, f"'{flag}{{name}}'")
    counts = found_sql(patterns, "'{name}:' || n_{name}")
    return (
        f"{ctes('encounters')},\n{mask_sql('encounters', 'encounter_text', patterns, tag)}\n"
        f"SELECT encounter_id, t AS masked, {counts} AS redactions, "
        f"CASE WHEN {counts} = '' THEN '{clean}' ELSE '{first}' || {names} END AS flags FROM m{n}"
    )


@query("scan_pii", _scan_sql(S.PII_PATTERNS, S.PII_TAG, "PII_MASKED_", "PII_CLEAN"))
def scan_pii(spark, d):
    df = R.scan_pii(load(spark, d, "encounters").select("encounter_id", "encounter_text"), "encounter_text")
    return df.select("encounter_id", F.col("pii_text").alias("masked"), _redactions("pii_redactions").alias("redactions"), bar("pii_flags").alias("flags"))


@query("scan_pii_any_case", _scan_sql(S.PII_PATTERNS_ANY_CASE, S.PII_TAG, "PII_MASKED_", "PII_CLEAN"))
def scan_pii_any_case(spark, d):
    df = R.scan_pii(load(spark, d, "encounters").select("encounter_id", "encounter_text"), "encounter_text", any_case=True)
    return df.select("encounter_id", F.col("pii_text").alias("masked"), _redactions("pii_redactions").alias("redactions"), bar("pii_flags").alias("flags"))


@query("strip_phi", _scan_sql(S.PHI_PATTERNS, S.PHI_TAG, "PHI_STRIPPED_", "PHI_CLEAN", "PHI_REDACTED|"))
def strip_phi(spark, d):
    df = R.strip_phi(load(spark, d, "encounters").select("encounter_id", "encounter_text"), "encounter_text")
    return df.select("encounter_id", F.col("phi_text").alias("masked"), _redactions("phi_redactions").alias("redactions"), bar("phi_flags").alias("flags"))


_counted = " UNION ALL ".join(
    f"SELECT lang, '{n}' AS type, CAST(sum(n_{n}) AS BIGINT) AS n_matches, count(*) AS n_texts FROM m{len(S.PII_PATTERNS)} WHERE n_{n} > 0 GROUP BY lang"
    for n, _ in S.PII_PATTERNS
)


@query(
    "redaction_summary",
    f"{ctes('encounters')},\n"
    f"{mask_sql('encounters', 'encounter_text', S.PII_PATTERNS, S.PII_TAG, ', lang')}\n{_counted}",
)
def redaction_summary(spark, d):
    """Masking of every text, then counts by language and type: one map-side pass and one small shuffle."""
    return R.redaction_summary(load(spark, d, "encounters").select("encounter_id", "encounter_text", "lang"), "encounter_text", ["lang"])


@query("filter_length", f"{ctes('encounters')} SELECT encounter_id, length(encounter_text) AS n FROM encounters WHERE length(encounter_text) BETWEEN 10 AND 50000")
def filter_length(spark, d):
    df = screening.filter_length(load(spark, d, "encounters"), "encounter_text")
    return df.select("encounter_id", F.char_length("encounter_text").cast("bigint").alias("n"))


_injected = "regexp_matches(encounter_text, " + quoted("(?i)(?:" + "|".join(S.INJECTION_PATTERNS) + ")") + ")"


@query("filter_prompt_injection", f"{ctes('encounters')} SELECT encounter_id, CASE WHEN {_injected} THEN 'prompt_injection' END AS reject_reason FROM encounters")
def filter_prompt_injection(spark, d):
    judged = screening.judge_injection(load(spark, d, "encounters").select("encounter_id", "encounter_text"), "encounter_text")
    return judged.select("encounter_id", "reject_reason")


_critical = "(" + " OR ".join(f"contains(lower(encounter_text), {quoted(w)})" for w in S.CRITICAL_KEYWORDS) + ")"


@query("has_critical_keyword", f"{ctes('encounters')} SELECT encounter_id, {_critical} AS critical FROM encounters")
def has_critical_keyword(spark, d):
    df = load(spark, d, "encounters")
    return df.select("encounter_id", tx.has_critical_keyword(F.col("encounter_text")).alias("critical"))


@query("truncate", f"{ctes('encounters')} SELECT encounter_id, substr(encounter_text, 1, 500) AS summary FROM encounters")
def truncate(spark, d):
    df = load(spark, d, "encounters")
    return df.select("encounter_id", tx.summary(F.col("encounter_text")).alias("summary"))


@query(
    "audit_summary",
    f"{ctes('encounters')},\n{mask_sql('encounters', 'substr(encounter_text, 1, 500)', S.PHI_PATTERNS, S.PHI_TAG)}\nSELECT encounter_id, t AS summary FROM m{len(S.PHI_PATTERNS)}",
)
def audit_summary(spark, d):
    """Cut first, then strip, as the audit writer does."""
    df = load(spark, d, "encounters").select("encounter_id", tx.summary(F.col("encounter_text")).alias("cut"))
    return R.strip_phi(df, "cut").select("encounter_id", F.col("phi_text").alias("summary"))


_ok = "CASE WHEN json_valid(extraction_json) THEN extraction_json END"


@query(
    "rag_query_text",
    f"""{ctes('responses')}, j AS (SELECT encounter_id, {_ok} AS j FROM responses),
t AS (SELECT encounter_id, coalesce(json_extract_string(j, '$.chief_complaint'), '') AS c,
  array_to_string(json_extract_string(j, '$.symptoms[*].description'), ', ') AS s FROM j),
q AS (SELECT encounter_id, CASE WHEN coalesce(s, '') <> '' THEN c || '. Symptoms: ' || s ELSE c END AS q FROM t)
SELECT encounter_id, CASE WHEN trim(q) <> '' THEN q END AS query_text FROM q""",
)
def rag_query_text(spark, d):
    df = O.parse_extraction(load(spark, d, "responses"), "extraction_json")
    text = tx.retrieval_text(F.col("extraction.chief_complaint"), F.col("extraction.symptoms"))
    return df.select("encounter_id", text.alias("query_text"))


@query("protocol_embed_text", f"{ctes('protocols')} SELECT id, title || '. ' || content AS text FROM protocols")
def protocol_embed_text(spark, d):
    return load(spark, d, "protocols").select("id", tx.embed_text(F.col("title"), F.col("content")).alias("text"))


def guard_sql(column: str, direction: str) -> tuple[str, str]:
    low, high = S.TOKEN_LIMITS[direction]
    up, cap = direction.upper(), direction.capitalize()
    flag = f"CASE WHEN {column} < {low} THEN 'TOKEN_{up}_SUSPICIOUSLY_SHORT' WHEN {column} > {high} THEN 'TOKEN_{up}_SUSPICIOUSLY_LONG' ELSE 'TOKEN_{up}_OK' END"
    error = f"CASE WHEN {column} < {low} THEN '{cap} tokens (' || {column} || ') below minimum ({low})' WHEN {column} > {high} THEN '{cap} tokens (' || {column} || ') above maximum ({high})' END"
    return flag, error


@query(
    "token_guard",
    f"{ctes('encounters')} SELECT encounter_id, {guard_sql('tokens_in', 'input')[0]} AS input_flag, {guard_sql('tokens_in', 'input')[1]} AS input_error, "
    f"{guard_sql('tokens_out', 'output')[0]} AS output_flag, {guard_sql('tokens_out', 'output')[1]} AS output_error FROM encounters",
)
def token_guard(spark, d):
    from caretide.functions.decisions import token_guard as guard

    a, b = guard(F.col("tokens_in"), "input"), guard(F.col("tokens_out"), "output")
    return load(spark, d, "encounters").select(
        "encounter_id", a["flag"].alias("input_flag"), a["error"].alias("input_error"),
        b["flag"].alias("output_flag"), b["error"].alias("output_error"),
    )


@query("malicious_agents", f"{ctes('requests')} SELECT log_id, user_agent FROM requests WHERE regexp_matches(user_agent, '(?i)(sqlmap|nikto|nmap|masscan|dirbuster)')")
def malicious_agents(spark, d):
    return screening.malicious_agents(load(spark, d, "requests")).select("log_id", "user_agent")


@query("build_full_session", f"{ctes('encounters')} SELECT encounter_id, trim(encounter_text) AS raw_input, CASE WHEN trim(patient) = '' THEN 'unassigned' ELSE trim(patient) END AS patient_id, 'pending' AS status, 'unknown' AS submitted_by FROM (SELECT *, CASE WHEN lang = 'fr' THEN '  ' ELSE ' pat-' || lang END AS patient FROM encounters)")
def build_full_session(spark, d):
    from caretide.operators.records import build_full_session as build

    df = load(spark, d, "encounters").selectExpr(
        "encounter_id", "encounter_text", "CASE WHEN lang = 'fr' THEN '  ' ELSE ' pat-' || lang END AS patient_id",
        "CAST(NULL AS STRING) AS submitted_by",
    )
    return build(df, F.lit("2024-01-01T00:00:00Z")).drop("created_at", "updated_at")
