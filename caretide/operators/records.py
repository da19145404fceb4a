"""Row shaping: audit rows, feedback rows, events, sessions, queue entries, prompts."""

from pyspark.sql import Column, DataFrame, functions as F

from caretide.functions import labels, text as tx, variants as V
from caretide.operators.redaction import strip_phi


def parse_time(text: Column) -> Column:
    """ISO-8601 text with ``Z`` or an offset to a timestamp; NULL when unreadable."""
    return F.try_to_timestamp(text)


def flatten_audit(df: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Audit document to the 15 ``audit_trail`` columns.

    An absent node, model or flag list gets a default; one that is present with null stays null.
    A null routing, token or check object reads as empty.
    """
    d = F.col(doc)
    empty = F.array().cast("array<string>")
    return df.select(
        V.get(d, "encounter_id", "string").alias("encounter_id"),
        V.get_or(d, "node", "string", F.lit("")).alias("node_name"),
        V.get_or(d, "model", "string", F.lit("")).alias("model_used"),
        V.get(d, "routing_decision.category", "string").alias("routing_category"),
        V.get(d, "routing_decision.confidence", "double").alias("routing_confidence"),
        V.get(d, "tokens.in", "bigint").alias("input_tokens"),
        V.get(d, "tokens.out", "bigint").alias("output_tokens"),
        V.get(d, "cost_usd", "double").alias("cost_usd"),
        F.col(body).alias("reasoning_snapshot"),
        V.get_or(d, "compliance_flags", "array<string>", empty).alias("compliance_flags"),
        V.get(d, "sentinel_check.hallucination_score", "double").alias("sentinel_hallucination_score"),
        V.get(d, "sentinel_check.confidence_score", "double").alias("sentinel_confidence_score"),
        V.get(d, "sentinel_check.circuit_breaker_tripped", "boolean").alias("circuit_breaker_tripped"),
        V.get(d, "duration_ms", "bigint").alias("duration_ms"),
        parse_time(V.get(d, "timestamp", "string")).alias("created_at"),
    )


FEEDBACK_KEYS = ["original_category", "corrected_category", "reviewer_id"]


def judge_feedback(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``reject_reason``: set where a mandatory key is missing."""
    complete = F.lit(True)
    for k in FEEDBACK_KEYS:
        complete = complete & V.present(F.col(doc), k)
    return df.withColumn("reject_reason", F.when(~complete, "missing_feedback_field"))


def flatten_feedback(df: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(classifier_feedback rows, rejects missing a mandatory key)."""
    d, judged = F.col(doc), judge_feedback(df, doc)
    rows = judged.filter(F.col("reject_reason").isNull()).select(
        V.get(d, "encounter_id", "string").alias("encounter_id"),
        V.get(d, "original_category", "string").alias("original_category"),
        V.get(d, "corrected_category", "string").alias("corrected_category"),
        V.get(d, "classifier_confidence", "double").alias("classifier_confidence"),
        V.get(d, "reviewer_id", "string").alias("reviewer_id"),
        parse_time(V.get(d, "timestamp", "string")).alias("created_at"),
    )
    return rows, judged.filter(F.col("reject_reason").isNotNull())


def build_audit_doc(df: DataFrame, clock: Column) -> DataFrame:
    """The 12-field audit document of one node step, from its flat columns. Health identifiers are stripped from both
    summaries, and the flags of both passes follow those of the step."""
    df = strip_phi(strip_phi(df, "input_summary", "__in_"), "output_summary", "__out_")
    df = df.withColumns(
        {
            "input_summary": F.col("__in_text"),
            "output_summary": F.col("__out_text"),
            "compliance_flags": F.concat("compliance_flags", "__in_flags", "__out_flags"),
        }
    )
    return df.select(
        "encounter_id", "node", "model", "routing_decision", "input_summary", "output_summary",
        "tokens", "cost_usd", "compliance_flags", "sentinel_check", "duration_ms", clock.alias("timestamp"),
    )


def latest_audit_ref(trail: Column) -> Column:
    return F.coalesce(F.try_element_at(trail, F.lit(-1))["audit_ref"], F.lit(""))


def _default(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def build_triage_completed(df: DataFrame, clock: Column) -> DataFrame:
    """Event for the approval queue. Defaults apply only where the whole decision or check is missing,
    so an explicit null routing reason stays null."""
    d, c = F.col("decision"), F.col("sentinel_check")
    no_d, no_c = d.isNull(), c.isNull()
    result = F.struct(
        F.when(no_d, "Unknown").otherwise(d["level"]).alias("level"),
        F.when(no_d, 0.0).otherwise(d["confidence"]).alias("confidence"),
        F.when(no_d, "").otherwise(d["reasoning_summary"]).alias("reasoning_summary"),
        F.when(no_d, "").otherwise(d["model_used"]).alias("model_used"),
        F.when(no_d, "").otherwise(d["routing_reason"]).alias("routing_reason"),
    )
    check = F.struct(
        F.when(no_c, False).otherwise(c["passed"]).alias("passed"),
        F.when(no_c, 1.0).otherwise(c["hallucination_score"]).alias("hallucination_score"),
        F.when(no_c, 0.0).otherwise(c["confidence_score"]).alias("confidence_score"),
    )
    return df.select(
        "encounter_id", "patient_id", result.alias("triage_result"), check.alias("sentinel_check"),
        clock.alias("timestamp"), latest_audit_ref(F.col("audit_trail")).alias("audit_ref"),
    )


def build_session(df: DataFrame, clock: Column) -> DataFrame:
    return df.select(
        "encounter_id",
        F.lit("pending").alias("status"),
        _default(F.col("decision.level"), "Unknown").alias("triage_level"),
        _default(F.col("circuit_breaker_tripped"), False).alias("circuit_breaker_tripped"),
        clock.alias("updated_at"),
    )


def build_triage_response(df: DataFrame, clock: Column) -> DataFrame:
    d, c = F.col("decision"), F.col("sentinel_check")
    return df.select(
        "encounter_id",
        "patient_id",
        _default(d["level"], "Unknown").alias("triage_level"),
        _default(d["confidence"], 0.0).alias("confidence"),
        _default(d["reasoning_summary"], "").alias("reasoning_summary"),
        _default(d["model_used"], "").alias("model_used"),
        _default(F.col("category"), "").alias("routing_category"),
        _default(c["passed"], False).alias("sentinel_passed"),
        _default(c["hallucination_score"], 1.0).alias("hallucination_score"),
        _default(F.col("circuit_breaker_tripped"), False).alias("circuit_breaker_tripped"),
        latest_audit_ref(F.col("audit_trail")).alias("audit_ref"),
        clock.alias("timestamp"),
    )


def build_queue_entry(events: DataFrame, clock: Column) -> DataFrame:
    """Approval entry of a triage-completed event."""
    at = F.coalesce(F.col("timestamp"), clock)
    return events.select(
        "encounter_id",
        _default(F.col("patient_id"), "").alias("patient_id"),
        "triage_result",
        "sentinel_check",
        F.lit("pending_approval").alias("status"),
        at.alias("created_at"),
        at.alias("updated_at"),
        _default(F.col("audit_ref"), "").alias("audit_ref"),
    )


def build_full_session(df: DataFrame, clock: Column) -> DataFrame:
    """Session row as the submission form writes it."""
    return df.withColumns(
        {
            "raw_input": F.trim("encounter_text"),
            "patient_id": tx.blank_to(F.col("patient_id"), "unassigned"),
            "status": F.lit("pending"),
            "created_at": clock,
            "updated_at": clock,
            "submitted_by": _default(F.col("submitted_by"), "unknown"),
        }
    ).drop("encounter_text")


TRAIL_FIELDS = ["encounter_id", "node", "model", "tokens", "cost_usd", "duration_ms", "audit_ref"]


def audit_trail_entry(steps: DataFrame, nodes: list[str]) -> DataFrame:
    """One ordered trail per encounter with the latest step of each node in ``nodes``.

    A fixed slot per node keeps the aggregate bounded and map-side combinable.
    """
    entry = F.struct(*TRAIL_FIELDS)
    slots = steps.groupBy("encounter_id").agg(
        *[F.max_by(entry, F.when(F.col("node") == n, F.struct("ts", "seq"))).alias(f"s{i}") for i, n in enumerate(nodes)]
    )
    trail = F.array_compact(F.array(*[F.col(f"s{i}") for i in range(len(nodes))]))
    return slots.select("encounter_id", trail.alias("audit_trail"))


def append_trail(trail: Column, entry: Column) -> Column:
    return F.concat(F.coalesce(trail, F.array().cast("array<string>")), entry)


def _pretty(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})


def reasoner_prompt(context: Column, cases: Column) -> Column:
    """Prompt text; the retrieved-cases part is left out when there are none."""
    section = F.when(
        F.coalesce(F.size(cases), F.lit(0)) > 0,
        F.concat(F.lit("\n\nSimilar cases for reference:\n"), F.to_json(cases, {"ignoreNullFields": "false"})),
    ).otherwise("")
    return F.concat(F.lit("Clinical data:\n"), _pretty(context), section)


def sentinel_prompt(context: Column, decision: Column) -> Column:
    return F.concat(
        F.lit("Original clinical data:\n"), _pretty(context), F.lit("\n\nTriage decision:\n"), _pretty(decision)
    )


def classifier_prompt(categories: list[str]) -> str:
    """Instruction text for the classifier; the encounter text follows as the user message."""
    return (
        "Sort the clinical encounter into exactly one category and give a confidence.\n\n"
        f"Categories: {', '.join(categories)}\n\n"
        'Answer only with JSON: {"category": "<category>", "confidence": <0.0-1.0>, "reason": "<brief reason>"}'
    )


def queue_row(sessions: DataFrame) -> DataFrame:
    """Dashboard row with its labels and bands."""
    level = _default(F.col("level"), "—")
    return sessions.select(
        "encounter_id",
        "patient_id",
        level.alias("level"),
        labels.level_band(level).alias("level_band"),
        _default(labels.confidence_label(F.col("confidence")), "—").alias("confidence"),
        labels.confidence_band(F.col("confidence")).alias("confidence_band"),
        labels.model_family(_default(F.col("selected_model"), "")).alias("model"),
        "status",
        labels.status_band(F.col("status")).alias("status_band"),
        F.when(F.col("circuit_breaker_tripped"), "CB Tripped").otherwise("").alias("flags"),
        labels.date_label(F.col("updated_at")).alias("updated"),
    )
