"""Rule columns: model routing, circuit breaker, cost, severity and escalation."""

from pyspark.sql import Column, functions as F

from caretide import settings as S
from caretide.functions.numbers import fixed
from caretide.functions.text import has_critical_keyword


def _lookup(key: Column, pairs: dict) -> Column:
    """A fixed, driver-known table as a literal map: no join at all."""
    entries = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), key)


def route(text: Column, category: Column, confidence: Column) -> Column:
    """Struct of selected_model, escalation_reason, safety_override.

    Takes the raw text: masking happens after routing.
    """
    critical = F.coalesce(has_critical_keyword(text), F.lit(False))
    default = _lookup(category, {c: r[0] for c, r in S.CATEGORY_ROUTING.items()})
    threshold = _lookup(category, {c: r[1] for c, r in S.CATEGORY_ROUTING.items()})
    threshold_text = _lookup(category, {c: str(r[1]) for c, r in S.CATEGORY_ROUTING.items()})
    flagged = _lookup(category, {c: r[2] for c, r in S.CATEGORY_ROUTING.items()})
    below = confidence < threshold
    stepped = F.least(F.lit(2), default + F.when(below, 1).otherwise(0))
    floor = F.when((confidence < S.MIN_ROUTING_CONFIDENCE) | flagged, 1).otherwise(0)
    tier = F.when(critical, 2).when(default.isNull(), 1).otherwise(F.greatest(stepped, floor))
    reason = (
        F.when(critical, "Critical keyword safety override")
        .when(default.isNull(), "Unknown category fallback")
        .when(
            below,
            F.concat(F.lit("Confidence "), fixed(confidence, 2), F.lit(" below threshold "), threshold_text),
        )
    )
    return F.struct(
        F.element_at(F.array(*[F.lit(m) for m in S.MODEL_TIERS]), tier + 1).alias("selected_model"),
        reason.alias("escalation_reason"),
        critical.alias("safety_override"),
    )


def call_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """USD of one model call; unknown models cost nothing."""
    per_in = F.coalesce(_lookup(model, {m: p[0] for m, p in S.MODEL_PRICES.items()}), F.lit(0.0))
    per_out = F.coalesce(_lookup(model, {m: p[1] for m, p in S.MODEL_PRICES.items()}), F.lit(0.0))
    return F.round((tokens_in * per_in + tokens_out * per_out) / 1_000_000, 8)


def breaker_tripped(hallucination: Column, confidence: Column) -> Column:
    return (hallucination > S.HALLUCINATION_THRESHOLD) | (confidence < S.CONFIDENCE_THRESHOLD)


def safety_check(
    hallucination: Column, confidence: Column, vitals_ok: Column, meds_ok: Column, parse_failed: Column
) -> Column:
    """Stored check record. Failed vitals or medications add a reason but do not trip the breaker."""
    tripped = breaker_tripped(hallucination, confidence)
    reasons = F.array(
        F.when(parse_failed, "Sentinel validation parse error — manual review required"),
        F.when(
            hallucination > S.HALLUCINATION_THRESHOLD,
            F.concat(
                F.lit("Hallucination score "), fixed(hallucination, 2),
                F.lit(f" exceeds threshold {S.HALLUCINATION_THRESHOLD}"),
            ),
        ),
        F.when(
            confidence < S.CONFIDENCE_THRESHOLD,
            F.concat(
                F.lit("Confidence "), fixed(confidence, 2),
                F.lit(f" below threshold {S.CONFIDENCE_THRESHOLD}"),
            ),
        ),
        F.when(~vitals_ok, "Vitals inconsistent with triage level"),
        F.when(~meds_ok, "Medication safety concern detected"),
    )
    return F.struct(
        (~tripped).alias("passed"),
        hallucination.alias("hallucination_score"),
        confidence.alias("confidence_score"),
        vitals_ok.alias("vitals_cross_ref_passed"),
        meds_ok.alias("medication_safety_passed"),
        tripped.alias("circuit_breaker_tripped"),
        F.array_compact(reasons).alias("failure_reasons"),
    )


def token_guard(tokens: Column, direction: str) -> Column:
    """Struct(flag, error): error is NULL when the count is within limits."""
    low, high = S.TOKEN_LIMITS[direction]
    name, title = direction.upper(), direction.capitalize()
    flag = (
        F.when(tokens < low, f"TOKEN_{name}_SUSPICIOUSLY_SHORT")
        .when(tokens > high, f"TOKEN_{name}_SUSPICIOUSLY_LONG")
        .otherwise(f"TOKEN_{name}_OK")
    )
    count = tokens.cast("string")
    error = F.when(
        tokens < low, F.concat(F.lit(f"{title} tokens ("), count, F.lit(f") below minimum ({low})"))
    ).when(tokens > high, F.concat(F.lit(f"{title} tokens ("), count, F.lit(f") above maximum ({high})")))
    return F.struct(flag.alias("flag"), error.alias("error"))


def is_misroute(original: Column, corrected: Column) -> Column:
    """A non-empty correction that differs from the original category."""
    return F.coalesce(corrected != "", F.lit(False)) & ~corrected.eqNullSafe(original)


def dlq_severity(topic: Column) -> Column:
    return _lookup(topic, S.DLQ_SEVERITY)


def escalation_stage(age_seconds: Column) -> Column:
    out = F
    for hours, stage in S.ESCALATION_STAGES:
        out = out.when(age_seconds <= hours * 3600, stage)
    return out.when(age_seconds.isNotNull(), S.ESCALATION_BREACH)


def dlq_root_cause(status: Column, message: Column) -> Column:
    """Failure mode from the response status, else from the log message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403), "authentication")
        .when((status == 400) | text.rlike("invalid message payload|missing encounter_id"), "invalid_payload")
        .when(text.rlike("permission denied|quota exceeded|schema mismatch|deadline exceeded"), "write_failure")
        .when(text.rlike("connection timed? ?out|connection timeout|dns resolution"), "network")
        .when((status >= 500) | text.rlike("crash loop|oom|out of memory"), "consumer_down")
        .otherwise("unknown")
    )


def is_replayable(cause: Column) -> Column:
    return cause != "invalid_payload"


def vitals_contradiction(level: Column, blood_pressure: Column, systolic_limit: int = 180) -> Column:
    """A non-urgent level next to a systolic pressure over the limit."""
    systolic = F.split(blood_pressure, "/")[0].try_cast("double")
    return F.coalesce((level == "Non-Urgent") & (systolic > systolic_limit), F.lit(False))


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, {s: i for i, s in enumerate(S.LOG_SEVERITIES)})
