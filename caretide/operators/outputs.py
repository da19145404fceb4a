"""Model outputs: parsing with fail-safe defaults, schema validation, dispatch, retries."""

from pyspark.sql import Column, DataFrame, functions as F

from caretide import schemas, settings as S
from caretide.functions import decisions, variants as V
from caretide.operators.redaction import scan_pii, strip_phi


def _flags(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _error_name(text: Column, obj: Column, missing: Column) -> Column:
    """Why a response could not be read: not JSON, a mandatory key absent, or a value of the wrong type."""
    return (
        F.when(F.try_parse_json(text).isNull(), "JSONDecodeError")
        .when(obj.isNotNull() & missing, "KeyError")
        .otherwise("TypeError")
    )


def _with_object(df: DataFrame, content: str) -> DataFrame:
    """Everything but an object counts as unreadable."""
    return df.withColumn("__obj", V.parse_object(F.col(content)))


def parse_classification(
    df: DataFrame, content: str, call_ok: str | None = None, error_type: str | None = None
) -> DataFrame:
    """Adds ``category``, ``confidence``, ``reason``; failures fall back to the default category."""
    df = _with_object(df, content)
    obj = F.col("__obj")
    keys = ["category", "confidence", "reason"]
    missing = ~(V.present(obj, keys[0]) & V.present(obj, keys[1]) & V.present(obj, keys[2]))
    category, confidence, reason = V.string_member(obj, keys[0]), V.number_member(obj, keys[1]), V.get(obj, keys[2], "string")
    called = F.lit(True) if call_ok is None else F.coalesce(F.col(call_ok), F.lit(False))
    good = called & obj.isNotNull() & ~missing & category.isNotNull() & confidence.isNotNull()
    good = F.coalesce(good, F.lit(False))
    failure = F.when(
        ~called, F.concat(F.lit("classifier_timeout: "), F.col(error_type) if error_type else F.lit("TimeoutError"))
    ).otherwise(F.concat(F.lit("classifier_parse_error: "), _error_name(F.col(content), obj, missing)))
    return df.withColumns(
        {
            "category": F.when(good, category).otherwise("symptom_assessment"),
            "confidence": F.when(good, confidence).otherwise(0.0),
            "reason": F.when(good, reason).otherwise(failure),
        }
    ).drop("__obj")


def parse_extraction(df: DataFrame, content: str) -> DataFrame:
    """Adds the typed ``extraction`` record, ``extraction_failed``, ``extraction_error``."""
    df = _with_object(df, content)
    obj = F.col("__obj")
    failed = obj.isNull()
    record = F.struct(
        F.struct(
            *[V.get(obj, f"vitals.{n}", "double").alias(n) for n in ["heart_rate", "temperature", "respiratory_rate", "spo2"]],
            V.get(obj, "vitals.blood_pressure", "string").alias("blood_pressure"),
        ).alias("vitals"),
        V.get(obj, "symptoms", schemas.EXTRACTION_SYMPTOMS).alias("symptoms"),
        V.get(obj, "medications", schemas.EXTRACTION_MEDICATIONS).alias("medications"),
        F.struct(
            *[V.get(obj, f"history.{n}", "array<string>").alias(n) for n in ["conditions", "allergies", "surgeries"]]
        ).alias("history"),
        V.get(obj, "chief_complaint", "string").alias("chief_complaint"),
        V.get(obj, "assessment_notes", "string").alias("assessment_notes"),
    )
    return df.withColumns(
        {
            "extraction": record,
            "extraction_failed": failed,
            "extraction_error": F.when(failed, "Extractor failed to parse LLM output"),
        }
    ).drop("__obj")


def parse_decision(df: DataFrame, content: str, model: str, routing_reason: str) -> DataFrame:
    """Adds the ``decision`` record and ``decision_failed``."""
    df = _with_object(df, content)
    obj = F.col("__obj")
    level, confidence, summary = (
        V.string_member(obj, "level"), V.number_member(obj, "confidence"), V.string_member(obj, "reasoning_summary"),
    )
    keys = [V.present(obj, k) for k in ("level", "confidence", "reasoning_summary")]
    missing = ~(keys[0] & keys[1] & keys[2])
    good = F.coalesce(obj.isNotNull() & level.isNotNull() & confidence.isNotNull() & summary.isNotNull(), F.lit(False))
    actions = V.get_or(obj, "recommended_actions", "array<string>", _flags())
    record = F.struct(
        F.when(good, level).otherwise("Manual_Review_Required").alias("level"),
        F.when(good, confidence).otherwise(0.0).alias("confidence"),
        F.when(good, summary)
        .otherwise(F.concat(F.lit("Reasoner parse error: "), _error_name(F.col(content), obj, missing)))
        .alias("reasoning_summary"),
        F.when(good, actions).otherwise(_flags("Manual clinical review required")).alias("recommended_actions"),
        F.when(good, V.get(obj, "key_findings", "array<string>")).alias("key_findings"),
        F.col(model).alias("model_used"),
        F.when(good, F.col(routing_reason)).otherwise("parse_failure_fallback").alias("routing_reason"),
    )
    return df.withColumns({"decision": record, "decision_failed": ~good}).drop("__obj")


def parse_sentinel(df: DataFrame, content: str) -> DataFrame:
    """Adds ``hallucination_score``, ``confidence_score``, ``vitals_ok``, ``meds_ok``, ``issues_found``,
    ``check_failed``; anything unreadable fails safe."""
    df = _with_object(df, content)
    obj = F.col("__obj")
    hallucination, confidence = V.number_member(obj, "hallucination_score"), V.number_member(obj, "confidence_assessment")
    vitals, meds = V.boolean_member(obj, "vitals_consistent"), V.boolean_member(obj, "medication_safe")
    good = hallucination.isNotNull() & confidence.isNotNull() & vitals.isNotNull() & meds.isNotNull()
    return df.withColumns(
        {
            "hallucination_score": F.when(good, hallucination).otherwise(1.0),
            "confidence_score": F.when(good, confidence).otherwise(0.0),
            "vitals_ok": F.when(good, vitals).otherwise(False),
            "meds_ok": F.when(good, meds).otherwise(False),
            "issues_found": F.when(good, V.get(obj, "issues_found", "array<string>")),
            "check_failed": ~good,
        }
    ).drop("__obj")


def circuit_breaker(df: DataFrame, parse_failed: Column) -> DataFrame:
    """Adds ``sentinel_check`` to the columns of ``parse_sentinel``."""
    return df.withColumn(
        "sentinel_check",
        decisions.safety_check(
            F.col("hallucination_score"), F.col("confidence_score"), F.col("vitals_ok"), F.col("meds_ok"), parse_failed
        ),
    )


def validate_schema(df: DataFrame, content: str, node: str) -> DataFrame:
    """Adds ``schema_valid``, ``schema_flags``, ``schema_errors`` (at most five ``path rule`` entries)."""
    df = df.withColumn("__json", F.try_parse_json(F.col(content)))
    df = df.withColumn("__errors", V.node_schema_errors(F.col("__json"), F.col(node)))
    known = F.coalesce(F.col(node).isin(*S.NODE_SCHEMAS), F.lit(False))
    bad_json = F.col("__json").isNull()
    valid = ~known | (~bad_json & (F.size("__errors") == 0))
    prefix = F.when(~known, "FHIR_SCHEMA_MISSING_").when(valid, "FHIR_VALID_").otherwise("FHIR_INVALID_")
    errors = F.when(known & bad_json, _flags("invalid_json")).when(known, F.col("__errors")).otherwise(_flags())
    return df.withColumns(
        {
            "schema_valid": valid,
            "schema_flags": F.array(F.concat(prefix, F.upper(F.col(node)))),
            "schema_errors": errors,
        }
    ).drop("__json", "__errors")


def validate(df: DataFrame) -> DataFrame:
    """Dispatch on ``validation_type`` over ``content``, ``node_name``, ``tokens_in``, ``tokens_out``.

    Adds ``validated``, ``clean_content``, ``compliance_flags``, ``redactions``, ``errors``, ``should_retry``.
    Audit rows get the health-identifier pass only; schema checks see the masked text.
    """
    kind = F.col("validation_type")
    df = strip_phi(scan_pii(df.withColumn("__audit", F.when(kind == "audit", F.col("content"))), "content"), "__audit")
    df = validate_schema(df, "pii_text", "node_name")
    is_audit, is_input = kind == "audit", kind == "input"
    guard_in = decisions.token_guard(F.coalesce(F.col("tokens_in"), F.lit(0)), "input")
    guard_out = decisions.token_guard(F.coalesce(F.col("tokens_out"), F.lit(0)), "output")
    guard = F.when(is_input, guard_in).otherwise(guard_out)
    guard_errors = F.array_compact(F.array(guard["error"]))
    flags = (
        F.when(is_audit, F.col("phi_flags"))
        .when(is_input, F.concat(F.col("pii_flags"), F.array(guard["flag"])))
        .otherwise(F.concat(F.col("pii_flags"), F.array(guard["flag"]), F.col("schema_flags")))
    )
    errors = (
        F.when(is_audit, _flags())
        .when(is_input, guard_errors)
        .otherwise(F.concat(guard_errors, F.col("schema_errors")))
    )
    df = df.withColumns(
        {
            "compliance_flags": flags,
            "errors": errors,
            "clean_content": F.when(is_audit, F.col("phi_text")).otherwise(F.col("pii_text")),
            "redactions": F.when(is_audit, F.col("phi_redactions")).otherwise(F.col("pii_redactions")),
            "should_retry": (kind == "output") & ~F.col("schema_valid"),
        }
    )
    df = df.withColumn("validated", F.size("errors") == 0)
    return df.drop("__audit", "schema_valid", "schema_flags", "schema_errors").drop(
        *[f"{p}_{c}" for p in ("pii", "phi") for c in ("text", "redactions", "flags")]
    )


def unavailable_result(requests: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Requests with no validation result are blocked: empty content, flagged, to be retried."""
    hit = results.withColumn("__hit", F.lit(True))
    out = requests.join(hit, key, "left")
    miss = F.col("__hit").isNull()
    return out.withColumns(
        {
            "validated": F.when(miss, False).otherwise(F.col("validated")),
            "clean_content": F.when(miss, "").otherwise(F.col("clean_content")),
            "compliance_flags": F.when(miss, _flags("SIDECAR_UNAVAILABLE")).otherwise(F.col("compliance_flags")),
            "errors": F.when(miss, _flags("Sidecar validation unavailable — content blocked")).otherwise(F.col("errors")),
            "should_retry": F.when(miss, True).otherwise(F.col("should_retry")),
        }
    ).drop("__hit")


def _attempt_slots(name: str, mine: Column, carry: list[str]) -> list[Column]:
    """Aggregates for one retry loop: a slot per attempt and the number of the attempt to accept."""
    attempt, last = F.col("attempt"), S.MAX_RETRIES
    packed = F.struct("should_retry", "validated", "compliance_flags", *carry)
    # of an attempt that was delivered twice the greatest record counts, on every run the same
    slots = [F.max(F.when(mine & (attempt == i), packed)).alias(f"{name}_a{i}") for i in range(last + 1)]
    done = mine & attempt.between(0, last) & (~F.col("should_retry") | (attempt == last))
    return [*slots, F.min(F.when(done, attempt)).alias(f"{name}_accepted")]


def _settle(slots: DataFrame, names: list[str], carry: list[str]) -> DataFrame:
    """Per name, the record of the accepted attempt with the flags of all attempts made; NULL while none is
    accepted."""
    last = S.MAX_RETRIES

    def chosen(name: str) -> Column:
        out = F
        for i in range(last + 1):
            out = out.when(F.col(f"{name}_accepted") == i, F.col(f"{name}_a{i}"))
        return out

    def flags(name: str, i: int) -> Column:
        made = F.when(F.col(f"{name}_accepted") >= i, F.col(f"{name}_a{i}.compliance_flags"))
        return F.coalesce(made, _flags())

    def record(name: str) -> Column:
        c, accepted = F.col(f"{name}_c"), F.col(f"{name}_accepted")
        exhausted = F.when((accepted == last) & ~c["validated"], _flags("FHIR_RETRY_EXHAUSTED")).otherwise(_flags())
        all_flags = F.concat(*[flags(name, i) for i in range(last + 1)], exhausted)
        fields = [accepted.alias("attempt"), all_flags.alias("compliance_flags")]
        return F.when(accepted.isNotNull(), F.struct(*fields, *[c[f].alias(f) for f in ("validated", *carry)]))

    picked = slots.withColumns({f"{n}_c": chosen(n) for n in names})
    done = picked.withColumns({n: record(n) for n in names})
    return done.drop(*[f"{n}_{x}" for n in names for x in ("c", "accepted", *[f"a{i}" for i in range(last + 1)])])


def resolve_retries(attempts: DataFrame, key: list[str], carry: list[str]) -> DataFrame:
    """The attempt each (encounter, node) settles on.

    ``attempts`` has ``attempt`` (0-based), ``should_retry``, ``validated``, ``compliance_flags``. Only the first
    three attempts are ever made, so a fixed slot per attempt replaces a collected list and the whole
    operator is one partially aggregated shuffle, whatever the key distribution.
    """
    slots = attempts.groupBy(*key).agg(*_attempt_slots("r", F.lit(True), carry))
    return _settle(slots, ["r"], carry).filter("r IS NOT NULL").select(*key, "r.*")


def unsettled_retries(attempts: DataFrame, key: list[str]) -> DataFrame:
    """The (encounter, node) pairs that ``resolve_retries`` has no attempt for: every one so far asks for a retry and the
    last is still to come. ``attempts_made`` counts the different ones."""
    last, attempt = S.MAX_RETRIES, F.col("attempt")
    done = attempt.between(0, last) & (~F.col("should_retry") | (attempt == last))
    made = attempts.groupBy(*key).agg(F.max(F.coalesce(done, F.lit(False))).alias("settled"), F.count_distinct("attempt").alias("attempts_made"))
    return made.filter(~F.col("settled")).drop("settled")


def resolve_retries_by_node(attempts: DataFrame, nodes: list[str], carry: list[str]) -> DataFrame:
    """As ``resolve_retries``, one row per encounter with a settled record per node: one shuffle for all nodes."""
    node = F.col("node_name")
    slots = attempts.groupBy("encounter_id").agg(*[c for n in nodes for c in _attempt_slots(n, node == n, carry)])
    return _settle(slots, nodes, carry)


def accumulate_flags(*flags: Column) -> Column:
    """Stage flags in order, duplicates kept."""
    return F.concat(*[F.coalesce(f, _flags()) for f in flags])
