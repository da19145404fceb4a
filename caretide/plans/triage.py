"""The whole triage as one lazy plan over tables of encounters and model responses."""

from pyspark.sql import Column, DataFrame, functions as F

from caretide import settings as S
from caretide.functions import decisions as D, text as tx
from caretide.operators import outputs as O, records as R, screening


def accept(encounters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(encounters fit for triage, rejects with reason)."""
    sized, short = screening.split(encounters, tx.length_ok(F.col("encounter_text")), "length")
    clean, injected = screening.filter_prompt_injection(sized, "encounter_text")
    return clean, short.unionByName(injected)


CARRY = ["content", "model", "tokens_in", "tokens_out", "cost_usd", "duration_ms"]


def settle_responses(responses: DataFrame) -> DataFrame:
    """One row per encounter: the classifier's single answer and, per node, the attempt its retries settle on.

    Attempts are validated where they are read; one shuffle by encounter then brings all of them together.
    The classifier's answer is never validated, so it counts as accepted at once.
    """
    nodes = responses.filter(F.col("node_name").isin(S.NODES))
    checked = O.validate(nodes.withColumn("validation_type", F.lit("output")))
    first = responses.filter((F.col("node_name") == "classifier") & (F.col("attempt") == 0)).withColumns(
        {"should_retry": F.lit(False), "validated": F.lit(True), "compliance_flags": F.array().cast("array<string>")}
    )
    fields = ["encounter_id", "node_name", "attempt", "should_retry", "validated", "compliance_flags", "call_ok", *CARRY]
    every = checked.select(*fields).unionByName(first.select(*fields))
    return O.resolve_retries_by_node(every, ["classifier", *S.NODES], ["call_ok", *CARRY])


def route(df: DataFrame) -> DataFrame:
    """Category from the classifier's answer (a missing one counts as a failed call), then the model tier."""
    df = df.withColumns({"__answer": F.col("classifier.content"), "__called": F.col("classifier.call_ok")})
    df = O.parse_classification(df, "__answer", "__called").drop("__answer", "__called")
    return df.withColumn("routing", D.route(F.col("encounter_text"), F.col("category"), F.col("confidence")))


def triage(
    encounters: DataFrame, responses: DataFrame, cases: DataFrame | None = None, clock: Column | None = None
) -> DataFrame:
    """One row per accepted encounter with routing, extraction, decision, check, flags and trail.

    ``responses`` holds every model attempt (encounter_id, node_name, attempt, content, model, tokens, cost,
    duration, call_ok); ``cases`` the retrieved protocols per encounter. No stage stops the ones after it. The
    encounters left out are the second frame of ``accept``.
    """
    clock = F.lit("1970-01-01T00:00:00+00:00") if clock is None else clock
    accepted, _ = accept(encounters)
    # answers to encounters that were refused are dropped before anything is validated
    wanted = responses.join(accepted.select("encounter_id"), "encounter_id", "left_semi")
    df = route(accepted.join(settle_responses(wanted), "encounter_id", "left"))
    if cases is not None:
        df = df.join(cases.withColumnRenamed("query_id", "encounter_id"), "encounter_id", "left")
    for n in S.NODES:
        df = df.withColumn(f"{n}_content", F.col(f"{n}.content"))
    df = O.parse_extraction(df, "extractor_content")
    df = df.withColumns({"__model": F.col("reasoner.model"), "__reason": F.col("routing.escalation_reason")})
    df = O.parse_decision(df, "reasoner_content", "__model", "__reason")
    df = O.parse_sentinel(df, "sentinel_content")
    failed = F.col("extraction_failed") | F.col("decision_failed") | F.col("check_failed")
    df = O.circuit_breaker(df, failed)
    parse_flag = F.array(F.lit("JSON_PARSE_FAILED"))
    flags = O.accumulate_flags(
        F.col("extractor.compliance_flags"), F.when(F.col("extraction_failed"), parse_flag),
        F.col("reasoner.compliance_flags"), F.when(F.col("decision_failed"), parse_flag),
        F.col("sentinel.compliance_flags"), F.when(F.col("check_failed"), parse_flag),
    )
    trail = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(n).isNotNull(),
                    F.struct(
                        F.col("encounter_id").alias("encounter_id"), F.lit(n).alias("node"), F.col(f"{n}.model").alias("model"),
                        F.col(f"{n}.tokens_in").alias("tokens_in"), F.col(f"{n}.tokens_out").alias("tokens_out"),
                        F.col(f"{n}.cost_usd").alias("cost_usd"), F.col(f"{n}.duration_ms").alias("duration_ms"),
                        F.concat(F.lit("triage_sessions/"), F.col("encounter_id"), F.lit(f"/audit/{n}")).alias("audit_ref"),
                    ),
                )
                for n in S.NODES
            ]
        )
    )
    return df.withColumns(
        {
            "compliance_flags": flags,
            "audit_trail": trail,
            "stage_breaker": F.col("extraction_failed") | F.col("decision_failed"),
            "circuit_breaker_tripped": F.col("sentinel_check.circuit_breaker_tripped"),
            "timestamp": clock,
        }
    ).drop("__model", "__reason", "classifier", *S.NODES, *[f"{n}_content" for n in S.NODES])


def triage_response(triaged: DataFrame, clock: Column) -> DataFrame:
    return R.build_triage_response(triaged, clock)
