"""Queue dashboard: cards, counts, feeds, session detail and reasoning report."""

from pyspark.sql import Column, DataFrame, functions as F

from caretide import settings as S
from caretide.functions import labels as L
from caretide.functions.decisions import call_cost
from caretide.operators.keyed import latest_first, top_per_group


def analytics_cards(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("circuit_breaker_tripped")).alias("breaker_tripped"),
    )


def model_distribution(sessions: DataFrame) -> DataFrame:
    """Sessions per model family; ``first_seq`` is where the family first shows up."""
    used = sessions.filter(F.coalesce(F.col("selected_model") != "", F.lit(False)))
    return used.groupBy(L.model_family(F.col("selected_model")).alias("family")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )


def top_model(sessions: DataFrame) -> DataFrame:
    ordered = model_distribution(sessions).orderBy(F.desc("n"), F.asc("first_seq"))
    return ordered.limit(1).select(F.concat("family", F.lit(" ("), F.col("n"), F.lit(")")).alias("top_model"))


def status_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("status").agg(F.count("*").alias("n"))


def latest_sessions(sessions: DataFrame, limit: int = S.SESSION_FEED_ROWS) -> DataFrame:
    return latest_first(sessions, "updated_at", "encounter_id", limit)


def sessions_by_updated(sessions: DataFrame) -> DataFrame:
    return latest_first(sessions, "updated_at", "encounter_id")


def audit_timeline(audit: DataFrame, tie: str) -> DataFrame:
    """Entries in time order within each encounter. A global range sort on the full key, so the entries of one
    busy encounter spread over several partitions."""
    return audit.orderBy("encounter_id", "ts", tie)


def pending_feed(sessions: DataFrame, limit: int = S.SESSION_FEED_ROWS) -> DataFrame:
    """Newest pending sessions of every hospital in one job."""
    waiting = sessions.filter(F.col("status") == "pending_review")
    return top_per_group(waiting, ["hospital_id"], [F.desc("created_at"), F.asc("encounter_id")], limit)


def session_detail(sessions: DataFrame, audit: DataFrame, embedded: str = "audit_trail") -> DataFrame:
    """Sessions with their audit entries; a session without stored entries shows its embedded trail.

    Written as an inner join plus the sessions it misses: both forms let the adaptive planner split a busy
    encounter on the audit side, which a left join would not.
    """
    entry = ["node", "seq", "cost_usd", "duration_ms"]
    stored = sessions.drop(embedded).join(audit.select("encounter_id", *entry), "encounter_id")
    without = sessions.join(audit.select("encounter_id").distinct(), "encounter_id", "left_anti")
    shown = without.select(*[c for c in sessions.columns if c != embedded], F.explode_outer(embedded).alias("e"))
    shown = shown.select("*", *[F.col(f"e.{c}").alias(c) for c in entry]).drop("e")
    return stored.withColumn("origin", F.lit("stored")).unionByName(shown.withColumn("origin", F.lit("embedded")))


def first_match(audit: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """First entry of each (encounter, node)."""
    return audit.groupBy("encounter_id", "node").agg(F.min_by(value, F.struct(*order)).alias("first"))


def step_pivot(audit: DataFrame, fields: list[str], order: list[str], nodes: list[str] | None = None) -> DataFrame:
    """One row per encounter with the first entry of every step side by side."""
    nodes = nodes or S.STEP_NODES
    entry, rank = F.struct(*fields), F.struct(*order)
    return audit.groupBy("encounter_id").agg(
        *[F.min_by(entry, F.when(F.col("node") == n, rank)).alias(n) for n in nodes]
    )


def reasoning_report(steps: DataFrame, node: str) -> DataFrame:
    """Label columns of one step of ``step_pivot``."""
    return steps.select(
        "encounter_id",
        L.duration_label(F.col(f"{node}.duration_ms")).alias("duration"),
        L.cost_label(F.col(f"{node}.cost_usd")).alias("cost"),
        L.model_family(F.col(f"{node}.model")).alias("model"),
    )


def reasoning_chain_text(df: DataFrame) -> DataFrame:
    """Text of the four steps from ``extraction``, ``decision`` and the parsed check columns."""
    return df.select(
        "encounter_id",
        F.col("extraction.chief_complaint").alias("chief_complaint"),
        L.symptom_list(F.col("extraction.symptoms")).alias("symptoms"),
        L.medication_list(F.col("extraction.medications")).alias("medications"),
        F.col("decision.level").alias("level"),
        L.confidence_label(F.col("decision.confidence")).alias("confidence"),
        L.joined(F.col("decision.key_findings")).alias("key_findings"),
        L.yes_no(F.col("sentinel_check.passed")).alias("passed"),
        L.confidence_label(F.col("hallucination_score")).alias("hallucination"),
        L.yes_no(F.col("vitals_ok")).alias("vitals_consistent"),
        L.yes_no(F.col("meds_ok")).alias("medication_safe"),
        L.joined(F.col("issues_found"), "; ").alias("issues"),
    )


def encounter_cost(calls: DataFrame) -> DataFrame:
    return calls.groupBy("encounter_id").agg(
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count("*").alias("n_calls"),
    )


def routing_savings(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Actual cost against sending every call to the top tier."""
    actual = call_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))
    top = call_cost(F.lit(S.TOP_TIER), F.col("tokens_in"), F.col("tokens_out"))
    sums = calls.groupBy(*(by or [])).agg(F.sum(actual).alias("actual_usd"), F.sum(top).alias("all_top_usd"))
    return sums.withColumn("saved_fraction", 1 - F.try_divide("actual_usd", "all_top_usd"))


def medication_interactions(medications: DataFrame, interactions: DataFrame) -> DataFrame:
    """Encounters that take two drugs of one ``interactions`` row (drug_a, drug_b, effect).

    The interaction table drives the search: each drug looks up its known partners, then the partner is looked
    for in the same encounter. Pairs that do not interact are never formed.
    """
    taken = medications.select("encounter_id", F.lower("drug").alias("drug")).distinct()
    candidates = taken.join(interactions, F.col("drug") == F.lower("drug_a")).select(
        "encounter_id", F.col("drug").alias("drug_a"), F.lower("drug_b").alias("drug_b"), "effect"
    )
    return candidates.join(taken.withColumnRenamed("drug", "drug_b"), ["encounter_id", "drug_b"]).select(
        "encounter_id", "drug_a", "drug_b", "effect"
    )
