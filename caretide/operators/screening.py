"""Row filters and quarantine: accepted rows on one side, rejects with a rule name on the other."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caretide import settings as S
from caretide.functions import decisions, text as tx


def _passes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def judge(df: DataFrame, condition: Column, reason: str) -> DataFrame:
    """Adds ``reject_reason``: null for rows that satisfy ``condition``, else ``reason``; null counts as failing. One
    pass over the input, where the pair from ``split`` costs one for each side that is used."""
    return df.withColumn("reject_reason", F.when(~_passes(condition), F.lit(reason)))


def split(df: DataFrame, condition: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects) of ``judge``."""
    judged = judge(df, condition, reason)
    return judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"), judged.filter(F.col("reject_reason").isNotNull())


def filter_length(df: DataFrame, text: str) -> DataFrame:
    return df.filter(tx.length_ok(F.col(text)))


def judge_injection(df: DataFrame, text: str) -> DataFrame:
    return judge(df, ~tx.has_injection(F.col(text)), "prompt_injection")


def filter_prompt_injection(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    return split(df, ~tx.has_injection(F.col(text)), "prompt_injection")


def filter_not_expired(df: DataFrame, as_of: Column, expiry: str = "expiry_date") -> DataFrame:
    """A protocol expires at midnight of its expiry date, so a later date than that of ``as_of`` is live; the
    comparison of dates reaches the scan."""
    return df.filter(F.col(expiry).isNull() | (F.col(expiry) > F.to_date(as_of)))


def mark_enums(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Adds ``enum_violations``: the listed columns that hold no allowed value."""
    broken = [F.when(~_passes(F.col(c).isin(values)), F.lit(c)) for c, values in allowed.items()]
    return df.withColumn("enum_violations", F.array_compact(F.array(*broken)))


def check_enums(df: DataFrame, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows whose listed columns hold allowed values, and the violations with the offending columns."""
    marked = mark_enums(df, allowed)
    return (
        marked.filter(F.size("enum_violations") == 0).drop("enum_violations"),
        marked.filter(F.size("enum_violations") > 0),
    )


def filter_status(df: DataFrame, status: str) -> DataFrame:
    return df if status == "all" else df.filter(F.col("status") == status)


def filter_recent(df: DataFrame, as_of: Column, hours: int = 48, ts: str = "created_at") -> DataFrame:
    return df.filter(F.col(ts) > as_of - F.make_interval(hours=F.lit(hours)))


def filter_recent_days(df: DataFrame, as_of: Column, hours: int = 48, ts: str = "created_at") -> DataFrame:
    """As ``filter_recent`` on a day-partitioned table: the extra predicate prunes partitions."""
    start = as_of - F.make_interval(hours=F.lit(hours))
    return df.filter((F.col("day") >= F.to_date(start)) & (F.col(ts) > start))


def verify_replayed(audit: DataFrame, ids: DataFrame) -> DataFrame:
    found = audit.join(ids.select("encounter_id").distinct(), "encounter_id", "left_semi")
    return found.select("encounter_id", "node_name", "created_at").orderBy("created_at", "encounter_id", "node_name")


def protocol_scope(df: DataFrame, hospital_id: Column, specialty: Column | None = None) -> DataFrame:
    scoped = df.filter(F.col("hospital_id") == hospital_id)
    return scoped if specialty is None else scoped.filter(specialty.isNull() | (F.col("specialty") == specialty))


def malicious_agents(logs: DataFrame, user_agent: str = "user_agent") -> DataFrame:
    return logs.filter(tx.is_scanner_agent(F.col(user_agent)))


def is_2xx(response_class: Column) -> Column:
    return response_class.eqNullSafe("2xx")


def non_2xx(logs: DataFrame) -> DataFrame:
    return logs.filter(~is_2xx(F.col("response_class")))


def consumer_errors(logs: DataFrame, service: str, limit: int = 20) -> DataFrame:
    """Newest ``limit`` bad-request or error lines of one service."""
    serious = decisions.severity_rank(F.col("severity")) >= S.LOG_SEVERITIES.index("ERROR")
    hits = logs.filter((F.col("service") == service) & ((F.col("status") == 400) | serious))
    return hits.orderBy(F.desc("ts"), F.desc("log_id")).limit(limit)


def null_violations(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per broken NOT NULL rule: ``rule``, ``n_rows``. One scan for all rules."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = F.explode(F.array(*[F.struct(F.lit(f"not_null:{c}").alias("rule"), F.col(c).alias("n_rows")) for c in required]))
    return counts.select(pairs.alias("r")).select("r.rule", "r.n_rows").filter("n_rows > 0")


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return df.filter(present).groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def apply_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()})
