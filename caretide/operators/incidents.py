"""Dead letters: delivery accounting, diagnosis, replay and incident reports."""

from pyspark.sql import Column, DataFrame, functions as F

from caretide import settings as S
from caretide.functions import decisions as D


def dead_letter(deliveries: DataFrame, max_attempts: int = S.MAX_DELIVERY_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(dead, retrying) messages from a delivery log of message_id, ok, permanent, delivered_at.

    A message dies after ``max_attempts`` failures, or at its first failure when that can never succeed.
    """
    per = deliveries.groupBy("message_id").agg(
        F.count_if(~F.col("ok")).alias("failures"),
        F.max("ok").alias("delivered"),
        F.max(F.col("permanent") & ~F.col("ok")).alias("permanent"),
        F.max("delivered_at").alias("last_attempt_at"),
    )
    pending = per.filter(~F.col("delivered"))
    dead = F.col("permanent") | (F.col("failures") >= max_attempts)
    return pending.filter(dead), pending.filter(~dead)


def dedup_messages(messages: DataFrame, order: list[str]) -> DataFrame:
    """First arrival of every message id (batch form)."""
    rest = [c for c in messages.columns if c != "message_id"]
    first = messages.groupBy("message_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("m"))
    return first.select("message_id", "m.*").select(*messages.columns)


def retention(messages: DataFrame, as_of: Column, seconds: int = S.MESSAGE_RETENTION_SECONDS) -> DataFrame:
    return messages.filter(F.col("publish_time") > as_of - F.make_interval(secs=F.lit(seconds)))


def diagnose(dead: DataFrame) -> DataFrame:
    """Adds ``severity``, ``root_cause``, ``replayable``."""
    out = dead.withColumns(
        {
            "severity": D.dlq_severity(F.col("topic")),
            "root_cause": D.dlq_root_cause(F.col("status"), F.col("error_message")),
        }
    )
    return out.withColumn("replayable", D.is_replayable(F.col("root_cause")))


def replay_dlq(source: DataFrame, dead: DataFrame, order: list[str]) -> DataFrame:
    """Source topic with the replayable dead letters merged back, each message once."""
    back = dead.filter("replayable").select(*source.columns)
    return dedup_messages(source.unionByName(back), order)


def incident_report(dead: DataFrame) -> DataFrame:
    """Per topic: volume, affected encounters, detection and resolution, and whether 24 h were kept."""
    return (
        dead.groupBy("topic")
        .agg(
            F.count("*").alias("message_count"),
            F.count_distinct("encounter_id").alias("affected_encounters"),
            F.min("detected_at").alias("detected_at"),
            F.max("resolved_at").alias("resolved_at"),
            F.count_if(F.col("replayable")).alias("replayable"),
            F.count_if(F.col("resolved_at").isNull()).alias("open"),
        )
        .withColumn("severity", D.dlq_severity(F.col("topic")))
        .withColumn(
            "sla_met",
            (F.col("open") == 0)
            & (F.unix_timestamp("resolved_at") - F.unix_timestamp("detected_at") <= 24 * 3600),
        )
    )


def incident_encounters(dead: DataFrame) -> DataFrame:
    """Affected encounters as rows, so that a report of any size stays distributed."""
    return dead.groupBy("topic", "encounter_id").agg(F.count("*").alias("n_messages"))


def daily_events(audit: DataFrame, ts: str = "created_at") -> DataFrame:
    return audit.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("events")).orderBy("day")
