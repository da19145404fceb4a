"""Audit topic to partitioned tables, dead letters, dedup and change feed as streams."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from caretide import settings as S
from caretide.functions import variants as V
from caretide.operators import keyed, records
from caretide.sources import messages
from caretide.sources.tables import AUDIT_CLUSTER, FEEDBACK_CLUSTER, drop_folder, write_partitioned

#: A message is redelivered or first delivered late for as long as it is retained; nothing younger is dropped.
WATERMARK = f"{S.MESSAGE_RETENTION_SECONDS} seconds"
#: Messages of a batch that one task decodes, and that one task writes.
TASK_ROWS = 250_000


def read_topic(spark: SparkSession, fmt: str, options: dict[str, str], schema=None) -> DataFrame:
    """Messages from a topic or a folder; the connector is just its format and options."""
    reader = spark.readStream.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def dedup_stream(stream: DataFrame, ts: str = "publish_time", delay: str = WATERMARK) -> DataFrame:
    """Each message id once; ids are remembered for ``delay`` of event time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["message_id"])


def start(writer: DataStreamWriter, checkpoint: str, once: bool, seconds: int) -> DataStreamWriter:
    """A writer that takes what is there and ends, or looks again every so many seconds."""
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")


def sink_batched(stream: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = S.FLUSH_SECONDS):
    """Micro-batched append with exactly-once files."""
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    return start(writer, checkpoint, once, seconds).start()


def judge_messages(batch: DataFrame) -> DataFrame:
    """Decoded messages with their ``target`` table; ``rejects`` carry a reason. Both tables require a time, and
    feedback its three categories and reviewer."""
    decoded = messages.decode_message(batch)
    doc, feedback = F.col("doc"), messages.is_feedback(F.col("doc"))
    complete = reduce(lambda a, b: a & b, [V.present(doc, k) for k in records.FEEDBACK_KEYS])
    reason = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(feedback & ~complete, "missing_feedback_field")
        .when(records.parse_time(V.get(doc, "timestamp", "string")).isNull(), "missing_timestamp")
    )
    judged = decoded.withColumn("reject_reason", reason)
    target = F.when(F.col("reject_reason").isNotNull(), "rejects").when(feedback, "classifier_feedback")
    return judged.withColumn("target", target.otherwise("audit_trail"))


def split_audit_batch(judged: DataFrame) -> dict[str, DataFrame]:
    """One judged batch to its three outputs."""
    to = {t: judged.filter(F.col("target") == t) for t in ("audit_trail", "classifier_feedback", "rejects")}
    return {
        "audit_trail": records.flatten_audit(to["audit_trail"]),
        "classifier_feedback": records.flatten_feedback(to["classifier_feedback"])[0],
        "rejects": to["rejects"].select("message_id", "data", "reject_reason"),
    }


def audit_stream(stream: DataFrame, out: str, checkpoint: str, once: bool = False, seconds: int = S.FLUSH_SECONDS):
    """Decode, split, flatten and append each micro-batch to ``out``/{audit_trail,classifier_feedback,rejects}.

    With a ``publish_time``, a message id that came before within the retention is dropped first. Files go under
    ``day=…/batch=<id>``, and a batch overwrites its own folders only, so one replayed after a lost driver replaces
    its files instead of doubling them, and a day is read without listing all batches. ``compact`` merges the small
    files of days that are over.
    """

    known = "publish_time" in stream.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        # few large splits would be few large tasks; those of dedup are dealt out already, and not to be run twice
        splits = 1 if known else -(-batch.count() // TASK_ROWS)
        judged = judge_messages(batch.repartition(splits) if splits > 1 else batch).persist()
        try:
            tasks = -(-judged.count() // TASK_ROWS)
            parts = split_audit_batch(judged)
            write_partitioned(parts["audit_trail"], f"{out}/audit_trail", AUDIT_CLUSTER, mode="overwrite", batch=batch_id, tasks=tasks)
            write_partitioned(parts["classifier_feedback"], f"{out}/classifier_feedback", FEEDBACK_CLUSTER, mode="overwrite", batch=batch_id, tasks=tasks)
            parts["rejects"].write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        finally:
            judged.unpersist()

    unique = dedup_stream(stream) if known else stream
    return start(unique.writeStream.foreachBatch(write), checkpoint, once, seconds).start()


def compact(spark: SparkSession, path: str, out: str, before: str, keys: list[str]) -> None:
    """Days of a table before ``before`` (a date) rewritten to ``out`` with files near the advisory size. A day that is
    there already is replaced, so the job can be repeated; the source is left for the caller to drop."""
    closed = spark.read.parquet(path).filter(F.col("day") < F.lit(before).cast("date")).drop("batch")
    laid_out = closed.hint("rebalance", "day").sortWithinPartitions("day", *keys, "created_at")
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)


def dead_letter_stream(deliveries: DataFrame, max_attempts: int = S.MAX_DELIVERY_ATTEMPTS) -> DataFrame:
    """Failure count per message so far; ``dead`` turns true at the limit, and false again if the message is delivered
    after all, as in the batch form. Run in update mode.

    Windows of twice the retention, one starting every retention, hold all deliveries of a message in one of them, and
    their state is dropped when they have passed. A message may so have two rows; ``latest_dead`` joins them.
    """
    failed, retained = ~F.col("ok"), f"{S.MESSAGE_RETENTION_SECONDS} seconds"
    windows = F.window("delivered_at", f"{2 * S.MESSAGE_RETENTION_SECONDS} seconds", retained)
    counted = deliveries.withWatermark("delivered_at", retained).groupBy("message_id", windows).agg(
        F.count_if(failed).alias("failures"),
        F.max("ok").alias("delivered"),
        F.coalesce(F.max(F.col("permanent") & failed), F.lit(False)).alias("permanent"),
    )
    dead = ~F.col("delivered") & ((F.col("failures") >= max_attempts) | F.col("permanent"))
    return counted.select("message_id", F.col("window.start").alias("window_start"), "failures", "delivered", dead.alias("dead"))


def latest_dead(counted: DataFrame) -> DataFrame:
    """One row per undelivered message from the newest state of its windows: failures and ``dead``."""
    joined = counted.groupBy("message_id").agg(F.max("failures").alias("failures"), F.max("delivered").alias("delivered"), F.max("dead").alias("dead"))
    return joined.filter(~F.col("delivered")).drop("delivered")


def change_feed_stream(stream: DataFrame, state: str, out: str, checkpoint: str, once: bool = False, limit: int = S.SESSION_FEED_ROWS):
    """Session changes: each micro-batch is merged into the newest ``limit`` sessions kept under ``state`` and the
    difference to the previous snapshot is appended to ``out``. Snapshots are written per batch id, so a
    replayed batch starts from the same predecessor; older ones are dropped. With a full snapshot, only rows at least as new
    as its last session are shuffled: no other can enter it, and a session's own rows only get newer."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        previous, rows = spark.createDataFrame([], batch.schema), batch
        if batch_id > 0:
            previous = spark.read.schema(batch.schema).parquet(f"{state}/{batch_id - 1}")
            n, floor = previous.agg(F.count("*"), F.min("updated_at")).first()
            if n == limit:
                rows = batch.filter(F.col("updated_at") >= F.lit(floor).cast(batch.schema["updated_at"].dataType))
        merged = keyed.upsert_replace(previous.unionByName(rows), ["encounter_id"], ["updated_at"])
        keyed.latest_first(merged, "updated_at", "encounter_id", limit).write.mode("overwrite").parquet(f"{state}/{batch_id}")
        current = spark.read.schema(batch.schema).parquet(f"{state}/{batch_id}")
        changes = keyed.change_feed(previous, current, "encounter_id")
        changes.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id > 1:
            drop_folder(spark, f"{state}/{batch_id - 2}")

    return start(stream.writeStream.foreachBatch(write), checkpoint, once, S.FLUSH_SECONDS).start()


def usage_stream(points: DataFrame, metric: str, by: list[str], window: str, delay: str = WATERMARK) -> DataFrame:
    """Windowed sums of one usage metric."""
    return (
        points.filter(F.col("metric") == metric)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window), *by)
        .agg(F.sum("value").alias("value"))
    )


def rate_limit_stream(logs: DataFrame, limit: int, window: str = "1 minute", delay: str = WATERMARK) -> DataFrame:
    counts = logs.withWatermark("ts", delay).groupBy(F.window("ts", window), "client").agg(F.count("*").alias("requests"))
    return counts.filter(F.col("requests") > limit)
