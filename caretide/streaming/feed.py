"""A log of events with gapless ids, which a reader resumes behind the last event that it has seen.

Every micro-batch numbers its events on from the batch before it and writes them under ``folder``/events/batch=<id>/
first_id=<n>, a folder per range of ids, with a row per range in ``folder``/index/<id>. A batch that runs again starts
from the same predecessor and replaces its own folders, so no id is given twice. A reader looks up the index and then
reads only the folders of later ids.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from caretide import settings as S
from caretide.sources.tables import drop_folder
from caretide.streaming.ingest import start

INDEX = "first_id long, last_id long, batch long"


class ResumeError(ValueError):
    """A reader cannot go on behind this id without losing or repeating events."""


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("recursiveFileLookup", "true").parquet(f"{folder}/index")


def newest_id(spark: SparkSession, folder: str, batch_id: int) -> int:
    """The last id given before a batch; 0 before the first one. The index of a batch without events says it too."""
    if batch_id == 0:
        return 0
    return spark.read.schema(INDEX).parquet(f"{folder}/index/{batch_id - 1}").agg(F.max("last_id")).first()[0]


def append(events: DataFrame, folder: str, batch_id: int, order: list[str]) -> None:
    """Numbers the events of a batch in this order (it must be total) and adds them to the log.

    The rows are dealt by range and written once with their place within the range; the driver sees one count per range.
    """
    spark = events.sparkSession
    before, staged = newest_id(spark, folder, batch_id), f"{folder}/staged/{batch_id}"
    at = F.monotonically_increasing_id()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = dealt.withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    placed.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(placed.schema).parquet(staged)
    offsets, entries = [], []
    last = before
    for part, n in sorted(rows.groupBy("__part").count().collect()):
        offsets.append((part, last + 1))
        entries.append((last + 1, last + n, batch_id))
        last += n
    ranges = F.broadcast(spark.createDataFrame(offsets, "__part long, first_id long"))
    numbered = rows.join(ranges, "__part").withColumn("event_id", F.col("first_id") + F.col("__at")).drop("__part", "__at")
    numbered.write.mode("overwrite").partitionBy("first_id").parquet(f"{folder}/events/batch={batch_id}")
    index = spark.createDataFrame(entries or [(last + 1, last, batch_id)], INDEX)
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/{batch_id}")
    drop_folder(spark, staged)


def event_log_stream(events: DataFrame, folder: str, checkpoint: str, order: list[str], once: bool = False):
    """Every micro-batch of a stream into the log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append(batch, folder, batch_id, order)

    return start(events.writeStream.foreachBatch(write), checkpoint, once, S.FLUSH_SECONDS).start()


def resume_from(spark: SparkSession, folder: str, last_event_id: int, schema) -> DataFrame:
    """The events behind ``last_event_id``, with event_id. ``schema``: that of the events, as DDL or StructType.

    Refused are an id that was never given, one behind which events are no longer kept, and a log whose ranges overlap or
    leave ids out. The lookup reads the index alone, a row per range; the ranges before the id are pruned as partitions.
    """
    index = _index(spark, folder)
    ranges = index.filter("last_id >= first_id")
    found = index.agg(F.max("last_id"), F.min("first_id"), F.max(F.when(F.col("first_id") <= last_event_id + 1, F.col("first_id")))).first()
    newest, oldest, begin = (found[0] or 0), (found[1] or 1), found[2]
    if last_event_id > newest or last_event_id < 0:
        raise ResumeError(f"event {last_event_id} was never given, the newest is {newest}")
    if last_event_id + 1 < oldest:
        raise ResumeError(f"events {last_event_id + 1} to {oldest - 1} are no longer kept")
    covered = ranges.filter(F.col("last_id") > last_event_id)
    held = covered.agg(F.sum(F.expr("last_id - first_id + 1")), F.min("first_id")).first()
    if held[0] is not None and held[0] != newest - held[1] + 1:
        raise ResumeError(f"ids {held[1]} to {newest} are not given once each")
    kept = spark.createDataFrame([], schema).schema.add("event_id", "long").add("batch", "long").add("first_id", "long")
    if begin is None or last_event_id == newest:
        return spark.createDataFrame([], kept).drop("batch", "first_id")
    events = spark.read.schema(kept).option("basePath", f"{folder}/events").parquet(f"{folder}/events")
    return events.filter((F.col("first_id") >= begin) & (F.col("event_id") > last_event_id)).drop("batch", "first_id")


def drop_before(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Drops the batches before one. Their ids are not given again; a reader that needs them is refused."""
    for (old,) in _index(spark, folder).filter(F.col("batch") < batch_id).select("batch").distinct().collect():
        drop_folder(spark, f"{folder}/events/batch={old}")
        drop_folder(spark, f"{folder}/index/{old}")
