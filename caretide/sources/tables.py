"""Table sources and sinks."""

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caretide import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_encounters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(encounters of a JSON array, records that do not fit the schema, as text)."""
    schema = schemas.ENCOUNTERS_JSON + ", _corrupt_record STRING"
    read = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").cache()
    broken = F.col("_corrupt_record").isNotNull()
    return read.filter(~broken).drop("_corrupt_record"), read.filter(broken).select(F.col("_corrupt_record").alias("record"))


def write_partitioned(
    df: DataFrame, path: str, keys: list[str], ts: str = "created_at", mode: str = "append", batch: int | None = None, tasks: int = 1
) -> None:
    """Day partitions, clustered by ``keys`` inside. With ``batch``, a folder per batch within each day; ``overwrite``
    then replaces that batch's folders alone.

    The rebalance hint shuffles by day and lets the adaptive planner split a busy day into several tasks and
    merge quiet ones, so files come out near the advisory size; sorting keeps narrow key ranges per row group. Where that
    planner is off, as in a stream, a task would get whole days: with ``tasks``, so many take ranges of days, keys and times
    that are about as long.
    """
    dated = df.withColumn("day", F.to_date(ts))
    spread = dated.repartitionByRange(tasks, "day", *keys, ts) if tasks > 1 else dated.hint("rebalance", "day")
    laid_out = spread.sortWithinPartitions("day", *keys, ts)
    if batch is None:
        laid_out.write.mode(mode).partitionBy("day").parquet(path)
    else:
        writer = laid_out.withColumn("batch", F.lit(batch)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(path)


AUDIT_CLUSTER = ["encounter_id", "node_name"]
FEEDBACK_CLUSTER = ["original_category", "corrected_category"]


def drop_expired_days(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Day partitions still inside the retention window (a partition filter, no scan of the rest)."""
    return df.filter(F.col("day") >= F.date_sub(F.to_date(as_of), days))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``. Only a local session may go
    without that setting; it then gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="caretide-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a table, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Deletes the shuffle files of queries that are over. Spark does so when the driver has collected the garbage that
    still names them, which a driver with memory to spare puts off while the disks fill up."""
    gc.collect()
    spark._jvm.System.gc()
