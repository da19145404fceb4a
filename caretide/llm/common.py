"""What the operators of this subpackage share: shared scratch tables and word columns."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that are no part of a word: ASCII but for letters and digits (fixed by the result contracts).
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space (fixed by the result contracts).
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a session on a local master may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="caretide-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, and a lost executor costs a
    re-read only. Consumers prune its columns."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the files of frames that came from ``stored`` and are no longer read."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does the same, and faster, where no other character has a lower case."""
    others = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def matches(text: Column, pattern: str) -> Column:
    """All matches in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def alnum_words(text: Column) -> Column:
    return matches(ascii_lower(text), ALNUM_WORD)


def spaced_words(text: Column) -> Column:
    return matches(text, SPACED_WORD)


def at(array: str, offset: int) -> Column:
    """Element ``pos + offset`` of an array column, with ``pos`` from ``posexplode``; null past the end."""
    return F.get(F.col(array), F.col("pos") + F.lit(offset))


#: Ids up to this number (8 bytes each, so some tens of MB hashed) are broadcast by ``with_ids`` and ``without_ids``.
BROADCAST_IDS = 500_000


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def with_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (one column, stored). Few ids are broadcast, so that wide rows stay
    where they are; more are joined by shuffle."""
    return df.join(_small(ids), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is not among ``ids``; see ``with_ids``."""
    return df.join(_small(ids), key, "left_anti")


#: Name of the row key that ``unique_rows`` adds.
ROW = "__row"


def ids_are_unique(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether every row has an id of its own: no null, none twice."""
    return docs.groupBy(doc_id).count().filter(F.col(doc_id).isNull() | (F.col("count") > 1)).isEmpty()


def unique_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, stored, with a long row key in the order of ids (null ones last), then of texts.

    Rows are dealt by range and numbered within their partition, so no task sees more than its share.
    """
    order = [F.col(doc_id).asc_nulls_last(), F.substring(text, 1, 32)]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(n, *order).sortWithinPartitions(order[0], text)
    return stored(dealt.withColumn(ROW, F.monotonically_increasing_id()), "unique-rows")
