"""From raw documents to packed training sequences: quality rules, near duplicates, repeated passages, benchmark
contamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents. Null and empty texts fail the quality rules and so
leave at the first stage; an empty table stays empty to the end.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from caretide.llm import decontaminate, near_dedup, packing, quality_rules, suffix_index
from caretide.llm.common import ROW, ids_are_unique, stored, table, unique_rows, without_ids

#: Column of what is left of a text.
KEPT = "__kept_text"


def _by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows and the column that tells them apart: the id, or a row key where an id is null or shared."""
    return (docs, "doc_id") if ids_are_unique(docs) else (unique_rows(docs), ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Every row is judged by itself, repeated ones and those without id too; null and empty
    texts are rejected."""
    return quality_rules.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the first one by id, null ids last, then by text. Rows that share an id, repeated ones
    too, are documents of their own."""
    rows, key = _by_row(docs)
    found = near_dedup.near_duplicates(rows, key)
    dropped = stored(found.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "near-duplicates")
    return without_ids(rows, dropped, key).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus, in the order of ids (null ones last) and texts;
    n_chars follows the text. A document of which nothing is left goes. Rows that share an id are documents of their own."""
    rows, key = _by_row(docs)
    cut = suffix_index.remove_repeats(rows, key, contents=True).filter("n_removed > 0")
    cut = stored(cut.select(F.col("doc_id").alias(key), F.col("kept_text").alias(KEPT)), "cut-texts")
    whole = without_ids(rows, cut.select(key), key)
    changed = rows.drop("text", "n_chars").join(cut, key).filter(F.col(KEPT).rlike(r"[^\x20\x09-\x0D]"))
    rest = {"text": F.col(KEPT), "n_chars": F.length(KEPT).cast("long")}
    return whole.unionByName(changed.withColumns(rest).drop(KEPT)).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; every row is judged, without an id too."""
    rows, key = _by_row(docs)
    judged = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), key)
    hit = stored(judged.filter("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return without_ids(rows, hit, key).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of at most 2048 tokens; every row is packed, repeated ones too."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", decontaminated),
    ("packing", packed),
]

#: Similarity, byte matches and tokens are beyond plain SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
