"""The protocol corpus: seeding, projection, embedding and dimension changes."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caretide.functions import text as tx, vectors


def seed_protocols(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """Existing protocols plus the seeds not there yet, matched on (title, version); of seeds that share both, the
    least record (by id, where there is one)."""
    rest = sorted((c for c in seeds.columns if c not in ("title", "version")), key=lambda c: (c != "id", c))
    first = seeds.groupBy("title", "version").agg(F.min(F.struct(F.lit(0).alias("__0"), *rest)).alias("__s"))
    seeds = first.select("title", "version", "__s.*").select(*seeds.columns)
    same = existing.select(F.col("title").alias("__t"), F.col("version").alias("__v"))
    match = F.col("title").eqNullSafe(F.col("__t")) & F.col("version").eqNullSafe(F.col("__v"))
    return existing.unionByName(seeds.join(same, match, "left_anti"), allowMissingColumns=True)


def delete_seed(protocols: DataFrame, effective_date: str = "2024-01-01", version: int = 1) -> DataFrame:
    hit = (F.col("effective_date") == F.lit(effective_date).cast("date")) & (F.col("version") == version)
    return protocols.filter(~F.coalesce(hit, F.lit(False)))


def scan_protocols(protocols: DataFrame, ordered: bool = True) -> DataFrame:
    out = protocols.select("id", "title", "content")
    return out.orderBy("id") if ordered else out


def missing_embeddings(protocols: DataFrame) -> DataFrame:
    return protocols.filter(vectors.is_missing(F.col("embedding")))


def embed(
    protocols: DataFrame, provider: Callable[[list[str]], list[list[float] | None]], separator: str = ". "
) -> DataFrame:
    """(id, embedding) from a caller-supplied batch provider. A text the provider fails on is left out."""
    texts = protocols.select("id", tx.embed_text(F.col("title"), F.col("content"), separator).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame({"id": batch["id"], "embedding": provider(batch["text"].tolist())})
            yield made[made["embedding"].notna()]

    return texts.mapInPandas(run, "id string, embedding array<float>")


def write_embeddings(protocols: DataFrame, made: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Protocols with new vectors where there are some."""
    new = made.select("id", F.col("embedding").alias("__new"))
    out = protocols.join(new, "id", "left")
    changed = F.col("__new").isNotNull()
    out = out.withColumn("embedding", F.coalesce("__new", "embedding"))
    if updated_at is not None:
        out = out.withColumn("updated_at", F.when(changed, updated_at).otherwise(F.col("updated_at")))
    return out.select(*protocols.columns)


def redim_embeddings(protocols: DataFrame, dim: int) -> DataFrame:
    """Every vector brought to ``dim`` entries."""
    return protocols.withColumn("embedding", vectors.normalize_dim(F.col("embedding"), dim))


def embedding_fallback(df: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Vector of the first provider that delivered; rows with neither have no vector and retrieve nothing."""
    return df.withColumn("embedding", vectors.first_available(F.col(primary), F.col(secondary)))
