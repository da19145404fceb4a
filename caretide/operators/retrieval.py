"""Exact layered top-k protocol retrieval by cosine distance."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caretide import settings as S
from caretide.operators.keyed import top_per_group
from caretide.operators.screening import filter_not_expired

DISTANCE_DIGITS = 12
#: Protocols of a block, which one task holds, and cells of a matrix of distances that it works on at a time.
BLOCK, CELLS = 50_000, 4_000_000
#: Pairs whose exact distances are computed at a time.
PAIRS = 65_536
_NUMBER, _NAN, _NULL = 0, 1, 2
_FOUND = "query_id string, layer int, id string, kind int, distance double"


def _dim(*sides: pd.Series) -> int:
    return max((len(v) for side in sides for v in side if v is not None), default=1)


def _unit(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, row is all zeros); a missing vector becomes zeros."""
    m = np.stack([np.asarray(v, dtype=np.float64) if v is not None else np.zeros(dim) for v in vectors])
    norms = np.sqrt((m * m).sum(axis=1))
    zero = norms == 0
    return m / np.where(zero, 1.0, norms)[:, None], zero


def _first(keys: np.ndarray, k: int) -> np.ndarray:
    """Column positions of the ``k`` smallest keys of each row, equal keys in column order."""
    if k == keys.shape[1]:
        return np.argsort(keys, axis=1, kind="stable")
    part = np.sort(np.argpartition(keys, k - 1, axis=1)[:, :k], axis=1)
    values = np.take_along_axis(keys, part, axis=1)
    best = np.take_along_axis(part, np.argsort(values, axis=1, kind="stable"), axis=1)
    tied = (keys <= values.max(axis=1)[:, None]).sum(axis=1) > k
    best[tied] = np.argsort(keys[tied], axis=1, kind="stable")[:, :k]
    return best


class Block:
    """Protocols of one block in the order of ids, and the top ``k`` of them for batches of queries."""

    def __init__(self, protocols: pd.DataFrame):
        self.layer, self.ids = protocols["layer"].to_numpy(dtype=np.int64), protocols["id"].to_numpy()
        self.embedding, self.missing = protocols["embedding"], protocols["embedding"].isna().to_numpy()
        self.dim = 0

    def top(self, queries: pd.DataFrame, k: int, step: int = 256) -> pd.DataFrame:
        """By layer, kind, distance, id; up to ``step`` queries at a time, fewer in a large block."""
        step = max(1, min(step, CELLS // max(len(self.ids), 1)))
        dim = _dim(self.embedding, queries["embedding"])
        if dim != self.dim:
            self.dim, (self.unit, self.zero) = dim, _unit(self.embedding, dim)
        q, q_zero = _unit(queries["embedding"], dim)
        q_missing = queries["embedding"].isna().to_numpy()
        out = []
        for at in range(0, len(q), step):
            rows = slice(at, at + step)
            distance = np.round(1.0 - q[rows] @ self.unit.T, DISTANCE_DIGITS)
            kind = np.where(q_zero[rows, None] | self.zero, _NAN, _NUMBER)
            kind = np.where(q_missing[rows, None] | self.missing, _NULL, kind)
            distance = np.where(kind == _NUMBER, distance, 0.0)
            best = _first(self.layer * 100.0 + kind * 10.0 + distance, min(k, len(self.ids)))
            out.append(
                pd.DataFrame(
                    {
                        "query_id": np.repeat(queries["query_id"].to_numpy()[rows], best.shape[1]),
                        "layer": self.layer[best].ravel(),
                        "id": self.ids[best].ravel(),
                        "kind": np.take_along_axis(kind, best, axis=1).ravel(),
                        "distance": np.take_along_axis(distance, best, axis=1).ravel(),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    def closer(self, queries: pd.DataFrame, kth: np.ndarray, k: int, step: int = 256) -> pd.DataFrame:
        """As ``top``, with the place of a query instead of its id and without what comes after the key ``kth`` that a
        query has for its last place already.

        Where all have numbers in one layer, products of single precision leave out what cannot be among the first, and
        the distances of what remains are exact.
        """
        at = pd.Series(np.arange(len(queries)), dtype=np.int64)
        own = queries.assign(query_id=at.to_numpy())
        dim = _dim(self.embedding, queries["embedding"])
        if dim != self.dim:
            self.dim, (self.unit, self.zero) = dim, _unit(self.embedding, dim)
        q, q_zero = _unit(queries["embedding"], dim)
        plain = ~(queries["embedding"].isna().to_numpy() | q_zero) & np.isfinite(q).all(axis=1)
        if self.missing.any() or self.zero.any() or (self.layer != self.layer[0]).any() or not np.isfinite(self.unit).all():
            plain[:] = False
        out = [self.top(own[~plain], k)] if not plain.all() else []
        places, q = np.flatnonzero(plain), q[plain]
        margin = (dim + 8) * 6e-8 + 1e-9  # of a product of unit vectors in single precision
        least = (1 - (kth[plain] - self.layer[0] * 100.0) - margin).astype(np.float32)
        short, units, n = q.astype(np.float32), self.unit.astype(np.float32), len(self.ids)
        step = max(1, min(step, CELLS // n))
        for start in range(0, len(q), step):
            cos = short[start : start + step] @ units.T
            near = cos >= least[start : start + step, None]
            many = np.count_nonzero(near, axis=1) > 4 * k + 16 if n > k else np.zeros(len(cos), bool)
            if many.any():
                some = cos[many]
                near[many] &= some >= (np.partition(some, n - k, axis=1)[:, n - k] - 2 * margin).astype(np.float32)[:, None]
            row, column = np.nonzero(near)
            exact = [np.einsum("ij,ij->i", q[start + row[i : i + PAIRS]], self.unit[column[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]
            distance = np.round(1.0 - np.concatenate(exact), DISTANCE_DIGITS) if exact else np.zeros(0)
            order = np.lexsort((distance, row))  # of equal ones by column, that is by id
            row, column, distance = row[order], column[order], distance[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column, distance = row[first], column[first], distance[first]
            out.append(pd.DataFrame({"query_id": places[start + row], "layer": self.layer[column], "id": self.ids[column], "kind": np.int64(_NUMBER), "distance": distance}))
        return pd.concat([o for o in out if len(o)] or out, ignore_index=True)


def visit(routed: DataFrame, protocols: DataFrame, k: int, chunks: int | None = None) -> DataFrame:
    """Top ``k`` of each block for the queries routed to it (query_id, embedding, block); protocols have id, layer,
    embedding, block.

    Both sides meet in one sorted stream, the protocols of a block first: a task holds one block and an Arrow batch of
    queries, however many queries there are. ``chunks`` spreads the queries of a block over tasks, each with a copy of
    the block; it defaults to the number of shuffle partitions.
    """
    tasks = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = chunks or tasks
    q = routed.select("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("chunk"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.lit(0).alias("layer"), "embedding")
    p = protocols.select("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"), F.lit(0).alias("side"), "id", F.col("layer").cast("int").alias("layer"), "embedding")
    task = F.pmod(F.col("block").cast("long") * n + F.col("chunk"), F.lit(tasks)).cast("int")
    met = p.unionByName(q).repartitionById(tasks, task).sortWithinPartitions("block", "chunk", "side", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, parts, block = None, [], None
        for frame in frames:
            for (at, chunk, side), rows in frame.groupby(["block", "chunk", "side"], sort=True):
                if (at, chunk) != place:
                    place, parts, block = (at, chunk), [], None
                if side == 0:
                    parts.append(rows)
                elif parts or block is not None:
                    if block is None:
                        block, parts = Block(pd.concat(parts, ignore_index=True)), []
                    yield block.top(rows.rename(columns={"id": "query_id"}), k)

    return met.mapInPandas(run, _FOUND)


def rank_found(found: DataFrame, k: int) -> DataFrame:
    order = [F.asc("layer"), F.asc("kind"), F.asc("distance"), F.asc("id")]
    return top_per_group(found, ["query_id"], order, k)


def layer_of(source_type: Column) -> Column:
    return F.when(source_type == "hospital_curated", 0).otherwise(1)


def nearest(
    queries: DataFrame, protocols: DataFrame, k: int, blocks: int | None = None, chunks: int | None = None
) -> DataFrame:
    """Top ``k`` of ``protocols`` (id, layer, embedding) for every row of ``queries`` (query_id, embedding).

    Queries are hashed into ``chunks`` and protocols into ``blocks``; every (chunk, block) multiplies matrices in one task
    and keeps ``k`` candidates per query. Top-k merges, so the last step only ranks ``k`` rows per query and block.
    A task holds one block. Unless ``blocks`` is given, one job counts the protocols, so that a block has about BLOCK of
    them however many there are; otherwise nothing runs before the caller's action. See ``metric_index.search`` for a way
    that skips blocks.
    """
    blocks = blocks or max(1, -(-protocols.count() // BLOCK))
    q = queries.select("query_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    p = protocols.select("id", "layer", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return rank_found(visit(q, p, k, chunks), k)


def retrieve(
    queries: DataFrame, protocols: DataFrame, as_of: Column, k: int = S.TOP_K, **sizes: int
) -> DataFrame:
    """Curated protocols first, then public ones, nearest first: title, content, source_type, specialty,
    similarity. A missing vector ranks after every number and after zero vectors; ties go by id."""
    live = filter_not_expired(protocols, as_of).withColumn("layer", layer_of(F.col("source_type")))
    return with_details(nearest(queries, live.select("id", "layer", "embedding"), k, **sizes), live)


def with_details(top: DataFrame, live: DataFrame) -> DataFrame:
    similarity = (
        F.when(F.col("kind") == _NUMBER, 1 - F.col("distance")).when(F.col("kind") == _NAN, F.lit(float("nan")))
    )
    details = live.select("id", "title", "content", "source_type", "specialty")
    return top.join(details, "id").select(
        "query_id", "rank", "id", "title", "content", "source_type", "specialty", similarity.alias("similarity")
    )


def expand_layered(curated: DataFrame, public: DataFrame, k: int = S.TOP_K) -> DataFrame:
    """Ranked curated hits (query_id, id, similarity) back-filled with public hits up to ``k`` per query."""
    both = layered_union(curated, public)
    order = [F.asc("layer"), F.desc_nulls_last("similarity"), F.asc("id")]
    return top_per_group(both, ["query_id"], order, k)


def layered_union(curated: DataFrame, public: DataFrame) -> DataFrame:
    return curated.withColumn("layer", F.lit(0)).unionByName(public.withColumn("layer", F.lit(1)))


def retrieval_context(top: DataFrame) -> DataFrame:
    """Retrieved cases of each query as one ordered array of at most k entries."""
    case = F.struct("rank", "title", "content", "source_type", "specialty", "similarity")
    return top.groupBy("query_id").agg(F.sort_array(F.collect_list(case)).alias("cases"))
