"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, of order 5: an n-gram is exactly a 40-bit number, every language and script is covered, and no
word is unknown. Counts come from one map-side pass over all trusted texts (each task sends its distinct n-grams);
continuation counts, discounts, contexts and interpolated probabilities are joins and groupings of the count tables,
sharded by n-gram. For scoring, the tables are cut into shards of bounded size by the two bytes before the scored one,
which every n-gram of order 3 to 5 and its context share; each shard is broadcast and scored in a pass of its own, and
the partial sums are added per document. One shard holds SHARD_ENTRIES entries, more than text of a few languages needs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caretide.llm.common import drop_stored, stored, with_ids
from caretide.llm.textbytes import flat, slices

ORDER = 5
#: Entries (16 bytes each) of one broadcast shard.
SHARD_ENTRIES = 4_000_000
#: A document passes up to this quantile of its language's trusted perplexities, with this much allowance.
QUANTILE, ALLOWANCE = 0.99, 1.25
#: And this much more surprise in all (in nats), which only matters for a text of a few words.
SLACK = 8.0
#: Languages with fewer trusted documents take the threshold of all.
MIN_TRUSTED = 50
#: Bytes of text worked on at a time.
CHUNK = 1 << 20
SKETCH_K = 400


def mask(n: int) -> int:
    return (1 << 8 * n) - 1


def ngram_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends in each byte of all texts (a text starts after ORDER - 1 zero bytes), and their offsets."""
    data, offsets = flat(texts)
    lengths = np.diff(offsets)
    padded = np.zeros(len(data) + (ORDER - 1) * len(lengths), np.uint8)
    place = np.arange(len(data)) + (np.repeat(np.arange(len(lengths)), lengths) + 1) * (ORDER - 1)
    padded[place] = data
    key = np.zeros(len(data), np.int64)
    for back in range(ORDER - 1, -1, -1):
        key = (key << 8) | padded[place - back]
    return key, offsets


def count_ngrams(texts: DataFrame, text: str) -> DataFrame:
    """key, n of order ORDER over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def fold() -> None:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)
            keys[:], counts[:] = [k], [n]

        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                k, n = np.unique(ngram_keys(part.column("text"))[0], return_counts=True)
                keys.append(k), counts.append(n)
                if len(keys) > 16:
                    fold()
        fold()
        yield pa.record_batch([pa.array(keys[0]), pa.array(counts[0])], names=["key", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen one to four times."""
    row = counts.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    n = [max(row[f"n{k}"], 0.5) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 1 - 0.05) for k in range(3)]


def train(texts: DataFrame, text: str = "text") -> DataFrame:
    """order, context (whether the entry is a back-off weight), key, value (log): the whole model as one stored table."""
    counts = {ORDER: stored(count_ngrams(texts, text), "counts")}
    for m in range(ORDER - 1, 0, -1):
        # how many different bytes come before
        suffix = counts[m + 1].select(F.col("key").bitwiseAND(F.lit(mask(m))).alias("key"))
        counts[m] = stored(suffix.groupBy("key").agg(F.count("*").alias("n")), "counts")
    lower, model = None, None
    for m in range(1, ORDER + 1):
        d = discounts(counts[m])
        taken = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        each = counts[m].withColumns({"context": F.shiftright("key", 8), "taken": taken})
        contexts = each.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("free"))
        contexts = stored(contexts.select("context", "total", (F.col("free") / F.col("total")).alias("weight")), "contexts")
        own = each.join(contexts, "context").select("key", ((F.col("n") - F.col("taken")) / F.col("total")).alias("own"), "weight")
        if lower is None:
            p = own.select("key", (F.col("own") + F.col("weight") / 256).alias("p"))
        else:
            below = lower.select(F.col("key").alias("below"), F.col("p").alias("q"))
            p = own.join(below, F.col("key").bitwiseAND(F.lit(mask(m - 1))) == F.col("below")).select("key", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        lower = stored(p, "probabilities")
        part = lower.select(F.lit(m).alias("order"), F.lit(False).alias("context"), "key", F.log("p").cast("float").alias("value"))
        bow = contexts.select(F.lit(m).alias("order"), F.lit(True).alias("context"), F.col("context").alias("key"), F.log("weight").cast("float").alias("value"))
        model = part.unionByName(bow) if model is None else model.unionByName(part).unionByName(bow)
    model = stored(model, "model")
    drop_stored(*counts.values())
    return model


def _shard(order: Column, context: Column, key: Column, shards: int) -> Column:
    """Shard of an entry by the two bytes before the scored one; -1: orders 1 and 2, which go to every shard."""
    before = F.when(context, key).otherwise(F.shiftright(key, 8)).bitwiseAND(F.lit(mask(2)))
    return F.when(order < 3, F.lit(-1)).otherwise(F.pmod(F.xxhash64(before), F.lit(shards)))


def shard_tables(model: DataFrame, shard: int, shards: int) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values of one shard by order and kind."""
    own = _shard(F.col("order"), F.col("context"), F.col("key"), shards)
    rows = model.filter(own.isin(-1, shard)).toArrow()
    order, context = rows.column("order").to_numpy(), rows.column("context").to_numpy()
    key, value = rows.column("key").to_numpy(), rows.column("value").to_numpy()
    tables = {}
    for m in range(1, ORDER + 1):
        for kind in (False, True):
            at = np.flatnonzero((order == m) & (context == kind))
            at = at[np.argsort(key[at])]
            tables[m, kind] = key[at], value[at]
    return tables


def log_probability(keys: np.ndarray, tables: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log probability of the last byte of each n-gram given the others."""
    out, todo = np.zeros(len(keys)), np.arange(len(keys))

    def find(m: int, kind: bool, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, value = tables[m, kind]
        if not len(known):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return known[at] == wanted, value[at]

    for m in range(ORDER, 0, -1):
        own = keys[todo] & mask(m)
        hit, value = find(m, False, own)
        out[todo[hit]] += value[hit]
        todo = todo[~hit]
        seen, weight = find(m, True, own[~hit] >> 8)
        out[todo] += np.where(seen, weight, 0.0)
    out[todo] -= np.log(256)
    return out


def score(docs: DataFrame, model: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with n_bytes and log_p (sum over all bytes of the text)."""
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // SHARD_ENTRIES))
    # with several shards a row is told from others by its text as well
    hashed = [F.sha2(text, 256).alias("_hash")] if shards > 1 else []
    key = [*keep, *["_hash"] * len(hashed)]
    schema = docs.select(*keep, *hashed).schema.add("n_bytes", "long").add("log_p", "double")
    out = None
    for shard in range(shards):
        sent = spark.sparkContext.broadcast(shard_tables(model, shard, shards))
        pairs = np.arange(1 << 16)
        if shards > 1:  # the same hash as the tables were cut by
            places = spark.range(1 << 16).select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s")).toArrow()
            pairs = places.column("s").to_numpy()

        def add_up(batches: Iterator[pa.RecordBatch], sent=sent, pairs=pairs, shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "_text", CHUNK):
                    keys, offsets = ngram_keys(part.column("_text"))
                    logs = np.zeros(len(keys))
                    mine = np.flatnonzero(pairs[(keys >> 8) & mask(2)] == shard) if shards > 1 else np.arange(len(keys))
                    logs[mine] = log_probability(keys[mine], sent.value)
                    sums = np.append(0.0, np.cumsum(logs))
                    own = [part.column(c) for c in key]
                    yield pa.record_batch([*own, pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], names=[*key, "n_bytes", "log_p"])

        passed = docs.select(*keep, *hashed, F.col(text).alias("_text")).mapInArrow(add_up, schema)
        out = passed if out is None else out.unionByName(passed)
    if shards > 1:
        # equal rows are one group, which becomes as many rows again; each of them came once from every shard
        alike = out.groupBy(*key, "n_bytes").agg(F.sum("log_p").alias("_sum"), (F.count("*") / shards).cast("int").alias("_copies"))
        each = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        out = each.select(*keep, "n_bytes", (F.col("_sum") / F.col("_copies")).alias("log_p"))
    return out


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity (per byte), threshold (of its language) and kept.

    Trusted are documents whose labels all have quality 1. Null or empty text: no perplexity, not kept. Null language: a
    language of its own. Without trusted text nothing is known and every document with text is kept (threshold null).
    Repeated rows are scored each; rows of several labels are one label. Empty table: no rows. Other columns are not
    read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    trusted = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    trusted = stored(trusted, "trusted")
    model = train(with_ids(own, trusted))
    scored = stored(score(own, model, "text", ["doc_id", "lang"]), "scored")
    scored = scored.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))))

    good = with_ids(scored, trusted).filter("perplexity is not null")
    sketched = [F.count("*").alias("n"), F.kll_sketch_agg_double("perplexity", F.lit(SKETCH_K)).alias("sketch")]
    limit = (ALLOWANCE * F.kll_sketch_get_quantile_double("sketch", F.lit(QUANTILE))).alias("limit")
    whole = good.agg(*sketched).filter("n > 0").select(limit).first()
    by_lang = good.groupBy("lang").agg(*sketched).filter(F.col("n") >= MIN_TRUSTED).select(F.col("lang").alias("_lang"), limit)
    by_lang = stored(by_lang, "limits")
    joined = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["_lang"]), "left")
    threshold = F.coalesce("limit", F.lit(whole["limit"] if whole else None).cast("double"))
    within = -F.col("log_p") <= F.col("n_bytes") * F.log(threshold) + SLACK
    kept = F.col("perplexity").isNotNull() & F.coalesce(within, F.lit(True))
    return joined.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
