"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ten consecutive words (a shorter item is one window), a window into shingles of up to
five words. Exact containment needs every shingle of a window, so one of them is enough as its prefix: the rarest,
by its count over all documents. Documents' rolling shingles are joined with these prefixes alone; a hit proposes one
start, which must leave room for the window (length and position bounds) and is confirmed word by word.

Two passes over the texts (shingle counts, then candidates); only hits and one row per document are shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

from caretide.llm.common import alnum_words, at, stored

WINDOW = 10
SHINGLE = 5
#: Up to so many windows (some 500 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 100_000


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, window (its words): all runs of ten words; the whole item if shorter; none without words."""
    words = items.select(F.col(item_id).alias("item_id"), alnum_words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    starts = words.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))).alias("s"))
    return starts.select("item_id", F.slice("words", F.col("s") + 1, F.lit(WINDOW)).alias("window")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """One row per distinct window and shingle: window, offset of the shingle, its length k and hash."""
    k = F.least(F.size("window"), F.lit(SHINGLE))
    each = windows.select("window").distinct().withColumn("k", k)
    each = each.select("window", "k", F.explode(F.sequence(F.lit(0), F.size("window") - F.col("k"))).alias("offset"))
    return each.withColumn("hash", _by_length(lambda n: F.xxhash64(*(F.get("window", F.col("offset") + i) for i in range(n)))))


def _by_length(hashed) -> Column:
    """``hashed(n)`` for the n that column k holds."""
    out = F.lit(None).cast("long")
    for n in range(1, SHINGLE + 1):
        out = F.when(F.col("k") == n, hashed(n)).otherwise(out)
    return out


def rolling_shingles(docs: DataFrame, lengths: list[int], doc_id: str, text: str, prefixes: bool) -> DataFrame:
    """One row per document, word and shingle length: doc_id, text_hash, n_words, words, pos, k, hash."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), alnum_words(F.col(text)).alias("words"))
    own = ["doc_id", "text_hash", F.size("words").alias("n_words"), "words"]
    each = words.select(*own, (F.posexplode_outer if prefixes else F.posexplode)("words").alias("pos", "word"))
    if lengths != [SHINGLE]:
        each = each.withColumn("k", F.explode(F.array(*map(F.lit, lengths))))
    else:
        each = each.withColumn("k", F.lit(SHINGLE))
    some = [n for n in range(1, SHINGLE + 1) if n in lengths]
    hashed = F.lit(None).cast("long")
    for n in some:
        full = F.xxhash64("word", *(at("words", i) for i in range(1, n)))
        hashed = F.when((F.col("k") == n) & (F.col("pos") + n <= F.col("n_words")), full).otherwise(hashed)
    return each.withColumn("hash", hashed)


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: n_words, n_hit (words inside any occurrence of an item window), n_items, items_sha256 (of the
    sorted item ids, comma-joined) and contaminated.

    Null or empty text: no words, no hit. Items without words match nothing. Rows repeated with id and text count as
    one document; rows that share an id but not the text stay apart; repeated item ids count once. Empty tables: no
    rows, or no hits. Other columns are not read.
    """
    windows = stored(item_windows(items, item_id, item_text), "item-windows")
    shingles = stored(window_shingles(windows), "item-shingles")
    lengths = sorted(r["k"] for r in shingles.select("k").distinct().collect()) or [SHINGLE]  # five at most
    small = windows.count() <= BROADCAST_WINDOWS
    sent = F.broadcast if small else lambda df: df

    known = sent(shingles.select(F.col("hash").alias("known"), F.col("k").alias("known_k")).distinct())
    seen = rolling_shingles(docs, lengths, doc_id, text, prefixes=False)
    counts = (
        seen.join(known, (seen["hash"] == known["known"]) & (seen["k"] == known["known_k"]))
        .groupBy("hash", "k")
        .agg(F.count("*").alias("n"))
    )
    counted = shingles.join(counts, ["hash", "k"])  # a window with a shingle that no document has occurs nowhere
    per_window = counted.groupBy("window").agg(
        F.count("*").alias("n_known"), F.min_by(F.struct("hash", "k", "offset"), F.struct("n", "offset")).alias("prefix")
    )
    whole = per_window.filter(F.col("n_known") == F.size("window") - F.col("prefix.k") + 1)
    prefixes = stored(whole.select("window", "prefix.*"), "window-prefixes")

    each = rolling_shingles(docs, lengths, doc_id, text, prefixes=True)
    p = sent(prefixes.select("window", F.col("hash").alias("p_hash"), F.col("k").alias("p_k"), "offset"))
    start = F.col("pos") - F.col("offset")
    bounds = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
    found = each.join(p, (each["hash"] == p["p_hash"]) & (each["k"] == p["p_k"]) & bounds & same, "left")
    first = F.col("pos").isNull() | ((F.col("pos") == 0) & (F.col("k") == lengths[0]))
    found = found.filter(F.col("window").isNotNull() | first).select(
        "doc_id", "text_hash", "n_words", "window", F.when(F.col("window").isNotNull(), start).alias("start"), F.size("window").alias("length")
    )
    found = stored(found, "window-hits")

    key = ["doc_id", "text_hash", "n_words"]
    runs = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end")))))
    spans = found.groupBy(*key).agg(runs.alias("runs"))
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["to"]))).alias("n"), F.greatest(a["to"], r["end"]).alias("to")
        ),
        lambda a: a["n"],
    )
    spans = spans.select(*key, covered.cast("long").alias("n_hit"))
    hit_windows = found.filter(F.col("window").isNotNull()).select(*key, "window").distinct()
    per_doc = (
        hit_windows.join(windows, "window")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        .select(F.struct(*key).alias("own"), F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("list"))
    )
    joined = spans.join(per_doc, F.struct(*key) == F.col("own"), "left")
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
