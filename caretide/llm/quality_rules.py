"""Quality rules whose cutoffs adapt to each language and source.

Counts per document are native array expressions. One KLL sketch for each measure, language and source (mergeable,
so partial sketches are combined before and after the shuffle, however large a source is) gives quartiles; a
document is rejected if it lies far outside its group's usual range. A group with few documents takes the
thresholds of its language, and one without those the thresholds of the whole table.
"""

from pyspark.sql import Column, DataFrame, functions as F

from caretide.llm.common import drop_stored, matches, spaced_words, stored

#: Fences stand this many quartile distances outside the quartiles.
FENCE = 4.0
#: Groups smaller than this take the thresholds of the next wider group.
MIN_GROUP = 50
#: Accuracy of the sketches (rank error about 1 %).
SKETCH_K = 200
#: Thresholds of at most so many groups (about 150 bytes each) are sent to every task; more are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: A measure is never held against a document within these limits, whatever its group looks like.
ALWAYS_FINE = {
    "symbol_share": (None, 0.10),
    "dup_line_share": (None, 0.15),
    "repeat_share": (None, 0.35),
    "mean_word": (2.5, 12.0),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _adjacent(run: Column, i: Column) -> Column:
    here = F.get(run, i)["h"]
    return (here == F.get(run, i - 1)["h"]) | (here == F.get(run, i + 1)["h"])


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long); null text has no words.

    Windows of three words are compared by 64-bit hash within one document. Columns of ``docs`` with the same
    names are replaced.
    """
    words = docs.withColumn("_words", spaced_words(F.col(text)))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.coalesce(F.length(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long"),
            "n_symbols": F.coalesce(F.length(text) - F.length(F.regexp_replace(F.col(text), r"[#*$%&|<>]+", "")), F.lit(0)).cast("long"),
            "_lines": lines,
            "_h": F.when(
                F.size("_words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - 3),
                    lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
                ),
            ),
        }
    )
    # most documents repeat no window: the distinct count tells so without sorting pairs
    repeated = counted.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_run": F.when(
                F.size(F.array_distinct("_h")) < F.size("_h"),
                F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    )
    starts = repeated.withColumn(
        "_starts",
        F.when(
            F.col("_run").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.size("_run") - 1), lambda i: F.coalesce(_adjacent(F.col("_run"), i), F.lit(False))),
                    lambda i: F.get("_run", i)["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("_starts") - 1),
        F.lit(3),
        lambda n, i: n + F.least(F.lit(3), F.get("_starts", i) - F.get("_starts", i - 1)),
    )
    full = starts.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_starts") > 1, covered), F.lit(0)).cast("long"))
    # the counts leave through a one-element inline: later filters on them would else be pushed to the scan, copied
    # out in full, and count everything again
    others = [c for c in docs.columns if c not in COUNTS]
    return full.select(*others, F.inline(F.array(F.struct(*COUNTS))))


def shares() -> dict[str, Column]:
    """The four shares that thresholds are set for."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
    }


def thresholds(measured: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group (none of an empty table): number of documents and the lower and upper fence of every share.

    Partial sketches are made map-side, so a source with a third of all rows sends one sketch per task.
    """
    named = shares()
    sketches = measured.groupBy(*keys).agg(
        F.count("*").alias("n_group"),
        *(F.kll_sketch_agg_double(v.cast("double"), F.lit(SKETCH_K)).alias(k) for k, v in named.items()),
    )
    sketches = sketches.filter("n_group > 0")  # an empty table has no sketch to ask
    out = [F.col(k) for k in keys] + [F.col("n_group")]
    for k in named:
        q1, q3 = (F.kll_sketch_get_quantile_double(k, F.lit(q)) for q in (0.25, 0.75))
        low, high = ALWAYS_FINE[k]
        out.append((F.least(q1 - FENCE * (q3 - q1), F.lit(low)) if low is not None else F.lit(None).cast("double")).alias(f"{k}_low"))
        out.append(F.greatest(q3 + FENCE * (q3 - q1), F.lit(high)).alias(f"{k}_high"))
    return sketches.select(*out)


def _fences() -> list[str]:
    return [f"{k}_{side}" for k in ALWAYS_FINE for side in ("low", "high")]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, all by default) with the counts, ``base_failed`` and ``kept``.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows. kept: not
    base_failed and every share within the fences of its language and source. Null text: no words, so it fails.
    Null language or source: a group of its own. Repeated rows are judged alike, each for itself. Empty table:
    no rows. Clashing column names: measured columns replace those of ``docs``.

    Thresholds come from a first pass over the texts, written as a narrow table; the second pass measures again and
    joins them, so texts are never shuffled.
    """
    own = docs.withColumns({"_lang": F.col(lang), "_source": F.col(source)})
    measured = measures(own, text)
    narrow = stored(measured.select("_lang", "_source", *COUNTS), "quality-measures")
    fences = _fences()
    whole = thresholds(narrow, []).first()
    whole = F.struct(*(F.lit(whole[k] if whole else None).cast("double").alias(k) for k in fences))
    by_lang = thresholds(narrow, ["_lang"]).select("_lang", F.when(F.col("n_group") >= MIN_GROUP, F.struct(*fences)).alias("_l"))
    by_source = thresholds(narrow, ["_lang", "_source"]).select(
        "_lang", "_source", F.when(F.col("n_group") >= MIN_GROUP, F.struct(*fences)).alias("_s")
    )
    limits = (
        by_source.alias("s")
        .join(by_lang.alias("l"), F.col("s._lang").eqNullSafe(F.col("l._lang")), "left")
        .select(F.col("s._lang").alias("_jl"), F.col("s._source").alias("_js"), F.coalesce("_s", "_l", whole).alias("_f"))
    )
    limits = stored(limits, "quality-limits")
    drop_stored(narrow)
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    columns = [c for c in keep or docs.columns if c not in (*COUNTS, "base_failed", "kept")]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for k, v in shares().items():
        inside &= (v <= F.col("_f")[f"{k}_high"]) & F.coalesce(v >= F.col("_f")[f"{k}_low"], F.lit(True))
    joined = measured.join(limits, measured["_lang"].eqNullSafe(limits["_jl"]) & measured["_source"].eqNullSafe(limits["_js"]), "left")
    return joined.select(*columns, *COUNTS, base.alias("base_failed"), (~base & F.coalesce(inside, F.lit(True))).alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    judged = judge(docs.withColumn("_row", F.struct(*docs.columns)), keep=["_row"])
    return judged.filter("kept").select("_row.*")
