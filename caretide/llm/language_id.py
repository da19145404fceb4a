"""Language identification as inference of a mixture of languages.

Each language is a multinomial over hashed character trigrams (letters only, words padded with a blank), counted over
all training texts. A document's language proportions are fitted by expectation-maximisation; the language set grows,
in the order of the proportions found with all languages, while the penalised likelihood rises. The prediction is the
language with the largest share, the score its share.

Counting is one map-side pass: a task sends at most LANGUAGES x BUCKETS counts, which are added up by Spark. The model
has the same bound (LANGUAGES x BUCKETS floats) and is the only thing broadcast.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caretide.llm.textbytes import slices

#: Hashed trigrams; with MAX_LANGUAGES this bounds the model to 64 MB.
BUCKETS = 1 << 16
MAX_LANGUAGES = 256
#: Added to every count.
SMOOTH = 0.1
#: Rounds of expectation-maximisation, at most, and the change of a share that ends them.
ROUNDS, SETTLED = 25, 1e-3
#: A further language must raise the log likelihood by this much for each distinct trigram and by PENALTY * log(trigrams).
GAIN, PENALTY = 0.02, 2.0
UNKNOWN = "und"
#: Bytes of text worked on at a time.
CHUNK = 1 << 20

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every trigram of all texts in order, the end of each text among them, and which texts have a letter."""
    lowered = [t.lower() for t in texts]
    joined = " " + "  ".join(lowered) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = np.cumsum(sizes + 2) - (sizes + 2)  # of the blank before each text
    # runs of other characters count as one blank
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[starts] = True
    value = np.where(letter, code, 32)[kept].astype(np.uint64)
    places = np.cumsum(kept)
    first = places[starts] - 1
    last = np.append(first[1:], len(value)) if len(first) else first
    h = value[:-2] * np.uint64(0x9E3779B97F4A7C15) + value[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + value[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(48)).astype(np.int64)
    owner_first, owner_last = np.minimum(first, len(bucket)), np.maximum(np.minimum(last - 2, len(bucket)), np.minimum(first, len(bucket)))
    letters = np.add.reduceat(letter, starts) > 0 if len(starts) else np.zeros(0, bool)
    return bucket, np.stack([owner_first, owner_last], axis=1), letters


def count_trigrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                bucket, spans, _ = trigram_buckets([t or "" for t in part.column("text").to_pylist()])
                labels = part.column("lang").to_pylist()
                for label in set(labels):
                    own = np.concatenate([bucket[a:b] for (a, b), x in zip(spans, labels, strict=True) if x == label])
                    totals.setdefault(label, np.zeros(BUCKETS, np.int64))
                    totals[label] += np.bincount(own, minlength=BUCKETS)
        for label, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.record_batch({"lang": pa.array([label] * len(seen)), "bucket": pa.array(seen, pa.int32()), "n": pa.array(counts[seen], pa.int64())})

    named = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    return named.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (BUCKETS x languages). At most MAX_LANGUAGES languages may occur."""
    counted = count_trigrams(docs, text, lang).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = counted.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = np.full((BUCKETS, len(found)), SMOOTH, np.float64)
    for i, row in enumerate(found):
        model[np.array(row["bucket"], np.int64), i] += np.array(row["n"], np.float64)
    return [r["lang"] for r in found], (np.log(model / model.sum(axis=0))).astype(np.float32) if found else model.astype(np.float32)


def mixture(logp: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``logp`` (rows: trigrams) by expectation-maximisation, and the log likelihood."""
    top = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - top)
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(ROUNDS):
        weight = counts / (p @ share)
        new = share * (p.T @ weight) / counts.sum()
        moved = np.abs(new - share).max()
        share = new
        if moved < SETTLED:
            break
    return share, float(counts @ (np.log(p @ share) + top[:, 0]))


def infer(logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of all languages; zero for those outside of the chosen set."""
    total, languages = counts.sum(), logp.shape[1]
    out = np.zeros(languages)
    if languages == 1:
        out[0] = 1
        return out
    alone = counts @ logp
    share, _ = mixture(logp, counts)
    order = np.argsort(-share, kind="stable")
    first = int(alone.argmax())
    chosen, fitted, best = [first], np.ones(1), float(alone[first])
    price = GAIN * total + PENALTY * np.log(total)
    for extra in order:
        if extra == first:
            continue
        trial = [*chosen, int(extra)]
        shares, likelihood = mixture(logp[:, trial], counts)
        if likelihood - best <= price:
            break
        chosen, fitted, best = trial, shares, likelihood
    out[chosen] = fitted
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred, score (its share) and languages (all with a share, as lang:share).

    Null text or text without a letter: ``und``, 0 and no languages; so is everything if nothing was learned. Ties go
    to the language that sorts first. Every row, repeated or not, has one result. Empty table: no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("languages", "string")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = sent.value
        for batch in batches:
            for part in slices(batch, "_text", CHUNK):
                bucket, spans, letters = trigram_buckets([t or "" for t in part.column("_text").to_pylist()])
                found, score, mix = [], [], []
                for (a, b), any_letter in zip(spans, letters, strict=True):
                    if not any_letter or not names or b <= a:
                        found.append(UNKNOWN), score.append(0.0), mix.append("")
                        continue
                    seen, counts = np.unique(bucket[a:b], return_counts=True)
                    share = infer(logp[seen], counts.astype(np.float64))
                    best = int(share.argmax())
                    found.append(names[best]), score.append(float(min(1.0, share[best])))
                    mix.append(",".join(f"{names[i]}:{share[i]:.2f}" for i in np.flatnonzero(share > 0)))
                own = [part.column(c) for c in keep]
                yield pa.record_batch([*own, pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], names=[*keep, "lang_pred", "score", "languages"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(predict, schema)
