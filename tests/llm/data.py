"""Small tables with what operators have to stand: nulls, empty and long texts, copies, ties, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "re") for b in ("ten", "vor", "sil", "dam", "pur") for c in ("a", "is", "or", "e", "um")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def documents():
    base, shared = prose(1, 300), prose(2, 60)
    texts = [base, base, edited(base, 3, 6), edited(base, 4, 40), prose(5, 120) + "\n" + shared, prose(6, 120) + "\n" + shared + "\n" + prose(7, 30)]
    texts += [None, "", " \n\t ", "word", "Word", "é", "ÀÉÎ one TWO", "aaaa" * 200, "x " * 400, prose(8, 30000)]
    texts += [edited(base, 100 + i, 8) for i in range(30)] + ["under the MIT License, cc-by-nc Apache License, Version 2.0 under the mit license"] * 3
    texts += ["# * $ % & | < > " * 40, "\n".join(["same line here"] * 60), "日本語 テキスト です", "a\x00b c d"]
    rows = [(i * 3, t, ("en", "de", None)[i % 3], ("hot", "s1", None)[i % 4 % 3], len(t) if t else None) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def clashing(df, *names):
    """``df`` with further columns that are called like results or intermediate columns."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
