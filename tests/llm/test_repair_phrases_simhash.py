import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caretide.llm import collocations, conversation_repair, queries, repair_grammar, simhash
from tests.llm import brute, data

SF = "/root/testdata/sf0.001"
REPAIRED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def turns_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, TURNS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def check_repaired(spark, folder, rows):
    got = queries.op11_conversation_repair(spark, folder).collect()
    want = {c: brute.repaired(v) for c, v in brute.damaged(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in REPAIRED) == want[r["conv_id"]], r["conv_id"]


def test_repair_of_the_sample(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    check_repaired(spark, SF, rows)


@pytest.mark.parametrize("rows_a_segment", [4096, 3])
def test_repair_of_odd_conversations(spark, tmp_path, monkeypatch, rows_a_segment):
    monkeypatch.setattr(conversation_repair, "ROWS", rows_a_segment)
    rng, rows = random.Random(1), []
    for conv in range(120):
        for i in range(rng.choice([1, 2, 5, 8, 13, 40]) if conv else 1500):
            turn = rng.choice([None, i, i, i, i + 1, i * 2])
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "unknown", "", None])
            text = rng.choice(["a.", "b", "c!", "  ", "", "é?", None, f"{i}.", f"{i}. \n", f"x{i}", "z" * 500 + "."])
            rows.append((conv if conv % 40 else None, turn, role, text))
    check_repaired(spark, turns_table(spark, tmp_path, rows), rows)


def test_repair_of_a_conversation_in_many_tasks(spark, tmp_path):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(8, 0, "user", "x." * (2 << 20)), (8, 1, "assistant", "y.")]
    check_repaired(spark, turns_table(spark, tmp_path, rows), rows)


def test_repair_without_rows(spark, tmp_path):
    # the only turn of these conversations is dropped
    gone = [c for c in range(200) if brute.damaged([(c, 0, "user", "x.")])[c] == []]
    rows = [(c, 0, "user", "x.") for c in gone]
    check_repaired(spark, turns_table(spark, tmp_path / "a", rows), rows)
    empty = turns_table(spark, tmp_path / "b", [])
    assert queries.op11_conversation_repair(spark, empty).collect() == []


def test_repair_reads_clashing_columns_of_any_id(spark):
    rows = [("a", 1, "user", "x."), ("a", 2, "assistant", "y."), ("b", 1, "assistant", "z.")]
    frame = data.clashing(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), "fault", "h1", "t1", "least", "copies", "gone", "c", "n")
    got = {r["conv_id"]: r["audit"] for r in conversation_repair.repair(frame).collect()}
    assert got == {"a": "KK", "b": "D"}


def test_cells_do_not_depend_on_the_cuts():
    rng = random.Random(3)
    for _ in range(60):
        turns = "".join(rng.choice("sSuUaA-_x") for _ in range(rng.randrange(1, 30)))
        chart = repair_grammar.Chart()
        for c in turns:
            chart.add(repair_grammar.parsed(c))
        whole = repair_grammar.Chart()
        whole.add_turns(turns)
        assert chart.cells() == whole.cells()
        if len(turns) < 12:
            assert repair_grammar.parsed(turns) == whole.cells()


def phrase_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("sample,absorbed", [(1, 100), (8, 100), (10**9, 100), (4, 60)])
def test_phrases_whatever_the_sample_finds(spark, sample, absorbed):
    rows = data.documents()
    frame = data.clashing(data.frame(spark), "k", "f", "n", "phrase", "salt", "words", "cut")
    got = collocations.collocations(frame, frequent=3, reported=300, sample=sample, absorbed=absorbed)
    assert phrase_rows(got) == sorted(brute.phrases_of([(r[2], r[1]) for r in rows], 3, reported=300, absorbed=absorbed))


def test_phrases_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 64)
    texts = ["A b\tc. a  b c", "a b c a b c a b c", None, "", " . ,\n\x0b", "\u00a0 \u00a0 é ü é ü", "x" * 300 + " y " * 200, "a b c;" * 50, "one"]
    rows = [(lang, t) for lang in ("en", None, "und", "zz") for t in texts] * 2
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert phrase_rows(collocations.collocations(frame, frequent=2)) == sorted(brute.phrases_of(rows, 2))
    assert collocations.collocations(frame.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    counts = [("en", 0, "", 4 * 10**15), ("en", 1, "a", 10**13), ("en", 1, "b", 10**14 + 3), ("en", 2, "a b", 10**13 - 7)]
    monkeypatch.setattr(collocations, "frequencies", lambda *_: spark.createDataFrame(counts, "lang string, k int, phrase string, f long"))
    (row,) = collocations.collocations(spark.range(1)).collect()
    assert row["score"] == 1000 * (10**13 - 7) * 4 * 10**15 // (10**13 * (10**14 + 3))


def fingerprint_rows(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def expected_fingerprints(rows):
    prints = [(d, brute.simhash(t)) for d, t in rows]
    groups = brute.close_groups(prints)
    return sorted(((d, f"{p:016x}", groups[d]) for d, p in prints), key=str)


def test_simhash_of_odd_and_sample_documents(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in data.documents()]
    frame = data.clashing(data.frame(spark), "fp", "least", "c", "u", "component_id", "table", "key")
    want = expected_fingerprints(rows)
    assert fingerprint_rows(simhash.near_duplicates(frame)) == want
    monkeypatch.setattr(simhash, "CHUNK", 40)
    assert fingerprint_rows(simhash.near_duplicates(frame)) == want
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert fingerprint_rows(simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))) == expected_fingerprints(rows)


def test_simhash_of_null_repeated_and_no_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, None), (6, "  "), (None, "p q r s t"), (7, "one two")]
    got = fingerprint_rows(simhash.near_duplicates(spark.createDataFrame(rows, schema)))
    component = {None: {4, None}, 4: {4}, 5: {5}, 6: {5}, 7: {7}}
    assert len(got) == 7 and all(c in component[d] for d, _, c in got)
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("block,pieces", [(64, 5), (2048, 6), (128, 8)])
def test_links_of_a_dense_group_in_any_blocks(spark, monkeypatch, block, pieces):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "pieces_for", lambda *_: pieces)
    rng = np.random.default_rng(pieces)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (700, 5)).astype(np.uint64), axis=1)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64), np.uint64(12345) ^ flips]))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = simhash.close_links(frame).collect()
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    u, v = (np.array([at[r[k]] for r in links], int) for k in (0, 1))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4

    def groups(a, b):
        root = np.arange(len(prints))
        linked, to = simhash.forest(len(prints), a, b)
        root[linked] = to
        return root.tolist()

    assert groups(u, v) == groups(*np.nonzero(near))


def test_bit_sliced_distances_at_every_radius():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (50, 130))
    b[:40] = a[:40] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
    for radius in (0, 1, 3, 4, 30):
        query, word, lanes = simhash.close(a, simhash.bit_planes(b), radius)
        found = {(q, 64 * w + j) for q, w, x in zip(query.tolist(), word.tolist(), lanes.tolist(), strict=True) for j in range(64) if x >> j & 1}
        want = {(i, j) for i, j in itertools.product(range(50), range(130)) if (int(a[i]) ^ int(b[j])).bit_count() <= radius}
        assert {(i, j) for i, j in found if j < 130} == want
