import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caretide.llm import components, near_dedup, suffix_index
from caretide.llm.common import stored
from tests.llm import brute, data

CLASH = ("a", "r", "start", "count", "kind", "n", "f1", "bands", "rep", "u", "v", "component_id", "kept_text", "key")


@pytest.fixture(scope="module")
def docs(spark):
    return data.clashing(data.frame(spark), *CLASH).cache()


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def check_repeats(df, want, n):
    rows = df.collect()
    assert len(rows) == n
    for r in rows:
        size, removed, spans, left = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, removed, spans, hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_repeats_with_any_number_of_batches(spark, docs, batches):
    rows = data.documents()
    check_repeats(suffix_index.remove_repeats(docs, batches=batches), brute.repeats(pairs(rows)), len(rows))


def test_repeats_of_the_sample(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_repeats(suffix_index.remove_repeats(frame), brute.repeats(rows), len(rows))


def test_repeats_at_the_limit_of_length(spark):
    line = "".join(chr(97 + i * i % 26) for i in range(100))
    rows = [(1, "1" + line + "2"), (2, "3" + line + "4"), (3, "5" + line[:99] + "6"), (4, "7" + line[1:] + "8" + line), (5, line + line)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check_repeats(suffix_index.remove_repeats(frame, batches=3), brute.repeats(rows), 5)


def test_repeats_of_odd_rows(spark, docs):
    once, twice = suffix_index.remove_repeats(docs), suffix_index.remove_repeats(docs.union(docs))
    assert twice.count() == 2 * once.count() and once.exceptAll(twice).isEmpty()  # first copies are judged as before
    passage = data.prose(31, 60)
    shared = spark.createDataFrame([("a", "one " + passage), ("b", "two"), ("b", passage + " three"), (None, passage)], "doc_id string, text string")
    got = sorted((str(r["doc_id"]), r["kept_text"]) for r in suffix_index.remove_repeats(shared, contents=True).collect())
    assert got == [("None", passage), ("a", "one " + passage), ("b", " three"), ("b", "two")]
    assert suffix_index.remove_repeats(docs.limit(0)).collect() == []
    long = "z" * 150
    rows = spark.createDataFrame([(None, long), (None, long), (7, long), (8, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_index.remove_repeats(rows).collect())
    # in one run of the same letter only the first hundred bytes have not started earlier
    assert got == [(0, 0), (0, 0), (7, 149), (8, 0)]
    kept = {r["doc_id"]: r["kept_text"] for r in suffix_index.remove_repeats(docs, contents=True).collect()}
    want = brute.repeats(pairs(data.documents()))
    assert kept == {i: left.decode("utf-8", "ignore") for i, (_, _, _, left) in want.items()}


def test_levels_merge_geometrically(spark):
    index = suffix_index.SuffixIndex()
    for i in range(6):
        frame = spark.createDataFrame([(10 * i + k, data.prose(50 * i + k, 60)) for k in range(4)], "doc_id long, text string")
        index.add(stored(frame, "batch"))
        assert len(index.levels) == bin(i + 1).count("1")
        assert sum(n for n, _ in index.levels) == i + 1


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    want = brute.near_groups(pairs(data.documents()))
    assert got == want and len({c for _, c in want.values()}) < len(want) - 20


def test_near_duplicates_of_the_sample(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    out = near_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == brute.near_groups(rows)
    assert out.filter("kept != (doc_id = component_id)").isEmpty()


def test_chains_of_near_copies_are_one_group(spark):
    words = data.prose(9, 200).split()
    rows = []
    for i in range(40):  # each differs a little from the one before, the ends of the chain share nothing
        words[5 * i : 5 * i + 5] = [f"n{i}x{k}" for k in range(5)]
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame).collect()}
    assert got == brute.near_groups(rows) and {c for _, c in got.values()} == {0}


def test_near_duplicates_of_odd_rows(spark, docs):
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []
    assert near_dedup.near_duplicates(docs.union(docs)).exceptAll(near_dedup.near_duplicates(docs)).isEmpty()
    rows = [(None, "a b c"), (5, "a b c"), (6, "A B C"), (7, "x y z"), (7, "a b c"), (8, "x y z"), (9, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got.collect()) == [
        (0, 0, True), (5, 5, True), (6, 5, False), (7, 5, False), (7, 5, False), (8, 5, False), (9, 9, True),
    ]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for n, shared in ((1000, 900), (60, 50), (5, 4), (1, 1)):
        errors = []
        for _ in range(40):
            values = rng.integers(1, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = near_dedup.super_minhash([values[:n], values[n - shared :]])
            errors.append((a == b).mean() - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05
    assert len(set((near_dedup.super_minhash([values]) >> np.uint64(32)).ravel().tolist())) >= 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (101, 100), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(1, 31)} | {101: 100} | {i: 200 for i in range(201, 260)}
    assert {r["node"]: r["component"] for r in got} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).filter(F.col("node") > 0).collect() == []


@pytest.mark.parametrize("cross", [False, True])
def test_blocks_connect_what_pairs_connect(cross, monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 60)
    sets = []
    for _ in range(80):
        own = base.copy()
        n = rng.integers(0, 12)
        own[rng.choice(60, n, replace=False)] = rng.integers(1, 1 << 62, n)
        sets.append(np.unique(own))
    component, side = rng.integers(0, 40, 80), rng.integers(0, 2, 80)
    root = [component.tolist().index(c) for c in component]  # what is one component already is connected

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(80):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if component[i] != component[j] and (not cross or side[i] != side[j]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = [find(i) for i in range(80)]
    got = near_dedup.block_links(sets, component, side, cross, 80)
    root = [component.tolist().index(c) for c in component]
    for u, v in got:
        x, y = find(u), find(v)
        assert x != y
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(80)] == want and got


@pytest.mark.parametrize("rounds,block", [(0, 1 << 18), (0, 500), (3, 500)])
def test_many_near_copies_in_any_rounds_and_blocks(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    base = data.prose(21, 120)
    rows = [(i, data.edited(base, 500 + i, 4 + i % 9)) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame).collect()}
    assert got == brute.near_groups(rows)


def test_shared_shingles_are_counted_exactly():
    both = np.arange(700_001)
    assert near_dedup.tile_shared([both, both[1:]])[0, 1] == 700_000
