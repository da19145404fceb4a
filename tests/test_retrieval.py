import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caretide.operators import metric_index as M, retrieval as R
from caretide.sources import protocols as P
from caretide.functions import vectors as X

PROTOCOLS = "id string, title string, content string, source_type string, specialty string, expiry_date date, embedding array<float>"


def brute_force(queries, protocols, k):
    """(layer, kind, distance, id) order over all pairs."""
    out = {}
    for qid, q in queries:
        ranked = []
        for pid, layer, p in protocols:
            if q is None or p is None:
                ranked.append((layer, 2, 0.0, pid))
                continue
            a, b = np.array(q, np.float32).astype(float), np.array(p, np.float32).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            ranked.append((layer, 1, 0.0, pid) if n == 0 else (layer, 0, round(1 - a @ b / n, 9), pid))
        out[qid] = [(r[3], r[0], r[1]) for r in sorted(ranked)[:k]]
    return out


@pytest.mark.parametrize("blocks,chunks", [(1, 1), (7, 5), (1, None)])
def test_nearest_equals_brute_force(spark, blocks, chunks):
    rng = np.random.default_rng(5)
    base = [rng.normal(size=8).round(2).tolist() for _ in range(12)]
    protocols = [(f"p{i:02d}", i % 3 // 2, base[i % 12]) for i in range(30)]  # every vector two or three times
    protocols += [("zero", 0, [0.0] * 8), ("none", 0, None), ("azero", 1, [0.0] * 8)]
    queries = [(f"q{i}", rng.normal(size=8).round(2).tolist()) for i in range(15)] + [("qz", [0.0] * 8), ("qn", None)]
    q = spark.createDataFrame(queries, "query_id string, embedding array<float>")
    p = spark.createDataFrame(protocols, "id string, layer int, embedding array<float>")
    for k in (1, 4, 25, 50):
        got = {}
        for r in R.nearest(q, p, k, blocks, chunks).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["layer"], r["kind"]))
        assert got == brute_force(queries, protocols, k)


@pytest.mark.parametrize("pivots,block", [(1, 100), (6, 3), (64, 2)])
def test_pruned_search_equals_brute_force(spark, pivots, block):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(5, 8))
    near = lambda i: (centers[i % 5] + rng.normal(size=8) * 0.05).round(2).tolist()
    protocols = [(f"p{i:02d}", i % 3 // 2, near(i)) for i in range(40)] + [(f"r{i:02d}", 0, near(i)) for i in range(5)]
    protocols += [("copy1", 1, protocols[0][2]), ("copy2", 0, protocols[0][2]), ("zero", 0, [0.0] * 8), ("none", 0, None), ("azero", 1, [0.0] * 8)]
    queries = [(f"q{i}", near(i)) for i in range(15)] + [("qz", [0.0] * 8), ("qn", None)]
    q = spark.createDataFrame(queries, "query_id string, embedding array<float>")
    p = spark.createDataFrame(protocols, "id string, layer int, embedding array<float>")
    index = M.build(p, pivots, block)
    for k in (1, 4, 25, 60):
        top, pairs = M.search(q, index, k)
        got = {}
        for r in top.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["layer"], r["kind"]))
        assert got == brute_force(queries, protocols, k)
        compared = {r["query_id"]: r["s"] for r in pairs.groupBy("query_id").agg(F.sum("pairs").alias("s")).collect()}
        assert max(compared.values()) <= len(protocols)
        if pivots == 64 and k <= 4:  # what the bounds leave out
            assert sum(compared[f"q{i}"] for i in range(15)) < 0.5 * 15 * len(protocols)
    index[0].unpersist()


def test_pruned_search_without_vectors(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), (None, None)], "query_id string, embedding array<float>")
    p = spark.createDataFrame([("a", 0, None), ("b", 1, None), ("c", 0, None)], "id string, layer int, embedding array<float>")
    got = M.search(q, M.build(p), 2)[0].orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["kind"]) for r in got] == [(None, "a", 2), (None, "c", 2), ("q", "a", 2), ("q", "c", 2)]
    assert M.search(q, M.build(p.limit(0)), 2)[0].count() == 0
    assert M.search(q.limit(0), M.build(p), 2)[0].count() == 0


def test_retrieve_layers_expiry_and_order(spark):
    rows = [
        ("a", "t", "c", "fhir_public", "s", None, [1.0, 0.0]),
        ("b", "t", "c", "hospital_curated", "s", None, [0.0, 1.0]),
        ("c", "t", "c", "hospital_curated", "s", None, None),
        ("d", "t", "c", "hospital_curated", "s", None, [0.0, 0.0]),
        ("e", "t", "c", "hospital_curated", "s", None, [0.6, 0.8]),
    ]
    df = spark.createDataFrame(rows, PROTOCOLS)
    old = spark.sql("select 'x' id, 't' title, 'c' content, 'hospital_curated' source_type, 's' specialty, date'2020-01-01' expiry_date, array(1f, 0f) embedding")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = R.retrieve(q, df.unionByName(old), F.lit("2024-01-01").cast("timestamp"), 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["e", "b", "d", "c", "a"]
    assert got[0]["similarity"] == pytest.approx(0.6, abs=1e-6) and got[3]["similarity"] is None and got[4]["similarity"] == 1.0
    assert np.isnan(got[2]["similarity"])


def test_expand_layered_fills_up(spark):
    curated = spark.createDataFrame([("q", "c1", 0.1)], "query_id string, id string, similarity double")
    public = spark.createDataFrame([("q", "p1", 0.9), ("q", "p2", 0.8), ("r", "p1", 0.5)], "query_id string, id string, similarity double")
    got = [(r["query_id"], r["id"]) for r in R.expand_layered(curated, public, 2).orderBy("query_id", "rank").collect()]
    assert got == [("q", "c1"), ("q", "p1"), ("r", "p1")]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0] * 768,), ([1.0] * 1536,), ([1.0] * 1024,), (None,)], "v array<float>")
    got = [r[0] for r in df.select(X.normalize_dim(F.col("v"), 1024)).collect()]
    assert [len(v) if v else None for v in got] == [1024, 1024, 1024, None]
    assert got[0][767:769] == [1.0, 0.0] and sum(got[0]) == 768
    d = spark.sql("select array(1f, 0f) a, array(0f, 0f) z, cast(null as array<float>) n")
    row = d.select(X.cosine_similarity(F.col("a"), F.col("a")), X.cosine_similarity(F.col("a"), F.col("z")), X.cosine_similarity(F.col("a"), F.col("n"))).first()
    assert row[0] == 1.0 and np.isnan(row[1]) and row[2] is None


def test_embedding_jobs(spark):
    rows = [("1", "t1", "c1", None), ("2", "t2", "c2", [0.0, 0.0]), ("3", "t3", "c3", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, title string, content string, embedding array<float>")
    todo = P.missing_embeddings(df)

    def provider(texts):
        return [None if t.startswith("t2") else [float(len(t)), 1.0] for t in texts]

    made = P.embed(todo, provider)
    out = {r["id"]: r["embedding"] for r in P.write_embeddings(df, made).collect()}
    assert out == {"1": [6.0, 1.0], "2": [0.0, 0.0], "3": [1.0, 2.0]}


def test_seeding_twice_changes_nothing(spark):
    seeds = spark.createDataFrame([("a", 1), ("b", 1)], "title string, version int")
    once = P.seed_protocols(seeds.limit(0), seeds)
    assert P.seed_protocols(once, seeds).count() == 2


def test_memory_of_a_block_does_not_follow_the_pairs():
    rng = np.random.default_rng(0)
    n = 60_000
    block = R.Block(pd.DataFrame({"layer": 0, "id": [f"p{i:06d}" for i in range(n)], "embedding": list(rng.normal(size=(n, 4)))}))
    queries = pd.DataFrame({"query_id": [f"q{i}" for i in range(300)], "embedding": list(rng.normal(size=(300, 4)))})
    block.top(queries.head(1), 5)  # the units of the block
    tracemalloc.start()
    found = block.top(queries, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1500 and peak < 400e6  # 256 queries at a time took 492 MB


def test_blocks_follow_the_number_of_protocols(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", i % 2, rng.normal(size=3).tolist()) for i in range(40)]
    p = spark.createDataFrame(rows, "id string, layer int, embedding array<double>")
    q = p.select(F.col("id").alias("query_id"), "embedding")
    want = {tuple(r) for r in R.nearest(q, p, 3, blocks=1).select("query_id", "id", "rank").collect()}
    monkeypatch.setattr(R, "BLOCK", 7)
    visited = []
    monkeypatch.setattr(R, "visit", lambda routed, *rest, visit=R.visit: visited.append(routed.select("block").distinct().count()) or visit(routed, *rest))
    assert {tuple(r) for r in R.nearest(q, p, 3).select("query_id", "id", "rank").collect()} == want and visited == [6]


def test_routed_queries_are_given_out_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    cells = M.Cells(np.eye(3), np.zeros(3, int), np.zeros(3, int), np.arange(3), np.full(3, 0.5), np.full(3, 4), np.array([0, 20, 40]), np.full(3, 20))
    frame = pd.DataFrame({"query_id": [str(i) for i in range(50)], "embedding": list(rng.normal(size=(50, 3))), "kth": None})
    whole = pd.concat([*M._routes(frame, cells, 4, True)])
    monkeypatch.setattr(M, "ROUTED", 100)
    pieces = [*M._routes(frame, cells, 4, True)]
    assert max(map(len, pieces)) <= 100 and pd.concat(pieces)[["query_id", "block"]].values.tolist() == whole[["query_id", "block"]].values.tolist()


def found(top):
    return sorted(str((r["query_id"], r["rank"], r["id"], r["layer"], r["kind"], round(r["distance"], 11) + 0.0)) for r in top.collect())


def test_pruned_search_shuffles_queries_once_and_equals_nearest(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=6).round(1).tolist() for _ in range(9)]
    protocols = [(None if i % 10 == 9 else f"p{i % 37:02d}", i % 2, base[i % 9]) for i in range(60)]  # copies, ids that repeat, ids that are missing
    protocols += [("zero", 0, [0.0] * 6), ("none", 0, None), ("none", 1, None)]
    queries = [(f"q{i % 12}", rng.normal(size=6).tolist()) for i in range(16)] + [("q0", base[0]), ("q0", base[0]), (None, base[1]), (None, base[2]), ("z", [0.0] * 6), ("n", None)]
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    p = spark.createDataFrame(protocols, "id string, layer int, embedding array<double>")
    for k in (1, 5, 40, 200):
        want = found(R.nearest(q, p, k, 2, 2))
        for pivots, block, visits in ((1, 1_000, 4_000_000), (5, 4, 20)):
            monkeypatch.setattr(M, "VISITS", visits)
            index = M.build(p, pivots, block)
            top, _ = M.search(q, index, k, 3)
            assert found(top) == want
            plan = top._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert "explode" not in plan and plan.count("Exchange ") == 2  # copies of the protocols, and of the queries for every block, were shuffled
            index[0].unpersist()


@pytest.mark.parametrize("k", [1, 5, 700])
def test_closer_protocols_are_those_of_top(monkeypatch, k):
    rng = np.random.default_rng(4)
    for size, odd in ((500, False), (500, True), (3, False)):
        vectors = list(rng.normal(size=(size, 16)).astype(np.float32))
        vectors[1::7] = [vectors[0]] * len(vectors[1::7])  # copies
        if odd:
            vectors[5], vectors[8] = None, np.zeros(16, np.float32)
        block = R.Block(pd.DataFrame({"layer": 1, "id": [f"p{i:03d}" for i in range(size)], "embedding": vectors}))
        asked = [*rng.normal(size=(30, 16)), vectors[0], np.zeros(16), None]
        queries = pd.DataFrame({"query_id": [f"q{i}" for i in range(33)], "embedding": asked})
        want = block.top(queries, k).assign(query_id=lambda t: t["query_id"].str[1:].astype(int))
        order = lambda t: t.sort_values(["query_id"], kind="stable").round({"distance": 11}).reset_index(drop=True)
        for pairs in (10, 65_536):
            monkeypatch.setattr(R, "PAIRS", pairs)
            pd.testing.assert_frame_equal(order(block.closer(queries, np.full(33, np.inf), k)), order(want), check_dtype=False)
        kth = np.full(33, 100.7)
        got = {*block.closer(queries, kth, k)[["query_id", "id"]].itertuples(index=False, name=None)}
        must = want[want["layer"] * 100 + want["kind"] * 10 + want["distance"] <= 100.7]
        assert {*must[["query_id", "id"]].itertuples(index=False, name=None)} <= got <= {*want[["query_id", "id"]].itertuples(index=False, name=None)}
