import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretide.operators import intervals as N, service_levels as L
from caretide.plans.stream_queries import rocksdb, run_to_table
from caretide.streaming import alerts as AL


def plain_bans(times, limit, interval, ban):
    opened, count, until, out = None, 0, None, []
    for t in times:
        if until is not None and t < until:
            out.append(until)
            continue
        if until is not None or opened is None or t >= opened + interval:
            opened, count, until = t, 0, None
        count += 1
        if count > limit:
            until = t + ban
            out.append(until)
        else:
            out.append(N.NEVER)
    return out


@pytest.mark.parametrize("limit,interval,ban", [(3, 10, 7), (1, 5, 20), (5, 30, 3), (2, 1, 1)])
def test_bans_in_chunks_of_any_size(limit, interval, ban):
    rng = np.random.default_rng(limit)
    for _ in range(60):
        times = np.sort(rng.integers(0, rng.integers(5, 300), rng.integers(1, 120)))
        want = plain_bans(times.tolist(), limit, interval, ban)
        assert N.edge_verdicts(times, limit, interval, ban, (N.BANNED, N.NEVER, 0)).tolist() == want
        size, state, got = int(rng.integers(1, 40)), (N.BANNED, N.NEVER, 0), []
        for chunk in (times[times // size == k] for k in np.unique(times // size)):
            got += N.edge_verdicts(chunk, limit, interval, ban, state).tolist()
            state = N.state_after(state, N.edge_summary(chunk, limit, interval, ban), limit, interval, ban)
        assert got == want


def test_edge_bans_of_a_hot_client(spark):
    rng, rows = random.Random(2), []
    for i in range(3000):
        rows.append((i, rng.choice(["hot", "hot", f"c{rng.randrange(20)}", None]), rng.randrange(20_000)))
    rows += [(9000, "c1", None), (9001, None, None)]
    df = spark.createDataFrame(rows, "log_id long, client string, t int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["log_id"]: r for r in N.edge_bans(df, 4, 60, 45, chunk_seconds=50).collect()}
    assert len(got) == len(rows) and got[9000]["allowed"] and got[9001]["allowed"]
    for client in {r[1] for r in rows}:
        own = sorted((t, i) for i, c, t in rows if c == client and t is not None)
        for (_, i), end in zip(own, plain_bans([t for t, _ in own], 4, 60, 45)):
            assert (got[i]["ban_end"] or 0) == (0 if end == N.NEVER else end * 10**6) and got[i]["allowed"] == (end == N.NEVER)
    assert N.edge_bans(df.limit(0), 4, 60, 45).collect() == []


def test_overdue_entries_per_period(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        start = rng.randrange(0, 12 * 86_400)
        rows.append((rng.choice("ab"), rng.choice([start, start, None]), rng.choice([None, start - 5, start, start + rng.randrange(1, 400_000)])))
    df = spark.createDataFrame(rows, "h string, s int, e int").select("h", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    until = 10 * 86_400 + 150
    for by in ([], ["h"]):
        got = {(*[r[b] for b in by], r["start"]): r["n"] for r in N.open_per_period(df, "s", "e", 300, F.timestamp_seconds(F.lit(until)), by).collect()}
        want = {}
        for h, s, e in rows:
            if s is None or (e is not None and e <= s):
                continue
            for p in range(s // 300, (min(e or until, until) - 1) // 300 + 1):
                key = (*([h] if by else []), p * 300)
                want[key] = want.get(key, 0) + 1
        assert got == want
    assert N.open_per_period(df.limit(0), "s", "e", 300, F.timestamp_seconds(F.lit(until))).collect() == []


def test_alert_events_agree_with_firing_points(spark):
    rng, rows = random.Random(5), []
    for series in "xyz":
        for p in range(0, 3 * 1440, 5):
            if rng.random() < 0.97:
                rows.append((series, p * 60, int(rng.random() < (0.995 if p % 1440 > 1200 or p % 1440 < 90 else 0.6))))
    points = spark.createDataFrame(rows, "series string, start long, bad int")
    firing = {(r["series"], r["start"]) for r in L.sustained(points, ["series"], F.col("bad") == 1, 300, 1500).filter("firing").collect()}
    events = {(r["series"], r["event"], r["at"]) for r in N.alert_events(points, ["series"], F.col("bad") == 1, 300, 1500).collect()}
    want = {(s, "opened", t) for s, t in firing if (s, t - 300) not in firing} | {(s, "closed", t + 300) for s, t in firing if (s, t + 300) not in firing}
    assert events == want and len(want) > 20
    one = points.filter("series = 'x'")
    assert {(r["event"], r["at"]) for r in N.alert_events(one, [], F.col("bad") == 1, 300, 1500).collect()} == {(e, t) for s, e, t in want if s == "x"}
    half = N.alert_events(one, [], F.col("bad") == 1, 300, 1500, until=F.lit(max(t for s, e, t in want if s == "x")))
    assert half.count() == sum(s == "x" for s, _, _ in want) - 1


def test_alert_stream_equals_the_batch_form(spark, tmp_path):
    rng, rows = random.Random(8), []
    for series in "pq":
        for p in range(0, 600, 5):
            if rng.random() < 0.95:
                rows.append((series, p * 60, int(rng.random() < 0.9)))
    schema = "series string, start long, bad int"
    want = {(r["series"], r["event"], r["at"]) for r in N.alert_events(spark.createDataFrame(rows, schema), ["series"], F.col("bad") == 1, 300, 1500).collect()}
    rows.sort(key=lambda r: r[1])
    parts = [rows[:80], rows[80:150], rows[150:]]
    for a, b in ((0, 1), (1, 2)):  # points that come late, but within the delay
        parts[a][-6:], parts[b][:6] = parts[b][:6], parts[a][-6:]
    parts.append([("tick", 10**6, 0)])
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        out = run_to_table(AL.alert_stream(stream, F.col("series"), F.col("bad") == 1, 300, 1500, "1 hour"), "alerts", "append")
    assert sorted((r["series"], r["event"], r["at"]) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("spread,chunk,batch", [(100, 50, 7), (100, 3000, 64), (0, None, 10_000), (10_000, None, 5)])
def test_edge_bans_in_one_stream_and_in_chunks(spark, spread, chunk, batch):
    rng, rows = random.Random(spread + batch), []
    for i in range(2500):
        client = rng.choice(["hot", "hot", f"c{rng.randrange(40)}", None])
        rows.append((i, client, rng.choice([rng.randrange(20_000), 10**9 + rng.randrange(20_000)])))
    df = spark.createDataFrame(rows, "log_id long, client string, t int").withColumn("ts", F.timestamp_seconds("t"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = {r["log_id"]: r for r in N.edge_bans(df, 4, 60, 45, chunk_seconds=chunk, spread=spread).collect()}
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(rows)
    for client in {r[1] for r in rows}:
        own = sorted((t, i) for i, c, t in rows if c == client)
        for (_, i), end in zip(own, plain_bans([t for t, _ in own], 4, 60, 45), strict=True):
            assert (got[i]["ban_end"] or 0) == (0 if end == N.NEVER else end * 10**6) and got[i]["allowed"] == (end == N.NEVER)


def test_summary_of_a_dense_chunk_is_small():
    times = np.sort(np.random.default_rng(5).integers(0, 16 * 9_000 * 10**6, 100_000))
    summary = N.edge_summary(times, 3, 3_600 * 10**6, 5_400 * 10**6)
    assert len(summary["upto"]) < 5_000  # it was one step for most requests of the last window and ban
    for until in (int(times[0]) - 1, int(times[0]) + 5_399 * 10**6):
        ends, state = N._judged(times, 3, 3_600 * 10**6, 5_400 * 10**6, (N.BANNED, until, 0))
        assert len(ends) == len(times) and state == N.state_after((N.BANNED, until, 0), summary, 3, 3_600 * 10**6, 5_400 * 10**6)
