"""Burn rates over a stream must end as the batch form says, also where requests come late."""

import random

import pytest
from pyspark.sql import functions as F

from caretide.operators import service_levels as L
from caretide.plans.stream_queries import rocksdb, run_to_table
from caretide.streaming import budgets as B

LOG = "service string, t int, ok boolean"


def burned(df):
    return {(r["service"], r["start"]): (round(r["fast_burn"], 9), round(r["slow_burn"], 9), r["firing"]) for r in df.collect()}


def test_burn_rate_stream_equals_the_batch_form(spark, tmp_path):
    rng, rows = random.Random(3), []
    for _ in range(6000):
        t = rng.randrange(0, 30 * 3600)
        rows.append((rng.choice(["hot", "hot", "a", "b", None]), t, rng.random() < (0.6 if 10 < t // 3600 < 13 else 0.995)))
    rows += [("a", None, True), ("b", 5000, None)]
    df = spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_seconds("t"))
    want = burned(L.burn_rate(df.filter("service IS NOT NULL AND t IS NOT NULL"), F.col("ok"), 0.995))
    assert any(f for _, _, f in want.values()) and not all(f for _, _, f in want.values())
    # every fifth request comes up to two hours after its time
    arrivals = sorted(rows, key=lambda r: (r[1] or 0) + (rng.randrange(7200) if rng.random() < 0.2 else 0))
    for k in range(0, len(arrivals), 1000):
        spark.createDataFrame(arrivals[k : k + 1000], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("ts").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        out = run_to_table(B.burn_rate_stream(stream.withColumn("ts", F.timestamp_seconds("t")), F.col("ok"), 0.995, "3 hours"), "burn", "update", ["service", "start"])
        assert burned(out) == want


@pytest.mark.parametrize("late,counts", [(20, True), (8, False)])
def test_late_requests_correct_what_was_given(spark, tmp_path, late, counts):
    """Within the delay a request changes the rows of its window, beyond it nothing."""
    hours = [[("a", h * 3600, True) for h in range(24)], [("a", 24 * 3600, True)], [("a", late * 3600 + 1, False)]]
    for part in hours:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        out = burned(run_to_table(B.burn_rate_stream(stream.withColumn("ts", F.timestamp_seconds("t")), F.col("ok"), 0.9, "5 hours"), "late", "update", ["service", "start"]))
    changed = {start // 3600 for (_, start), (_, slow, _) in out.items() if slow > 0}
    assert changed == (set(range(late, 25)) if counts else set())
