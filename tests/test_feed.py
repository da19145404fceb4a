"""The event log must give ids without gaps and resume behind any of them."""

import pytest
from pyspark.sql import functions as F

from caretide.streaming import feed as E, ingest as I

SCHEMA = "t long, k string"


def write(spark, folder, batches):
    for i, rows in enumerate(batches):
        E.append(spark.createDataFrame(rows, SCHEMA), folder, i, ["t", "k"])


def ids(df):
    return [(r["event_id"], r["t"]) for r in df.orderBy("event_id").collect()]


def test_ids_are_gapless_in_order_and_kept_by_a_replay(spark, tmp_path):
    folder = str(tmp_path)
    batches = [[(t, f"k{t % 7}") for t in range(99, -1, -1)], [], [(t, "x") for t in range(100, 130)]]
    write(spark, folder, batches)
    want = [(t + 1, t) for t in range(130)]
    assert ids(E.resume_from(spark, folder, 0, SCHEMA)) == want
    E.append(spark.createDataFrame(batches[2], SCHEMA), folder, 2, ["t", "k"])  # the batch runs again
    for last in (0, 1, 57, 99, 100, 101, 129, 130):
        assert ids(E.resume_from(spark, folder, last, SCHEMA)) == want[last:]


def test_a_reader_skips_the_folders_before_its_id(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, [[(t, "a") for t in range(i * 50, i * 50 + 50)] for i in range(4)])
    tail = E.resume_from(spark, folder, 160, SCHEMA)
    assert len(tail.inputFiles()) and ids(tail) == [(t + 1, t) for t in range(160, 200)]
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(first_id" in plan
    read = {r[0] for r in tail.select(F.input_file_name()).distinct().collect()}
    assert read and all("batch=3" in p for p in read)


def test_what_cannot_be_resumed_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, [[(t, "a") for t in range(i * 10, i * 10 + 10)] for i in range(4)])
    for last in (41, -1):
        with pytest.raises(E.ResumeError, match="never given"):
            E.resume_from(spark, folder, last, SCHEMA)
    E.drop_before(spark, folder, 2)
    with pytest.raises(E.ResumeError, match="no longer kept"):
        E.resume_from(spark, folder, 5, SCHEMA)
    assert ids(E.resume_from(spark, folder, 20, SCHEMA)) == [(t + 1, t) for t in range(20, 40)]
    spark.createDataFrame([(31, 35, 3)], E.INDEX).write.mode("overwrite").parquet(f"{folder}/index/3")
    spark.createDataFrame([(38, 40, 4)], E.INDEX).write.mode("overwrite").parquet(f"{folder}/index/4")
    with pytest.raises(E.ResumeError, match="once each"):
        E.resume_from(spark, folder, 22, SCHEMA)


def test_change_feed_keeps_two_versions_and_reports_what_moves(spark, tmp_path):
    schema = "encounter_id string, updated_at int, status string"
    batches = [
        [("a", 1, "pending"), ("b", 2, "pending"), ("c", 3, "pending")],
        [("d", 4, "pending"), ("c", 5, "approved"), ("a", 0, "stale")],
        [("a", 6, "approved"), ("b", 1, "stale")],
        [("z", 2, "late")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        I.change_feed_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True, limit=2).awaitTermination()
        assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) <= 2
    got = {(r["batch"], r["event"], r["encounter_id"]) for r in spark.read.schema(schema + ", event string, batch int").parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "new_triage", "b"), (0, "new_triage", "c"), (1, "new_triage", "d"), (1, "updated", "c"), (2, "new_triage", "a")}
