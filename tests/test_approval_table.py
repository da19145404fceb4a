"""The table of approval entries must move as the status machine says, batch by batch and run again."""

import random
import time

from pyspark.sql import functions as F

from caretide.operators import approvals as A
from caretide.streaming import approval_table as T

COMPLETED = "encounter_id string, t int, seq bigint, routing_reason string, category string, confidence double, patient_id string, triage_result string, sentinel_check string, audit_ref string"
DECISIONS = "encounter_id string, t int, seq bigint, status string, reviewer_id string, corrected_category string, notes string"


def timed(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def history(spark, n, seed=0):
    """A third of all events are those of one encounter."""
    rng, completed, decisions = random.Random(seed), [], []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"e{rng.randrange(12)}"
        if rng.random() < 0.4:
            completed.append((key, i * 600, i, rng.choice("ab"), "c", 0.5, f"p-{key}", f'{{"n":{i}}}', None, f"ref-{i}"))
        else:
            decisions.append((key, i * 600, i, rng.choice(["approved", "rejected"]), f"dr-{i % 4}", rng.choice(["a", "b", "", None]), rng.choice([None, f"note {i}"])))
    return timed(spark, completed, COMPLETED), timed(spark, decisions, DECISIONS)


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=str)


def batches(events, edges):
    at = F.unix_seconds("ts") / 600
    bounds = [-1, *edges, 10**9]
    return [events.filter((at > low) & (at <= high)) for low, high in zip(bounds, bounds[1:])]


def run(spark, folder, events, edges, idempotent=False, every=2):
    schema = events.schema
    for i, batch in enumerate(batches(events, edges)):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        T.approval_table_stream(stream, folder, f"{folder}/cp", once=True, idempotent=idempotent, every=every).awaitTermination()
    return T.current(spark, folder, events, len(edges) + 1, every)


def test_table_equals_the_status_machine(spark, tmp_path):
    for idempotent, edges in ((False, [40, 41, 130, 131, 200]), (True, [80])):
        completed, decisions = history(spark, 240)
        want = A.approval_state_machine(completed, decisions, idempotent)
        events = A.approval_events(completed, decisions)
        folder = str(tmp_path / str(idempotent))
        got = run(spark, folder, events, edges, idempotent)
        assert rows(got) == rows(want.entries)
        for name in ("verdicts", "approved", "feedback"):
            out = spark.read.parquet(f"{folder}/{name}").drop("batch", "round")
            assert rows(out) == rows(getattr(want, name).drop("round")), name
        sessions = spark.read.parquet(f"{folder}/sessions").groupBy("encounter_id").agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*").drop("batch")
        assert rows(sessions) == rows(want.sessions)
        if idempotent:
            continue
        # versions 3 and 5 are bases; what came before the base before the last one is gone
        assert sorted(p.name for p in (tmp_path / str(idempotent) / "base").iterdir()) == ["3", "5"]
        assert sorted(p.name for p in (tmp_path / str(idempotent) / "delta").iterdir()) == ["4", "5"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    completed, decisions = history(spark, 60, seed=4)
    events = A.approval_events(completed, decisions)
    schema = T.entry_schema(events)
    first, second = batches(events, [30])
    A.replay(T.advance(None, first)).entries.select(*schema.names).write.parquet(f"{tmp_path}/delta/0")
    once = rows(A.replay(T.advance(T.read_version(spark, str(tmp_path), schema, 1), second)).entries)
    for _ in range(2):
        result = A.replay(T.advance(T.read_version(spark, str(tmp_path), schema, 1), second))
        result.entries.select(*schema.names).write.mode("overwrite").parquet(f"{tmp_path}/delta/1")
        assert rows(result.entries) == once
    want = A.approval_state_machine(completed, decisions)
    assert rows(T.read_version(spark, str(tmp_path), schema, 2)) == rows(want.entries)


def test_null_encounters_and_empty_batches(spark, tmp_path):
    completed, decisions = history(spark, 10)
    none = A.approval_events(completed.withColumn("encounter_id", F.lit(None).cast("string")), decisions.limit(0))
    assert T.advance(None, none).isEmpty()
    events = A.approval_events(completed, decisions)
    assert A.replay(T.advance(None, events.limit(0))).verdicts.isEmpty()


def test_tasks_follow_the_events(spark, monkeypatch):
    from caretide.operators import approvals as A
    from tests.test_state import completed_frame, decision_frame

    completed = completed_frame(spark, [(f"e{i % 23}" if i % 3 else "hot", i * 50, i, f"x{i}", "c", 0.5) for i in range(300)])
    made = decision_frame(spark, [(f"e{i % 29}" if i % 3 else "hot", i * 70, 10_000 + i, "approved" if i % 2 else "rejected", f"r{i}", "y") for i in range(300)])
    names = ("verdicts", "queue", "approved", "feedback", "entries", "sessions")
    for idempotent in (False, True):
        few = A.approval_state_machine(completed, made, idempotent)
        want = {n: sorted(map(str, getattr(few, n).collect())) for n in names}
        monkeypatch.setattr(A, "TASK_EVENTS", 60)
        monkeypatch.setattr(A, "SPAN", 4)
        many = A.approval_state_machine(completed, made, idempotent)
        assert A.tasks_for(completed, made) == 10
        assert "hashpartitioning(encounter_id" in (plan := many.entries._jdf.queryExecution().executedPlan().toString()) and ", 10)" in plan
        assert {n: sorted(map(str, getattr(many, n).collect())) for n in names} == want
        monkeypatch.undo()


def test_tasks_hold_few_events_also_where_the_session_has_more_partitions(spark, monkeypatch):
    from caretide.operators import approvals as A
    from tests.test_state import completed_frame, decision_frame

    completed = completed_frame(spark, [(f"e{i % 23}", i * 50, i, f"x{i}", "c", 0.5) for i in range(300)])
    made = decision_frame(spark, [(f"e{i % 29}", i * 70, 10_000 + i, "approved" if i % 2 else "rejected", f"r{i}", "y") for i in range(300)])
    want = A.approval_state_machine(completed, made)
    assert A.tasks_for(completed, made) is None
    monkeypatch.setattr(A, "TASK_EVENTS", 200)  # three tasks, and the session's shuffles have eight
    got = A.approval_state_machine(completed, made)
    for name in ("verdicts", "queue", "approved", "feedback", "entries", "sessions"):
        frame = getattr(got, name)
        rows = sorted(map(str, frame.collect()))
        assert rows == sorted(map(str, getattr(want, name).collect())), name
        assert ", 3), REPARTITION_BY_NUM" in frame._jdf.queryExecution().executedPlan().toString(), name


def test_partitions_stay_where_tasks_write_shuffles_unsorted(spark, monkeypatch):
    from caretide.operators import approvals as A

    events = spark.range(600)
    monkeypatch.setattr(A, "TASK_EVENTS", 2)
    assert A.tasks_for(events) == 200  # it was 300, and the tasks before the shuffle held all that they read
    monkeypatch.setattr(A, "MOST_EVENTS", 2)
    assert A.tasks_for(events) == 300


def test_carry_between_chunks_holds_no_keys(spark):
    from caretide.operators import approvals as A
    from tests.test_state import completed_frame, decision_frame

    # chunks of a minute: decisions before any round, a round decided two chunks later, chunks of decisions alone, a round left open
    completed = completed_frame(spark, [("a", 60, 1, "x", "c", 0.5), ("a", 61, 2, "x", "c", 0.5), ("a", 300, 3, "x", "c", 0.5), ("b", 0, 4, "x", "c", 0.5)])
    made = decision_frame(spark, [(e, t, 10 + t, "approved", "r", "y") for e, t in [("a", 1), ("a", 181), ("a", 182), ("a", 241), ("a", 301), ("b", 119)]])
    history = A.rounds(A.approval_events(completed, made), 60, 2)
    got = [(r["encounter_id"], r["seq"], r["round"], r["accepted"]) for r in history.filter("kind = 1").orderBy("encounter_id", "seq").collect()]
    assert got == [("a", 11, 0, False), ("a", 191, 2, True), ("a", 192, 2, False), ("a", 251, 2, False), ("a", 311, 3, True), ("b", 129, 1, True)]
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan  # four of them held a row per round of a task
    assert plan.split("Initial Plan")[-1].count("Window [") == 3  # it was five


def test_batches_of_several_files(spark, tmp_path, monkeypatch):
    from caretide.plans import stream_queries as Q

    df = spark.range(100).selectExpr("id", "timestamp_seconds(id) AS ts")
    monkeypatch.setattr(Q, "FILE_ROWS", 9)
    stream, seen = Q.in_files(df, str(tmp_path / "in"), "ts", 4), []
    writer = stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted((r["id"], len(batch.inputFiles())) for r in batch.collect())))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and [i for rows in seen for i, _ in rows] == list(range(100))
    assert len(spark.read.parquet(str(tmp_path / "in")).inputFiles()) == 12  # it was one file a batch


def shuffles(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_batches_in_slices(spark, tmp_path, monkeypatch):
    completed, decisions = history(spark, 240, seed=7)
    completed = completed.unionByName(completed.limit(3).withColumn("encounter_id", F.lit(None).cast("string")))
    want = A.approval_state_machine(completed.filter("encounter_id IS NOT NULL"), decisions)
    events = A.approval_events(completed, decisions)
    monkeypatch.setattr(T, "SLICE_EVENTS", 30)
    modes, left = [], []
    advance, drop = T.advance, T.drop_shuffles
    monkeypatch.setattr(T, "advance", lambda previous, some, *rest, **more: modes.append(some.count()) or advance(previous, some, *rest, **more))

    def dropped(spark):
        drop(spark)
        for _ in range(100):  # files go in a thread of their own
            if shuffles(spark) == 0:
                break
            time.sleep(0.05)
        left.append(shuffles(spark))

    monkeypatch.setattr(T, "drop_shuffles", dropped)
    got = run(spark, str(tmp_path), events, [120])
    assert len(modes) > 5 and sum(modes) == 243 and sum(n > 30 for n in modes) == 2  # the hot encounter is whole
    assert len(left) > len(modes) and max(left[2:]) == 0  # the first ones drop what other tests left; files of all slices were there together
    assert rows(got) == rows(want.entries)
    for name in ("verdicts", "approved", "feedback"):
        assert rows(spark.read.parquet(f"{tmp_path}/{name}").drop("batch", "round")) == rows(getattr(want, name).drop("round")), name
    # slices are appended to what the first one of a batch that runs again replaces
    schema = T.entry_schema(events)
    monkeypatch.setattr(T, "SLICE_EVENTS", 5)
    T._compact(spark, str(tmp_path), schema, 1, 2)
    assert len(left) > len(modes) + 3
    assert rows(T.read_version(spark, str(tmp_path), schema, 2, 2)) == rows(want.entries)


def test_files_of_a_batch_go_when_it_is_over(spark, tmp_path, monkeypatch):
    from caretide.plans import stream_queries as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 9)
    for n in (1, 8):  # partitions
        df = spark.range(0, 100, 1, n).selectExpr("id", "timestamp_seconds(id) AS ts")
        if n == 8:  # rows are not shuffled
            monkeypatch.setattr(type(df), "repartition", None)
        stream, seen = Q.in_files(df, str(tmp_path / f"in{n}"), "ts", 4, keep=False), []
        writer = stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(r["id"] for r in batch.collect())))
        writer.option("checkpointLocation", str(tmp_path / f"cp{n}")).trigger(availableNow=True).start().awaitTermination()
        assert len(seen) == 4 and sum(seen, []) == list(range(100))
        assert 3 <= len(spark.read.schema(df.schema).parquet(str(tmp_path / f"in{n}")).inputFiles()) < 12
