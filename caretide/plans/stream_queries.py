"""Sinks and streaming operators, run to the end of the given tables and read back."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from caretide import settings as S
from caretide.operators import screening, service_levels as L
from caretide.plans.inputs import ctes, load, load_stream
from caretide.plans.message_queries import _data_spark, _decoded, _deliveries, _deliveries_sql, _is_audit, _repeated
from caretide.plans.service_queries import alert_sql, burn_sql, metric_points
from caretide.plans.registry import epoch, query, sql_period
from caretide.plans.state_queries import FULL_ENTRY, _machine_sql, _verdicts, full_events
from caretide.sources.tables import drop_shuffles, scratch, table_stream, write_partitioned
from caretide.streaming import alerts as AL, approval_table as T, approvals as SA, budgets as BU, feed as E, ingest as I


def run_to_table(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Process all available input and return what the sink holds; in update mode the newest row of each key."""
    spark = stream.sparkSession
    folder = scratch(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not keys:
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    updates = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return newest.select("row.*")


@contextmanager
def rocksdb(spark):
    """The state store that keyed operators need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, SA.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("write_partitioned", f"{ctes('calls')} SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, node, count(*) AS n FROM calls GROUP BY 1, 2")
def write_partitioned_query(spark, d):
    """Write by day, clustered by encounter and node; read back by the partition column."""
    path = scratch(spark, "calls")
    write_partitioned(load(spark, d, "calls"), path, ["encounter_id", "node"], ts="ts")
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "node").agg(F.count("*").alias("n"))


@query("sink_batched", f"{ctes('calls')} SELECT event_id, encounter_id, round(cost_usd, 8) AS cost_usd FROM calls")
def sink_batched(spark, d):
    folder = scratch(spark, "batched")
    I.sink_batched(load_stream(spark, d, "calls"), f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "encounter_id", F.round("cost_usd", 8).alias("cost_usd"))


@query(
    "audit_stream",
    f"""{_decoded} SELECT 'audit_trail' AS target, count(*) AS n FROM d WHERE {_is_audit}
UNION ALL SELECT 'classifier_feedback', count(*) FROM d WHERE reject_reason IS NULL AND json_extract_string(j, '$.event_type') = 'classifier_feedback' AND json_exists(j, '$.corrected_category')
UNION ALL SELECT 'rejects', count(*) FROM d WHERE reject_reason IS NOT NULL OR (json_extract_string(j, '$.event_type') = 'classifier_feedback' AND NOT json_exists(j, '$.corrected_category'))""",
)
def audit_stream(spark, d):
    folder = scratch(spark, "audit")
    stream = load_stream(spark, d, "audit_bodies").selectExpr("message_id", f"{_data_spark} AS data")
    I.audit_stream(stream, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    counts = [
        spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/{t}").select(F.lit(t).alias("target"))
        for t in ("audit_trail", "classifier_feedback", "rejects")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("target").agg(F.count("*").alias("n"))


@query("approval_stream", f"{_machine_sql()} {_verdicts}")
def approval_stream(spark, d):
    """Both topics through the keyed stateful operator."""
    first = load_stream(spark, d, "completed")
    again = load_stream(spark, d, "completed").filter("redelivered").withColumns(
        {"ts": F.expr("ts + INTERVAL 120 DAYS"), "seq": F.col("seq") + 1_000_000_000}
    )
    completed = first.unionByName(again).withColumn("ts", F.col("ts").cast("timestamp"))
    reviews = load_stream(spark, d, "reviews").withColumn("ts", F.col("ts").cast("timestamp"))
    out = SA.approval_stream(SA.union_events(completed, reviews))
    with rocksdb(spark):
        return run_to_table(out, "approvals", "append").select("encounter_id", "seq", "status", "outcome")


#: Rows of a file of a stream that is made of a table.
FILE_ROWS = 1_000_000


def in_files(df: DataFrame, folder: str, ts: str, files: int, keep: bool = True) -> DataFrame:
    """The rows as a stream of so many micro-batches, each of later times than the ones before it. Batches of many rows are
    written as several files by as many tasks, all batches as equally many. Rows are only shuffled for it where they come in
    fewer partitions than there are tasks at a time. Unless they are to be kept, the stream deletes the files of a batch that
    is over."""
    cuts = f"percentile_approx(unix_seconds(t), array({', '.join(str(k / files) for k in range(1, files))}))"
    seen = df.select(F.col(ts).cast("timestamp").alias("t")).selectExpr(f"{cuts} AS q", "count(*) AS n").first()
    each = max(1, -(-seen["n"] // (files * FILE_ROWS)))
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    bounds = [None, *seen["q"], None]
    spread = each > 1 and df.rdd.getNumPartitions() < min(each, df.sparkSession.sparkContext.defaultParallelism)
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        part = df if low is None else df.filter(at > low)
        part = part if high is None else part.filter(at <= high)
        (part.repartition(each) if spread else part.coalesce(each)).write.mode("append").parquet(folder)
        if each > 1:  # partitions without rows leave no file
            for _ in range(k * each - len(df.sparkSession.read.schema(df.schema).parquet(folder).inputFiles())):
                df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(folder)
        if spread:
            drop_shuffles(df.sparkSession)
    reader = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", each)
    return (reader if keep else reader.option("cleanSource", "delete")).parquet(folder)


@query("approval_table_stream", FULL_ENTRY)
def approval_table_stream(spark, d):
    """Both topics in five micro-batches through the table of entries."""
    folder = scratch(spark, "approval-table")
    events = full_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = in_files(events, f"{folder}/in", "ts", 5, keep=False)
    T.approval_table_stream(stream, folder, f"{folder}/checkpoint", once=True, every=2).awaitTermination()
    return T.current(spark, folder, events, 5, every=2).withColumns({c: epoch(c) for c in ("created_at", "updated_at", "reviewed_at")})


def in_periods(df: DataFrame, folder: str, ts: str, cuts: list[str]) -> DataFrame:
    """The rows as a stream of one file up to each of these times, and one of what comes after the last."""
    at = F.col(ts).cast("timestamp")
    bounds = [F.lit(True), *[at >= F.lit(c).cast("timestamp") for c in cuts]]
    for low, high in zip(bounds, [*bounds[1:], F.lit(False)], strict=True):
        df.filter(low & ~high).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("alert_stream", alert_sql("subscription, ").replace("SELECT subscription, 'opened'", "SELECT subscription AS series, 'opened'"))
def alert_stream(spark, d):
    """The hourly alerts of each subscription in four micro-batches; a tick of the clock at the end lets the last runs end."""
    folder = scratch(spark, "alerts")
    points = L.align(metric_points(spark, d), ["subscription"], "ts", "depth", L.HOUR, "sum").withColumn("ts", F.timestamp_seconds("start"))
    tick = points.agg(F.lit("tick").alias("subscription"), (F.max("start") + 10 * L.DAY).alias("start"), F.lit(0).alias("value"))
    stream = in_files(points, f"{folder}/in", "ts", 4)
    points.unionByName(tick, allowMissingColumns=True).filter("subscription = 'tick'").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with rocksdb(spark):
        return run_to_table(AL.alert_stream(stream, F.col("subscription"), F.col("value") > 10, L.HOUR, 3 * L.HOUR, "2 hours"), "alerts", "append").drop("batch")


@query("burn_rate_stream", burn_sql("response_class = '2xx'", S.SLO_AVAILABILITY))
def burn_rate_stream(spark, d):
    """The burn of every service in four micro-batches; every seventh request arrives three hours after its time."""
    folder = scratch(spark, "budgets")
    requests = load(spark, d, "requests").select("service", "response_class", F.col("ts").cast("timestamp").alias("ts"), "log_id")
    arrived = F.when(F.col("log_id") % 7 == 0, F.expr("ts + INTERVAL 3 HOURS")).otherwise(F.col("ts"))
    stream = in_files(requests.withColumn("arrived", arrived), f"{folder}/in", "arrived", 4)
    with rocksdb(spark):
        burned = BU.burn_rate_stream(stream, screening.is_2xx(F.col("response_class")), S.SLO_AVAILABILITY, "6 hours")
        out = run_to_table(burned, "budgets", "update", ["service", "start"])
    return out.withColumns({c: F.round(c, 6) for c in ("fast_burn", "slow_burn")})


@query(
    "dead_letter_stream",
    f"WITH {_deliveries_sql} SELECT message_id, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failures, count(*) FILTER (NOT ok) >= 5 OR bool_or(permanent AND NOT ok) AS dead FROM deliveries GROUP BY 1 HAVING NOT bool_or(ok)",
)
def dead_letter_stream(spark, d):
    log = table_stream(spark, d, "events").selectExpr(*[f"{e} AS {c}" for c, e in _deliveries.items()])
    log = log.withColumn("delivered_at", F.col("delivered_at").cast("timestamp"))
    return I.latest_dead(run_to_table(I.dead_letter_stream(log), "dead", "update", ["message_id", "window_start"]))


@query("dedup_stream", f"SELECT DISTINCT {_repeated} AS message_id FROM events")
def dedup_stream(spark, d):
    log = table_stream(spark, d, "events").selectExpr(f"{_repeated} AS message_id", "CAST(ts AS TIMESTAMP) AS publish_time")
    return run_to_table(I.dedup_stream(log), "dedup", "append").select("message_id")


@query("usage_stream", f"{ctes('calls')} SELECT model, {sql_period('ts', 3600)} AS start, CAST(sum(tokens_in + tokens_out) AS DOUBLE) AS value FROM calls GROUP BY 1, 2")
def usage_stream(spark, d):
    calls = load_stream(spark, d, "calls").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = I.usage_stream(L.llm_usage_points(calls), "token_count", ["model"], "1 hour")
    out = run_to_table(hourly, "usage", "update", ["model", "window"])
    return out.select("model", epoch(F.col("window.start")).alias("start"), "value")


@query("percentile_stream", f"{ctes('requests')} SELECT service, count(latency_ms) AS n, true AS close FROM requests WHERE latency_ms IS NOT NULL GROUP BY 1")
def percentile_stream(spark, d):
    """p99 of each service over all hours, from hourly sketches that a stream keeps: within the exact 98th and 100th."""
    logs = load_stream(spark, d, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = run_to_table(L.percentile_sketches(logs, ["service"], "latency_ms", 3600), "sketches", "update", ["service", "start"])
    p99 = L.merged_percentile(hourly, ["service"], 0.99, "p99")
    whole = load(spark, d, "requests").select("service", "latency_ms")
    low, high = (L.exact_percentile(whole, ["service"], "latency_ms", q, name, 100.0) for q, name in ((0.98, "low"), (1.0, "high")))
    return p99.join(low, "service").join(high, "service").select("service", "n", F.col("p99").between(F.col("low"), F.col("high")).alias("close"))


@query("rate_limit_stream", f"{ctes('requests')} SELECT client, {sql_period('ts', 3600)} AS start, count(*) AS requests FROM requests GROUP BY 1, 2 HAVING count(*) > 2")
def rate_limit_stream(spark, d):
    logs = load_stream(spark, d, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_table(I.rate_limit_stream(logs, 2, "1 hour"), "limits", "update", ["client", "window"])
    return out.select("client", epoch(F.col("window.start")).alias("start"), "requests")


@query(
    "change_feed_stream",
    f"""{ctes('session_log')}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY updated_at DESC) AS rn FROM session_log) WHERE rn = 1 ORDER BY updated_at DESC, encounter_id LIMIT 50)
SELECT 'new_triage' AS event, encounter_id, seq FROM cur""",
)
def change_feed_stream(spark, d):
    folder = scratch(spark, "feed")
    log = load_stream(spark, d, "session_log")
    I.change_feed_stream(log, f"{folder}/state", f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event", "encounter_id", "seq")


_FEED_CUTS = ["2024-01-10", "2024-01-20", "2024-01-29"]
_snapshots = ",\n".join(
    f"""s{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY updated_at DESC) AS rn FROM session_log{f" WHERE updated_at < TIMESTAMP '{cut}'" if cut else ""}) WHERE rn = 1 ORDER BY updated_at DESC, encounter_id LIMIT 50)"""
    for i, cut in enumerate([*_FEED_CUTS, None])
)
_feed_changes = " UNION ALL ".join(
    f"""SELECT {i} AS batch, CASE WHEN p.encounter_id IS NULL THEN 'new_triage' ELSE 'updated' END AS event, c.encounter_id, c.status, c.seq FROM s{i} c LEFT JOIN {f"s{i - 1}" if i else "(SELECT * FROM s0 WHERE false)"} p USING (encounter_id) WHERE p.encounter_id IS NULL OR p.seq <> c.seq"""
    for i in range(len(_FEED_CUTS) + 1)
)


@query("change_feed_batches", f"{ctes('session_log')}, {_snapshots} {_feed_changes}")
def change_feed_batches(spark, d):
    """The feed of four micro-batches: sessions that are new, updated, pushed out and back."""
    folder = scratch(spark, "feed-batches")
    log = in_periods(load(spark, d, "session_log"), f"{folder}/in", "updated_at", _FEED_CUTS)
    I.change_feed_stream(log, f"{folder}/state", f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").select("batch", "event", "encounter_id", "status", "seq")


@query(
    "resume_from",
    f"""{ctes('session_log')}, numbered AS (SELECT row_number() OVER (ORDER BY updated_at, seq) AS event_id, encounter_id, status, seq FROM session_log)
SELECT * FROM numbered WHERE event_id > (SELECT count(*) * 2 // 3 FROM session_log)""",
)
def resume_from(spark, d):
    """All session events as a log of five micro-batches, read on behind the event at two thirds of it."""
    folder = scratch(spark, "event-log")
    log = load(spark, d, "session_log").select("encounter_id", "status", "seq", "updated_at")
    stream = in_files(log, f"{folder}/in", "updated_at", 5)
    E.event_log_stream(stream, f"{folder}/log", f"{folder}/checkpoint", ["updated_at", "seq"], once=True).awaitTermination()
    last = E.newest_id(spark, f"{folder}/log", 5) * 2 // 3
    return E.resume_from(spark, f"{folder}/log", last, log.schema).drop("updated_at")
