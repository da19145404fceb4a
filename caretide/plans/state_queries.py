"""Keyed documents, approvals, reconciliation and dashboard queries."""

from pyspark.sql import functions as F

from caretide import settings as S
from caretide.functions import labels as L
from caretide.operators import approvals as A, dashboards as B, keyed as K, outputs as O, records as R, screening
from caretide.plans.inputs import cte, ctes, load
from caretide.plans.registry import at, epoch, query, sql_epoch
from caretide.sources.tables import table


def sessions(spark, d):
    """Current session documents: the last write per encounter."""
    return K.upsert_replace(load(spark, d, "session_log"), ["encounter_id"], ["updated_at", "seq"])


_sessions = f"""{ctes('session_log')}, sessions AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY updated_at DESC, seq DESC) AS rn FROM session_log) WHERE rn = 1)"""


@query("upsert_replace", f"{_sessions} SELECT encounter_id, seq, status, level, confidence, note FROM sessions")
def upsert_replace(spark, d):
    return sessions(spark, d).select("encounter_id", "seq", "status", "level", "confidence", "note")


@query(
    "upsert_merge",
    f"""{ctes('session_log')} SELECT encounter_id, arg_max(status, seq) AS status, arg_max_null(note, seq) FILTER (has_note) AS note,
  arg_max_null(level, seq) FILTER (circuit_breaker_tripped) AS level FROM session_log GROUP BY 1""",
)
def upsert_merge(spark, d):
    log = load(spark, d, "session_log")
    written = {"status": F.lit(True), "note": F.col("has_note"), "level": F.col("circuit_breaker_tripped")}
    return K.upsert_merge(log, ["encounter_id"], ["seq"], written)


_updates = {
    "encounter_id": "concat('enc-', CAST(user_id * 2 AS STRING))",
    "seq": "event_id",
    "status": "event_type",
    "note": "CASE WHEN event_id % 2 = 0 THEN props END",
    "has_note": "event_id % 3 = 0",
}


@query(
    "update_existing",
    f"""{_sessions}, updates AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _updates.items())} FROM events),
patch AS (SELECT encounter_id, arg_max(status, seq) AS new_status, arg_max_null(note, seq) FILTER (has_note) AS new_note, bool_or(has_note) AS touched FROM updates GROUP BY 1)
SELECT encounter_id, coalesce(new_status, status) AS status, CASE WHEN touched THEN new_note ELSE note END AS note, CAST(NULL AS VARCHAR) AS reject_reason, CAST(NULL AS BIGINT) AS seq FROM sessions LEFT JOIN patch USING (encounter_id)
UNION ALL SELECT encounter_id, status, note, 'not_found', seq FROM updates WHERE encounter_id NOT IN (SELECT encounter_id FROM sessions)""",
)
def update_existing(spark, d):
    updates = table(spark, d, "events").selectExpr(*[f"{e} AS {c}" for c, e in _updates.items()])
    merged, missed = K.update_existing(
        sessions(spark, d), updates, ["encounter_id"], ["seq"], {"status": F.lit(True), "note": F.col("has_note")}
    )
    kept = merged.select("encounter_id", "status", "note", F.lit(None).cast("string").alias("reject_reason"), F.lit(None).cast("bigint").alias("seq"))
    return kept.unionByName(missed.select("encounter_id", "status", "note", "reject_reason", "seq"))


# --- approvals ---------------------------------------------------------------

_columns = "encounter_id, ts, seq, routing_reason, category, confidence"
_redelivered = f"SELECT {_columns} FROM completed UNION ALL SELECT encounter_id, ts + INTERVAL 120 DAYS AS ts, seq + 1000000000 AS seq, routing_reason, category, confidence FROM completed WHERE redelivered"


def _completed(spark, d):
    first = load(spark, d, "completed")
    again = first.filter("redelivered").withColumns({"ts": F.expr("ts + INTERVAL 120 DAYS"), "seq": F.col("seq") + 1_000_000_000})
    return first.unionByName(again).drop("redelivered")


def _machine(spark, d, **options):
    return A.approval_state_machine(_completed(spark, d), load(spark, d, "reviews"), **options)


def _machine_sql(idempotent: bool = False) -> str:
    opened = "round" if not idempotent else "least(round, 1)"
    live = "kind = 0" if not idempotent else "kind = 0 AND raw_round = 1"
    return f"""{ctes('completed', 'reviews')}, opened AS ({_redelivered}),
events AS (SELECT encounter_id, ts, seq, 0 AS kind, routing_reason, category, confidence, NULL AS status, NULL AS reviewer_id, NULL AS corrected_category FROM opened
  UNION ALL SELECT encounter_id, ts, seq, 1, NULL, NULL, NULL, status, reviewer_id, corrected_category FROM reviews),
r AS (SELECT *, sum(1 - kind) OVER (PARTITION BY encounter_id ORDER BY ts, kind, seq ROWS UNBOUNDED PRECEDING) AS round FROM events),
rr AS (SELECT * EXCLUDE (round), round AS raw_round, {opened} AS round FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY encounter_id, round, kind ORDER BY ts, seq) AS rn FROM rr),
entries AS (SELECT * FROM n WHERE {live}),
firsts AS (SELECT * FROM n WHERE kind = 1 AND rn = 1 AND round > 0)"""


_verdicts = "SELECT encounter_id, seq, status, CASE WHEN round = 0 THEN 'not_found' WHEN rn = 1 THEN 'accepted' ELSE 'conflict' END AS outcome FROM n WHERE kind = 1"


@query("approval_state_machine", f"{_machine_sql()} {_verdicts}")
def approval_state_machine(spark, d):
    return _machine(spark, d).verdicts.select("encounter_id", "seq", "status", "outcome")


@query("approval_state_machine_idempotent", f"{_machine_sql(True)} {_verdicts}")
def approval_state_machine_idempotent(spark, d):
    return _machine(spark, d, idempotent=True).verdicts.select("encounter_id", "seq", "status", "outcome")


@query(
    "approval_queue",
    f"""{_machine_sql()}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY round DESC) AS k FROM entries) WHERE k = 1)
SELECT l.encounter_id, coalesce(f.status, 'pending_approval') AS status, {sql_epoch('l.ts')} AS created_at, {sql_epoch('coalesce(f.ts, l.ts)')} AS updated_at, f.reviewer_id, nullif(f.corrected_category, '') AS corrected_category
FROM last l LEFT JOIN firsts f ON f.encounter_id = l.encounter_id AND f.round = l.round""",
)
def approval_queue(spark, d):
    return _machine(spark, d).queue.withColumns({c: epoch(c) for c in ("created_at", "updated_at")})


_last_entry = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY round DESC) AS k FROM entries) WHERE k = 1)"
_notes = "SELECT encounter_id AS eid, seq AS sid, notes FROM reviews_full"


@query(
    "approval_sessions",
    f"""{_machine_sql()}, {cte('reviews_full')}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY round DESC) AS k FROM firsts) WHERE k = 1)
SELECT encounter_id, status, reviewer_id AS reviewed_by, r.notes AS reviewer_notes, {sql_epoch('ts')} AS reviewed_at, {sql_epoch('ts')} AS updated_at FROM f JOIN ({_notes}) r ON eid = encounter_id AND sid = seq""",
)
def approval_sessions(spark, d):
    """What decisions write to the sessions of their encounters."""
    result = A.approval_state_machine(_completed(spark, d), load(spark, d, "reviews_full"))
    return result.sessions.withColumns({c: epoch(c) for c in ("reviewed_at", "updated_at")})


FULL_ENTRY = f"""{_machine_sql()}, {cte('completed_full')}, {cte('reviews_full')}, {_last_entry}
SELECT l.encounter_id, coalesce(f.status, 'pending_approval') AS status, {sql_epoch('l.ts')} AS created_at, {sql_epoch('coalesce(f.ts, l.ts)')} AS updated_at,
  {sql_epoch('f.ts')} AS reviewed_at, l.routing_reason, l.category, l.confidence, f.reviewer_id, nullif(f.corrected_category, '') AS corrected_category, r.notes AS reviewer_notes,
  c.patient_id, c.triage_result, c.sentinel_check, c.audit_ref
FROM last l JOIN completed_full c ON c.encounter_id = l.encounter_id LEFT JOIN firsts f ON f.encounter_id = l.encounter_id AND f.round = l.round
LEFT JOIN ({_notes}) r ON eid = f.encounter_id AND sid = f.seq"""


def full_events(spark, d):
    """Both topics with all that they bring along, repeated deliveries included."""
    first = load(spark, d, "completed_full")
    again = first.filter("redelivered").withColumns({"ts": F.expr("ts + INTERVAL 120 DAYS"), "seq": F.col("seq") + 1_000_000_000})
    return A.approval_events(first.unionByName(again).drop("redelivered"), load(spark, d, "reviews_full"))


@query("approval_entries", FULL_ENTRY)
def approval_entries(spark, d):
    """Every entry with patient, result, check, audit reference and review."""
    events = full_events(spark, d)
    tasks = A.tasks_for(events)
    entries = A.replay(A.rounds(events, partitions=tasks), partitions=tasks).entries
    return entries.withColumns({c: epoch(c) for c in ("created_at", "updated_at", "reviewed_at")})


@query(
    "approved_events",
    f"{_machine_sql()} SELECT e.encounter_id, f.reviewer_id, {sql_epoch('f.ts')} AS approved_at FROM entries e JOIN firsts f USING (encounter_id, round) WHERE f.status = 'approved'",
)
def approved_events(spark, d):
    return _machine(spark, d).approved.withColumn("approved_at", epoch("approved_at"))


def _feedback_sql(column: str) -> str:
    return f"""{_machine_sql()} SELECT e.encounter_id, e.{column} AS original_category, f.corrected_category, e.confidence AS classifier_confidence, f.reviewer_id
FROM entries e JOIN firsts f USING (encounter_id, round) WHERE f.corrected_category <> '' AND f.corrected_category <> e.{column}"""


@query("feedback_events", _feedback_sql("routing_reason"))
def feedback_events(spark, d):
    return _machine(spark, d).feedback.drop("event_type", "timestamp")


@query("feedback_events_by_category", _feedback_sql("category"))
def feedback_events_by_category(spark, d):
    return _machine(spark, d, original="category").feedback.drop("event_type", "timestamp")


@query(
    "approval_lookup",
    f"""{ctes('approvals', 'reviews')} SELECT r.encounter_id, r.seq, a.status AS current_status FROM reviews r LEFT JOIN approvals a ON a.encounter_id = concat('1', r.encounter_id)""",
)
def approval_lookup(spark, d):
    """Decisions whose (shifted) encounter may have no entry."""
    reviews = load(spark, d, "reviews").withColumns({"original_id": F.col("encounter_id"), "encounter_id": F.concat(F.lit("1"), "encounter_id")})
    hits, misses = A.approval_lookup(reviews, load(spark, d, "approvals"))
    out = hits.unionByName(misses, allowMissingColumns=True)
    return out.select(F.col("original_id").alias("encounter_id"), "seq", "current_status")


def _reviewed(spark, d):
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    joined = load(spark, d, "approvals").join(shipped, F.col("order_key") == F.col("l_orderkey"), "left")
    return joined.withColumns(
        {"reviewed_at": F.when(F.col("shipped") > F.col("submitted_at"), F.col("shipped")), "sla_deadline": F.expr("submitted_at + INTERVAL 2 DAYS")}
    )


_reviewed_sql = f"""{ctes('approvals')}, shipped AS (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
reviewed AS (SELECT *, CASE WHEN shipped > submitted_at THEN shipped END AS reviewed_at, submitted_at + INTERVAL 2 DAYS AS sla_deadline FROM approvals LEFT JOIN shipped ON order_key = l_orderkey)"""


@query("approval_turnaround", f"{_reviewed_sql} SELECT triage_level, round(avg(epoch(reviewed_at) - epoch(submitted_at)), 3) AS avg_seconds, count(*) AS n_reviewed FROM reviewed WHERE reviewed_at IS NOT NULL GROUP BY 1")
def approval_turnaround(spark, d):
    return A.approval_turnaround(_reviewed(spark, d), ["triage_level"]).withColumn("avg_seconds", F.round("avg_seconds", 3))


@query("approval_sla_overdue", f"{_reviewed_sql} SELECT encounter_id, {sql_epoch('sla_deadline')} AS sla_deadline FROM reviewed WHERE status = 'pending' AND sla_deadline < TIMESTAMP '1998-01-01'")
def approval_sla_overdue(spark, d):
    approvals = load(spark, d, "approvals").withColumn("sla_deadline", F.expr("submitted_at + INTERVAL 2 DAYS"))
    return A.approval_sla_overdue(approvals, at("1998-01-01")).select("encounter_id", epoch("sla_deadline").alias("sla_deadline"))


@query("filter_status", f"{ctes('approvals')} SELECT encounter_id, status FROM approvals WHERE status = 'pending'")
def filter_status(spark, d):
    return screening.filter_status(load(spark, d, "approvals"), "pending").select("encounter_id", "status")


@query("status_counts", f"{ctes('approvals')} SELECT status, count(*) AS n FROM approvals GROUP BY 1")
def status_counts(spark, d):
    return B.status_counts(load(spark, d, "approvals"))


@query(
    "pending_feed",
    f"""{ctes('approvals')}, r AS (SELECT hospital_id, encounter_id, row_number() OVER (PARTITION BY hospital_id ORDER BY submitted_at DESC, encounter_id) AS rank FROM approvals WHERE status = 'pending')
SELECT hospital_id, encounter_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50""",
)
def pending_feed(spark, d):
    df = load(spark, d, "approvals").withColumns({"created_at": F.col("submitted_at"), "status": F.when(F.col("status") == "pending", "pending_review")})
    return B.pending_feed(df).select("hospital_id", "encounter_id", "rank")


@query(
    "reconcile",
    f"""{ctes('approvals', 'reviews')}, a AS (SELECT DISTINCT encounter_id FROM approvals WHERE status <> 'rejected'), b AS (SELECT DISTINCT encounter_id FROM reviews)
SELECT coalesce(a.encounter_id, b.encounter_id) AS encounter_id, CASE WHEN b.encounter_id IS NULL THEN 'audit' ELSE 'queue' END AS missing_in
FROM a FULL JOIN b ON a.encounter_id = b.encounter_id WHERE a.encounter_id IS NULL OR b.encounter_id IS NULL""",
)
def reconcile(spark, d):
    queue = load(spark, d, "approvals").filter("status <> 'rejected'")
    return K.reconcile(queue, load(spark, d, "reviews"), "encounter_id", ("queue", "audit"))


_store_rules = {"sessions": "seq % 7 <> 0", "queue": "seq % 5 <> 0", "audit": "seq % 3 <> 0"}
_store_level = {"sessions": "level", "queue": "CASE WHEN seq % 11 = 0 THEN 'Changed' ELSE level END", "audit": "level"}


@query(
    "reconcile_stores",
    f"""{ctes('session_log')}, s AS ({" UNION ALL ".join(f"SELECT DISTINCT '{n}' AS store, encounter_id, CAST(updated_at AS DATE) AS day, coalesce({_store_level[n]}, '') AS level FROM session_log WHERE {r}" for n, r in _store_rules.items())}),
g AS (SELECT encounter_id, day, concat_ws(',', {", ".join(f"CASE WHEN count(*) FILTER (store = '{n}') = 0 THEN '{n}' END" for n in _store_rules)}) AS missing_in, count(DISTINCT level) > 1 AS differs FROM s GROUP BY 1, 2)
SELECT encounter_id, CAST(day AS VARCHAR) AS day, missing_in, differs FROM g WHERE missing_in <> '' OR differs""",
)
def reconcile_stores(spark, d):
    """Sessions, queue and audit trail held against each other, per encounter and day."""
    log = load(spark, d, "session_log")
    stores = {n: log.filter(r).withColumn("level", F.expr(_store_level[n])) for n, r in _store_rules.items()}
    return K.reconcile_stores(stores, "encounter_id", "updated_at", ["level"]).withColumn("day", F.col("day").cast("string"))


@query(
    "approvals_by_day",
    f"{_reviewed_sql} SELECT CAST(CAST(submitted_at AS DATE) AS VARCHAR) AS day, count(DISTINCT encounter_id) AS n_encounters, count(reviewed_at) AS n_reviewed, round(avg(epoch(reviewed_at) - epoch(submitted_at)), 3) AS avg_seconds FROM reviewed GROUP BY 1",
)
def approvals_by_day(spark, d):
    out = A.approvals_by_day(_reviewed(spark, d))
    return out.withColumns({"day": F.col("day").cast("string"), "avg_seconds": F.round("avg_seconds", 3)})


_CUT = "2024-01-20"


@query(
    "change_feed",
    f"""{ctes('session_log')}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY updated_at DESC) AS rn FROM session_log) WHERE rn = 1 ORDER BY updated_at DESC, encounter_id LIMIT 50),
prev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY updated_at DESC) AS rn FROM session_log WHERE updated_at < TIMESTAMP '{_CUT}') WHERE rn = 1 ORDER BY updated_at DESC, encounter_id LIMIT 50)
SELECT CASE WHEN p.encounter_id IS NULL THEN 'new_triage' ELSE 'updated' END AS event, c.encounter_id, c.status, c.seq FROM cur c LEFT JOIN prev p USING (encounter_id) WHERE p.encounter_id IS NULL OR p.seq <> c.seq""",
)
def change_feed(spark, d):
    log = load(spark, d, "session_log")

    def newest(part):
        return B.latest_sessions(K.upsert_replace(part, ["encounter_id"], ["updated_at"]))

    before = log.filter(F.col("updated_at") < F.lit(_CUT).cast("timestamp_ntz"))
    return K.change_feed(newest(before), newest(log), "encounter_id").select("event", "encounter_id", "status", "seq")


# --- dashboards --------------------------------------------------------------

@query("analytics_cards", f"{_sessions} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (circuit_breaker_tripped) AS breaker_tripped FROM sessions")
def analytics_cards(spark, d):
    return B.analytics_cards(sessions(spark, d))


_family = "CASE WHEN contains(selected_model, 'opus') THEN 'Opus' WHEN contains(selected_model, 'sonnet') THEN 'Sonnet' WHEN contains(selected_model, 'haiku') THEN 'Haiku' ELSE selected_model END"


@query("model_distribution", f"{_sessions} SELECT {_family} AS family, count(*) AS n, min(seq) AS first_seq FROM sessions WHERE selected_model <> '' GROUP BY 1")
def model_distribution(spark, d):
    return B.model_distribution(sessions(spark, d))


@query("top_model", f"{_sessions} SELECT family || ' (' || n || ')' AS top_model FROM (SELECT {_family} AS family, count(*) AS n, min(seq) AS s FROM sessions WHERE selected_model <> '' GROUP BY 1 ORDER BY n DESC, s LIMIT 1)")
def top_model(spark, d):
    return B.top_model(sessions(spark, d))


@query("latest_sessions", f"{_sessions} SELECT encounter_id, status, seq FROM sessions ORDER BY updated_at DESC, encounter_id LIMIT 50")
def latest_sessions(spark, d):
    return B.latest_sessions(sessions(spark, d)).select("encounter_id", "status", "seq")


@query("sessions_by_updated", f"{_sessions} SELECT encounter_id, {sql_epoch('updated_at')} AS updated_at FROM sessions ORDER BY sessions.updated_at DESC, encounter_id")
def sessions_by_updated(spark, d):
    return B.sessions_by_updated(sessions(spark, d)).select("encounter_id", epoch("updated_at").alias("updated_at"))


@query(
    "queue_report",
    f"""{_sessions} SELECT encounter_id, patient_id, coalesce(level, '—') AS level,
  CASE level WHEN 'Emergency' THEN 'red' WHEN 'Urgent' THEN 'orange' WHEN 'Semi-Urgent' THEN 'yellow' WHEN 'Non-Urgent' THEN 'green' ELSE 'gray' END AS level_band,
  coalesce(printf('%.0f', confidence * 100) || '%', '—') AS confidence, CASE WHEN confidence >= 0.85 THEN 'green' WHEN confidence >= 0.70 THEN 'yellow' WHEN confidence IS NOT NULL THEN 'red' END AS confidence_band,
  coalesce({_family}, '') AS model, status, CASE status WHEN 'pending' THEN 'yellow' WHEN 'approved' THEN 'green' WHEN 'rejected' THEN 'red' END AS status_band,
  CASE WHEN circuit_breaker_tripped THEN 'CB Tripped' ELSE '' END AS flags, strftime(updated_at, '%b %-d, %I:%M %p') AS updated FROM sessions""",
)
def queue_report(spark, d):
    return R.queue_row(sessions(spark, d))


@query("audit_timeline", f"{ctes('steps')} SELECT encounter_id, seq, node FROM steps ORDER BY encounter_id, seq")
def audit_timeline(spark, d):
    return B.audit_timeline(load(spark, d, "steps").withColumn("ts", F.col("seq")), "node").select("encounter_id", "seq", "node")


@query(
    "session_detail",
    f"""{_sessions}, {ctes('steps')[5:]}, stored AS (SELECT s.encounter_id, s.status, a.node, a.seq, a.duration_ms, 'stored' AS origin FROM sessions s JOIN steps a USING (encounter_id))
SELECT * FROM stored UNION ALL SELECT encounter_id, status, 'extractor', 0, CAST(10 AS DOUBLE), 'embedded' FROM sessions WHERE encounter_id NOT IN (SELECT encounter_id FROM steps)""",
)
def session_detail(spark, d):
    step = F.struct(F.lit("extractor").alias("node"), F.lit(0).cast("bigint").alias("seq"), F.lit(0.0).alias("cost_usd"), F.lit(10.0).alias("duration_ms"))
    current = sessions(spark, d).select("encounter_id", "status", F.array(step).alias("audit_trail"))
    out = B.session_detail(current, load(spark, d, "steps"))
    return out.select("encounter_id", "status", "node", "seq", "duration_ms", "origin")


@query("first_match", f"{ctes('steps')} SELECT encounter_id, node, min(seq) AS first FROM steps GROUP BY 1, 2")
def first_match(spark, d):
    return B.first_match(load(spark, d, "steps"), F.col("seq"), ["seq"])


@query(
    "step_pivot",
    f"""{ctes('steps')} SELECT encounter_id, {", ".join(f"min(seq) FILTER (node = '{n}') AS {n}" for n in S.STEP_NODES)} FROM steps GROUP BY 1""",
)
def step_pivot(spark, d):
    out = B.step_pivot(load(spark, d, "steps"), ["seq", "duration_ms"], ["seq"])
    return out.select("encounter_id", *[F.col(f"{n}.seq").alias(n) for n in S.STEP_NODES])


@query(
    "reasoning_report",
    f"""{ctes('steps')}, f AS (SELECT encounter_id, arg_min(duration_ms, seq) AS d, arg_min(cost_usd, seq) AS c, arg_min(model, seq) AS selected_model FROM steps WHERE node = 'reasoner' GROUP BY 1)
SELECT encounter_id, CASE WHEN d < 1000 THEN printf('%.0f', d) || 'ms' ELSE printf('%.1f', d / 1000) || 's' END AS duration,
  '$' || CASE WHEN c < 0.01 THEN printf('%.5f', c) ELSE printf('%.4f', c) END AS cost, {_family} AS model FROM f""",
)
def reasoning_report(spark, d):
    steps = B.step_pivot(load(spark, d, "steps"), ["duration_ms", "cost_usd", "model"], ["seq"]).filter("reasoner IS NOT NULL")
    return B.reasoning_report(steps, "reasoner")


_j = "CASE WHEN json_valid({0}) THEN {0} END"


@query(
    "reasoning_chain",
    f"""{ctes('responses')}, p AS (SELECT *, {_j.format('extraction_json')} AS x, {_j.format('decision_json')} AS dj FROM responses)
SELECT encounter_id, coalesce(array_to_string(json_extract_string(x, '$.symptoms[*].description'), ', '), '') AS symptoms,
  CASE WHEN json_exists(x, '$.medications[0]') THEN 'warfarin 5mg, aspirin' ELSE 'None' END AS medications, coalesce(array_to_string(json_extract_string(CASE WHEN event_id % 7 = 0 THEN NULL ELSE dj END, '$.key_findings[*]'), ', '), '') AS key_findings FROM p""",
)
def reasoning_chain(spark, d):
    df = O.parse_extraction(load(spark, d, "responses"), "extraction_json")
    df = O.parse_decision(df, "decision_json", "model", "model")
    df = O.circuit_breaker(O.parse_sentinel(df, "check_json"), F.col("check_failed"))
    valid = F.when(F.col("event_id") % 7 != 0, F.col("decision.key_findings"))
    df = df.withColumn("decision", F.col("decision").withField("key_findings", valid))
    return B.reasoning_chain_text(df).select("encounter_id", "symptoms", "medications", "key_findings")


@query("category_label", f"{ctes('completed')} SELECT encounter_id, replace(category, '_', ' ') AS label FROM completed")
def category_label(spark, d):
    return load(spark, d, "completed").select("encounter_id", L.category_label(F.col("category")).alias("label"))


@query(
    "encounter_cost",
    f"{ctes('calls')} SELECT encounter_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost_usd), 6) AS cost_usd, round(sum(duration_ms), 4) AS duration_ms, count(*) AS n_calls FROM calls GROUP BY 1",
)
def encounter_cost(spark, d):
    out = B.encounter_cost(load(spark, d, "calls"))
    return out.withColumns({"cost_usd": F.round("cost_usd", 6), "duration_ms": F.round("duration_ms", 4)})


@query(
    "verify_replayed",
    f"{ctes('calls')} SELECT encounter_id, node AS node_name, {sql_epoch('ts')} AS created_at FROM calls WHERE encounter_id IN (SELECT concat('enc-', CAST(user_id AS STRING)) FROM events)",
)
def verify_replayed(spark, d):
    ids = table(spark, d, "events").selectExpr("concat('enc-', CAST(user_id AS STRING)) AS encounter_id")
    audit = load(spark, d, "calls").selectExpr("encounter_id", "node AS node_name", "ts AS created_at")
    return screening.verify_replayed(audit, ids).withColumn("created_at", epoch("created_at"))


@query("filter_recent", f"{ctes('calls')} SELECT event_id FROM calls WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 48 HOURS")
def filter_recent(spark, d):
    return screening.filter_recent(load(spark, d, "calls"), at("2024-01-20"), ts="ts").select("event_id")


@query("daily_events", f"{ctes('calls')} SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS events FROM calls WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 48 HOURS GROUP BY 1 ORDER BY 1")
def daily_events(spark, d):
    from caretide.operators.incidents import daily_events as daily

    recent = screening.filter_recent(load(spark, d, "calls"), at("2024-01-20"), ts="ts")
    return daily(recent, "ts").withColumn("day", F.col("day").cast("string"))
