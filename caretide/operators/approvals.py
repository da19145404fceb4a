"""Approval queue: a status machine over triage-completed events and reviewer decisions."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caretide.functions import decisions as D


@dataclass
class ApprovalResult:
    verdicts: DataFrame   # every decision: accepted / conflict (409) / not_found (404)
    queue: DataFrame      # final entry per encounter
    approved: DataFrame   # triage-approved events
    feedback: DataFrame   # classifier feedback events
    entries: DataFrame    # final entry per encounter with all that its events bring along, and what opened and closed it
    sessions: DataFrame   # what the last decision of each encounter writes to its session
    closed: DataFrame     # what opened and closed each round; all but the verdicts are made of it


ENTRY = ["routing_reason", "category", "confidence"]
DECISION = ["status", "reviewer_id", "corrected_category"]
#: Further columns of completed events and decisions; they are carried where they are given.
PAYLOAD = ["patient_id", "triage_result", "sentinel_check", "audit_ref"]
NOTES = "notes"
#: Events that one task sorts, and rounds of an encounter that meet in one task.
TASK_EVENTS, SPAN = 200_000, 1_024
#: Events that one task may sort where more partitions would have the tasks before the shuffle sort theirs, and the setting
#: (with its default) that says from how many on they do.
MOST_EVENTS, UNSORTED = 1_500_000, ("spark.shuffle.sort.bypassMergeThreshold", "200")


def tasks_for(*events: DataFrame) -> int | None:
    """Partitions for so many events, if one task could not take them all; one job counts the events.

    The session's own number is not left to do even where it is larger: the adaptive planner merges its partitions up to a
    number of compressed bytes, which may be millions of events. Beyond a number of partitions a task that writes a shuffle
    holds all that it read in order to sort it, many times what a task then reads of it; up to ``MOST_EVENTS`` in a task that
    number is not passed.
    """
    return tasks_of(sum(e.count() for e in events), events[0].sparkSession)


def tasks_of(n: int, spark: SparkSession) -> int | None:
    """``tasks_for`` where the number of events is known."""
    unsorted = int(spark.conf.get(*UNSORTED))
    wanted = min(-(-n // TASK_EVENTS), max(unsorted, -(-n // MOST_EVENTS)))
    return wanted if wanted > 1 else None


def _dealt(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    return df.repartition(partitions, *keys) if partitions else df


def rounds(events: DataFrame, chunk_seconds: int = 3_600, partitions: int | None = None) -> DataFrame:
    """Adds ``round`` (completed events so far) and ``accepted`` (first decision of its round).

    An encounter's history is cut into time chunks and only the rows of one (encounter, chunk) are sorted together,
    so an encounter that owns a third of all events is spread out. What a chunk needs from the ones before it, the
    number of rounds opened and whether the current round is already decided, is carried over a table
    with one row per chunk. Any chunk size is exact. ``partitions`` (see ``tasks_for``) keeps what a task sorts from growing
    with the events.
    """
    chunk = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(chunk_seconds))
    inside = Window.partitionBy("encounter_id", "chunk").orderBy("ts", "kind", "seq")
    is_open, previous = F.col("kind") == 0, F.coalesce(F.lag("kind").over(inside), F.lit(0))
    local = _dealt(events.withColumn("chunk", chunk), partitions, "encounter_id", "chunk").withColumns(
        {
            "in_round": F.sum(F.when(is_open, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "leads": ~is_open & (previous == 0),
        }
    )

    # one sorted pass, as the rows lie in this order already
    last = F.max(F.struct("in_round", (~is_open).alias("decided"))).alias("last")
    per_chunk = local.groupBy("encounter_id", "chunk").agg(last).select("encounter_id", "chunk", "last.*")
    # a chunk that opens no round holds decisions alone, so after any chunk a round is decided if it is so within that chunk
    history = Window.partitionBy("encounter_id").orderBy("chunk")
    upto = history.rowsBetween(Window.unboundedPreceding, 0)
    carried = _dealt(per_chunk, partitions, "encounter_id").select(
        "encounter_id",
        "chunk",
        (F.sum("in_round").over(upto) - F.col("in_round")).alias("rounds_before"),
        F.coalesce(F.lag("decided").over(history), F.lit(False)).alias("decided_before"),
    )
    numbered = local.join(carried, ["encounter_id", "chunk"]).withColumn("round", F.col("rounds_before") + F.col("in_round"))
    fresh = (F.col("in_round") > 0) | ~F.col("decided_before")
    accepted = F.col("leads") & (F.col("round") > 0) & fresh
    return numbered.withColumn("accepted", accepted).drop("chunk", "in_round", "leads", "rounds_before", "decided_before")


def approval_state_machine(
    completed: DataFrame,
    decisions: DataFrame,
    idempotent: bool = False,
    original: str = "routing_reason",
    chunk_seconds: int = 3_600,
) -> ApprovalResult:
    """Replay both event streams.

    ``completed``: encounter_id, ts, seq, routing_reason, category, confidence and any of PAYLOAD. ``decisions``:
    encounter_id, ts, seq, status, reviewer_id, corrected_category and perhaps notes. A completed event opens a round
    in ``pending_approval``; only the first decision of a round counts. A repeated completed event opens a new round,
    unless ``idempotent``. ``original`` names the completed column a correction is compared with.
    """
    partitions = tasks_for(completed, decisions)
    if idempotent:
        completed = first_completed(completed)
    return replay(rounds(approval_events(completed, decisions), chunk_seconds, partitions), original, partitions)


def _given(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def first_completed(completed: DataFrame) -> DataFrame:
    columns = ["ts", "seq", *ENTRY, *_given(completed, PAYLOAD)]
    first = completed.groupBy("encounter_id").agg(F.min_by(F.struct(*columns), F.struct("ts", "seq")).alias("c"))
    return first.select("encounter_id", "c.*")


def approval_events(completed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Both topics as one frame: kind 0 opens a round, kind 1 is a decision."""
    opened = completed.select("encounter_id", "ts", "seq", F.lit(0).alias("kind"), *ENTRY, *_given(completed, PAYLOAD))
    made = decisions.select("encounter_id", "ts", "seq", F.lit(1).alias("kind"), *DECISION, *_given(decisions, [NOTES]))
    return opened.unionByName(made, allowMissingColumns=True)


def _newest(df: DataFrame, value: Column, partitions: int | None, name: str) -> DataFrame:
    """The value of the last round of each encounter; with ``partitions``, of each span of rounds first."""
    if partitions:
        df = df.groupBy("encounter_id", "span").agg(F.max_by(value, "round").alias(name), F.max("round").alias("round"))
        df, value = df.repartition(partitions, "encounter_id"), F.col(name)
    return df.groupBy("encounter_id").agg(F.max_by(value, "round").alias(name))


def replay(history: DataFrame, original: str = "routing_reason", partitions: int | None = None, persist: bool = False) -> ApprovalResult:
    """What follows from the ``rounds`` of events. Rows with ``carried`` stand for an entry that was there before: they
    come before all others of their encounter, happened ``at`` some time, and make no verdict or event again. With ``persist``
    the rounds are kept until the caller releases ``closed``."""
    columns = history.columns
    entry, decision = ENTRY + _given(history, PAYLOAD), DECISION + _given(history, [NOTES])
    at = F.col("at") if "at" in columns else F.col("ts")
    carried = F.col("carried") if "carried" in columns else F.lit(False)
    outcome = F.when(F.col("round") == 0, "not_found").when(F.col("accepted"), "accepted").otherwise("conflict")
    made = history.filter("kind = 1" if "carried" not in columns else "kind = 1 AND NOT carried")
    verdicts = made.select("encounter_id", "ts", "seq", *DECISION, "round", outcome.alias("outcome"))

    # one row per round: what opened it and, if any, the decision that closed it
    opener = F.max_by(F.struct(at.alias("ts"), *entry), F.when(F.col("kind") == 0, 1)).alias("e")
    closer = F.max_by(F.struct(at.alias("ts"), carried.alias("carried"), *decision), F.when(F.col("accepted"), 1)).alias("d")
    # of each round that is one row or two, so dealing them out by spans of rounds leaves no busy task
    told = history.filter("kind = 0 OR accepted").withColumn("span", F.floor(F.col("round") / F.lit(SPAN)))
    closed = _dealt(told, partitions, "encounter_id", "span").groupBy("encounter_id", *(["span"] if partitions else []), "round").agg(opener, closer)
    if persist:
        closed = closed.persist()
    latest = _newest(closed, F.struct("e", "d"), partitions, "l")
    corrected = F.nullif("l.d.corrected_category", F.lit(""))
    status, updated = F.coalesce("l.d.status", F.lit("pending_approval")), F.coalesce("l.d.ts", "l.e.ts")
    queue = latest.select(
        "encounter_id",
        status.alias("status"),
        F.col("l.e.ts").alias("created_at"),
        updated.alias("updated_at"),
        F.col("l.d.reviewer_id").alias("reviewer_id"),
        corrected.alias("corrected_category"),
    )
    notes = [F.col(f"l.d.{NOTES}").alias("reviewer_notes")] if NOTES in columns else []
    entries = latest.select(
        "encounter_id",
        status.alias("status"),
        F.col("l.e.ts").alias("created_at"),
        updated.alias("updated_at"),
        *[F.col(f"l.e.{c}").alias(c) for c in entry],
        F.col("l.d.reviewer_id").alias("reviewer_id"),
        corrected.alias("corrected_category"),
        F.col("l.d.ts").alias("reviewed_at"),
        *notes,
    )
    decided = closed.filter("d IS NOT NULL AND NOT d.carried").select(
        "encounter_id", *(["span"] if partitions else []), "round", F.col("d.ts").alias("decided_at"), *[f"e.{c}" for c in ENTRY], *[f"d.{c}" for c in decision]
    )
    approved = decided.filter("status = 'approved'").select("encounter_id", "reviewer_id", F.col("decided_at").alias("approved_at"))
    feedback = decided.filter(D.is_misroute(F.col(original), F.col("corrected_category"))).select(
        F.lit("classifier_feedback").alias("event_type"),
        "encounter_id",
        F.col(original).alias("original_category"),
        "corrected_category",
        F.col("confidence").alias("classifier_confidence"),
        "reviewer_id",
        F.col("decided_at").alias("timestamp"),
    )
    last = _newest(decided, F.struct("decided_at", *decision), partitions, "d")
    sessions = last.select(
        "encounter_id",
        "d.status",
        F.col("d.reviewer_id").alias("reviewed_by"),
        *([F.col(f"d.{NOTES}").alias("reviewer_notes")] if NOTES in columns else []),
        F.col("d.decided_at").alias("reviewed_at"),
        F.col("d.decided_at").alias("updated_at"),
    )
    return ApprovalResult(verdicts, queue, approved, feedback, entries, sessions, closed)


def approval_lookup(decisions: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with the status of their entry, decisions without an entry)."""
    entries = queue.select("encounter_id", F.col("status").alias("current_status"), F.lit(True).alias("__met"))
    looked_up = decisions.join(entries, "encounter_id", "left")
    met = F.col("__met").isNotNull()
    return looked_up.filter(met).drop("__met"), looked_up.filter(~met).drop("__met", "current_status")


def approval_sla_overdue(approvals: DataFrame, as_of: Column) -> DataFrame:
    return approvals.filter((F.col("status") == "pending") & (F.col("sla_deadline") < as_of))


def approval_turnaround(approvals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean seconds from submission to review."""
    done = approvals.filter(F.col("reviewed_at").isNotNull())
    seconds = F.unix_timestamp("reviewed_at") - F.unix_timestamp("submitted_at")
    return done.groupBy(*(by or [])).agg(F.avg(seconds).alias("avg_seconds"), F.count("*").alias("n_reviewed"))


def approvals_by_day(approvals: DataFrame) -> DataFrame:
    """Per day of submission: encounters (each once), entries reviewed so far and their mean seconds to review."""
    seconds = F.unix_timestamp("reviewed_at") - F.unix_timestamp("submitted_at")
    return approvals.groupBy(F.to_date("submitted_at").alias("day")).agg(
        F.count_distinct("encounter_id").alias("n_encounters"), F.count("reviewed_at").alias("n_reviewed"), F.avg(seconds).alias("avg_seconds")
    )


def misroute_matrix(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("original_category", "corrected_category").agg(
        F.count("*").alias("n"), F.avg("classifier_confidence").alias("avg_confidence")
    )
