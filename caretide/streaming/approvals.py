"""The approval status machine as a keyed streaming operator."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "encounter_id string, ts timestamp, seq long, outcome string, status string, reviewer_id string, "
    "corrected_category string, original_category string, classifier_confidence double"
)
#: Entries of one bucket, a place in each list for each encounter.
STATE = "encounter array<string>, status array<string>, original array<string>, confidence array<double>"
OPEN, DECISION = 0, 1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that encounters are hashed into. A state store is asked twice a bucket and batch instead of twice an encounter.
BUCKETS = 4_096

_JUDGED = "encounter_id string, at long, seq long, outcome string, status string, reviewer_id string, corrected_category string, original_category string, classifier_confidence double"
_JUDGED_NAMES = [c.split(" ")[0] for c in _JUDGED.split(", ")]


def _nullable(values: pd.Series, null: pd.Series | None = None) -> list:
    return [None if n else v for v, n in zip(values.tolist(), (values.isna() if null is None else null).tolist(), strict=True)]


class ApprovalProcessor(StatefulProcessor):
    """New events of the encounters of one bucket, in (ts, kind, seq) order, against their stored status."""

    def __init__(self, idempotent: bool) -> None:
        self._idempotent = idempotent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._entries = handle.getValueState("entries", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self._entries.get()
        entries = {} if stored is None else {e: (s, o, c) for e, s, o, c in zip(*stored, strict=True)}
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.sort_values(["has_at", "at", "kind", "has_seq", "seq"], kind="stable", ignore_index=True)
        out, changed = [], False
        events = zip(
            _nullable(frame["encounter_id"]), _nullable(frame["at"], ~frame["has_at"]), _nullable(frame["seq"], ~frame["has_seq"]), frame["kind"].tolist(),
            *(_nullable(frame[c]) for c in ("original", "confidence", "status", "reviewer_id", "corrected_category")), strict=True,
        )
        for encounter, at, seq, kind, first, sure, decided, reviewer, corrected in events:
            status, original, confidence = entries.get(encounter, (None, None, None))
            if kind == OPEN:
                if status is None or not self._idempotent:
                    entries[encounter], changed = ("pending_approval", first, sure), True
                continue
            outcome = "not_found" if status is None else "accepted" if status == "pending_approval" else "conflict"
            if outcome == "accepted":
                entries[encounter], changed = (decided, original, confidence), True
            out.append((encounter, at, seq, outcome, decided, reviewer, corrected, original, confidence))
        if changed:
            self._entries.update((list(entries), *(list(c) for c in zip(*entries.values(), strict=True))))
        if out:
            columns = zip(_JUDGED_NAMES, zip(*out, strict=True), strict=True)
            yield pd.DataFrame({c: pd.Series(v, dtype="float64" if c == "classifier_confidence" else object) for c, v in columns})

    def close(self) -> None:
        pass


def approval_stream(events: DataFrame, idempotent: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``events``: encounter_id, ts, seq, kind (0 completed, 1 decision), original, confidence, status,
    reviewer_id, corrected_category. Emits every decision with its outcome. Repeats and conflicts are told apart without
    any race because an encounter is in one bucket, which owns its state.

    Encounters are hashed into ``buckets``; the entries of a bucket are one value of the state store, read once and written
    once a batch, and a bucket's events are judged in one pass. A batch that touches few encounters so writes the buckets
    they are in. The number of buckets is fixed for the life of a checkpoint. Null times and numbers come first.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    bucket = F.pmod(F.xxhash64("encounter_id"), F.lit(buckets)).cast("int")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    plain = events.select(
        bucket.alias("bucket"), "encounter_id", F.coalesce(at, F.lit(0)).alias("at"), at.isNotNull().alias("has_at"),
        F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.col("seq").isNotNull().alias("has_seq"), "kind",
        "original", F.col("confidence").cast("double").alias("confidence"), "status", "reviewer_id", "corrected_category",
    )
    judged = plain.groupBy("bucket").transformWithStateInPandas(ApprovalProcessor(idempotent), _JUDGED, "Append", "None")
    return judged.select("encounter_id", F.timestamp_micros("at").alias("ts"), *_JUDGED_NAMES[2:])


def union_events(completed: DataFrame, decisions: DataFrame, original: str = "routing_reason") -> DataFrame:
    """Both topics as the one event frame ``approval_stream`` reads."""
    opened = completed.selectExpr(
        "encounter_id", "ts", "seq", f"{OPEN} as kind", f"{original} as original", "confidence",
        "cast(null as string) as status", "cast(null as string) as reviewer_id", "cast(null as string) as corrected_category",
    )
    made = decisions.selectExpr(
        "encounter_id", "ts", "seq", f"{DECISION} as kind", "cast(null as string) as original",
        "cast(null as double) as confidence", "status", "reviewer_id", "corrected_category",
    )
    return opened.unionByName(made)
