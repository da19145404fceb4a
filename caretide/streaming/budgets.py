"""Error budgets over a stream of requests: burn rates of rolling windows, corrected where requests come late."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caretide import settings as S
from caretide.operators.service_levels import MINUTE

COUNTS = "service string, start long, good long, total long"
_Burn = Row("service", "start", "fast_burn", "slow_burn", "firing")


def counted(logs: DataFrame, good: Column, seconds: int) -> DataFrame:
    """Requests added up per service and period within each Arrow batch, so that a busy service sends rows by periods and
    not by requests. Null services and times give no row."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["service", "start"]).aggregate([("good", "sum"), ("good", "count")])
            for part in sums.select(["service", "start", "good_sum", "good_count"]).rename_columns(["service", "start", "good", "total"]).to_batches():
                yield part.set_column(2, "good", pc.cast(part["good"], pa.int64()))

    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(seconds)) * F.lit(seconds)
    narrow = logs.select(F.col("service").cast("string").alias("service"), start.cast("long").alias("start"), F.coalesce(good, F.lit(False)).cast("long").alias("good"))
    return narrow.filter("service IS NOT NULL AND start IS NOT NULL").mapInArrow(add_up, COUNTS)


def _burn(starts: np.ndarray, good: np.ndarray, total: np.ndarray, at: np.ndarray, seconds: int, span: int, goal: float) -> np.ndarray:
    """Burn of the window of ``span`` seconds that ends with each of the periods ``at`` (places in the sorted ``starts``)."""
    first = np.searchsorted(starts, starts[at] - (span - seconds))
    g, t = np.append(0, np.cumsum(good)), np.append(0, np.cumsum(total))
    return (1 - (g[at + 1] - g[first]) / (t[at + 1] - t[first])) / (1 - goal)


class BudgetProcessor(StatefulProcessor):
    """Counts of the periods of one service that a window may still need.

    A batch adds to the buckets of its periods, in place for late requests, and gives a new row for every known period
    whose window holds one of them. A bucket is dropped by a timer, when no period that can still change reaches back to it.
    """

    def __init__(self, seconds: int, goal: float) -> None:
        self._seconds, self._goal = seconds, goal
        self._spans = (S.FAST_BURN[0] * MINUTE, S.SLOW_BURN[0] * MINUTE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buckets = handle.getMapState("buckets", "start long", "good long, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ring = {k[0]: (v[0], v[1]) for k, v in self._buckets.iterator()}
        touched = set()
        for r in rows:
            good, total = ring.get(r.start, (0, 0))
            if not total:
                self._handle.registerTimer((r.start + self._spans[1] + self._seconds) * 1000)
            ring[r.start] = (good + r.good, total + r.total)
            touched.add(r.start)
        for start in touched:
            self._buckets.updateValue((start,), ring[start])
        starts = np.array(sorted(ring), np.int64)
        good, total = (np.array([ring[s][i] for s in starts.tolist()], np.int64) for i in (0, 1))
        changed = np.array(sorted(touched), np.int64)
        # a period changes if one of its window's periods did: the last changed one up to it lies within the window
        last = np.searchsorted(changed, starts, "right") - 1
        at = np.flatnonzero((last >= 0) & (starts - changed[np.maximum(last, 0)] < self._spans[1]))
        fast, slow = (_burn(starts, good, total, at, self._seconds, span, self._goal) for span in self._spans)
        firing = (fast > S.FAST_BURN[1]) & (slow > S.SLOW_BURN[1])
        for row in zip(starts[at].tolist(), fast.tolist(), slow.tolist(), firing.tolist(), strict=True):
            yield _Burn(key[0], *row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self._spans[1] - self._seconds
        if self._buckets.containsKey((start,)):
            self._buckets.removeKey((start,))
        return iter([])

    def close(self) -> None:
        pass


def burn_rate_stream(logs: DataFrame, good: Column, goal: float, delay: str, seconds: int = MINUTE) -> DataFrame:
    """service, start, fast_burn, slow_burn and firing, as the batch form gives them for all requests that came. Run in
    update mode: the newest row of a (service, start) counts.

    ``logs``: service, ts and what ``good`` reads. A request is late if its period ended more than ``delay`` before the
    newest one; late ones are dropped. State per service: the periods of the slow window and of the delay. Needs the
    RocksDB state store.
    """
    periods = counted(logs, good, seconds).withColumn("ended", F.timestamp_seconds(F.col("start") + F.lit(seconds)))
    keyed = periods.withWatermark("ended", delay).groupBy("service")
    schema = "service string, start long, fast_burn double, slow_burn double, firing boolean"
    return keyed.transformWithState(BudgetProcessor(seconds, goal), schema, "Update", "EventTime")
