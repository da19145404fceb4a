"""Sustained alerts over a stream of aligned points, with event-time timers instead of a point that says that it is over."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUN = "first long, last long, open boolean"
_Event = Row("series", "event", "at")


class AlertProcessor(StatefulProcessor):
    """The run of breaching periods of one series.

    A point waits in the state until the watermark has passed its period, so points count in order however they come.
    A breaching one also sets a timer for the end of the next period: if that has no point by then, the run is over.
    State: the run, and one flag per waiting period.
    """

    def __init__(self, seconds: int, duration: int) -> None:
        self._seconds, self._duration = seconds, duration

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._run = handle.getValueState("run", RUN)
        self._waiting = handle.getMapState("waiting", "start long", "breach boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            known = self._waiting.getValue((r.start,)) if self._waiting.containsKey((r.start,)) else (False,)
            self._waiting.updateValue((r.start,), (bool(r.breach) or known[0],))
            for periods in (1, 2) if r.breach else (1,):
                self._handle.registerTimer((r.start + periods * self._seconds) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        period = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self._seconds
        breach = False
        if self._waiting.containsKey((period,)):
            breach = self._waiting.getValue((period,))[0]
            self._waiting.removeKey((period,))
        first, last, is_open = self._run.get() or (None, None, False)
        if last is not None and last >= period:
            return
        goes_on = last is not None and last == period - self._seconds
        if last is not None and not (goes_on and breach):
            self._run.clear()
            if is_open:
                yield _Event(key[0], "closed", last + self._seconds)
        if not breach:
            return
        first, is_open = (first, is_open) if goes_on else (period, False)
        if not is_open and period - first >= self._duration - self._seconds:
            is_open = True
            yield _Event(key[0], "opened", period)
        self._run.update((first, period, is_open))

    def close(self) -> None:
        pass


def alert_stream(points: DataFrame, series: Column, breach: Column, seconds: int, duration: int, delay: str) -> DataFrame:
    """series, event (opened, closed) and at, as the batch form gives them, once the watermark has passed the period.

    ``points``: start (of an aligned period, epoch seconds) and what the columns read. A point is late if its period has
    ended more than ``delay`` before the newest one; late points are dropped. Several points of a period breach if one of
    them does. Needs the RocksDB state store.
    """
    timed = points.select(
        series.cast("string").alias("series"),
        "start",
        F.coalesce(breach, F.lit(False)).alias("breach"),
        F.timestamp_seconds(F.col("start") + F.lit(seconds)).alias("ended"),
    )
    keyed = timed.withWatermark("ended", delay).groupBy("series")
    return keyed.transformWithState(AlertProcessor(seconds, duration), "series string, event string, at long", "Append", "EventTime")
