"""Sweep lines, alert runs and bans along time, carried from day to day or from chunk to chunk, so that no series and no
client has to be in one task."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from caretide.operators.service_levels import DAY

# --- open intervals ----------------------------------------------------------


def open_per_period(intervals: DataFrame, start: str, end: str, seconds: int, until: Column, by: list[str] | None = None) -> DataFrame:
    """How many intervals [start, end) are open at some time in each aligned period, from the first open one to ``until``:
    ``by``, start (epoch seconds) and n; periods without any give no row.

    A sweep line: every interval adds one at its first period and takes it off behind its last one. The borders are added
    up per period, the sums of whole days are carried over a table with one row per day, and the periods of a day are swept
    by themselves. A null end or one after ``until`` is open to the end; an interval that ends before it starts is none.
    """
    by = by or []
    last = F.floor((F.unix_seconds(until.cast("timestamp")) - 1) / F.lit(seconds))
    at = F.unix_seconds(F.col(start).cast("timestamp"))
    stop = F.unix_seconds(F.col(end).cast("timestamp"))
    opened = F.floor(at / F.lit(seconds))
    closed = F.least(F.coalesce(F.floor((stop - 1) / F.lit(seconds)), last), last) + 1
    borders = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (stop > at)))
    borders = borders.select(*by, opened.alias("opened"), closed.alias("closed")).filter("opened < closed")
    steps = borders.select(*by, F.inline(F.array(F.struct(F.col("opened").alias("period"), F.lit(1).alias("step")), F.struct(F.col("closed").alias("period"), F.lit(-1).alias("step")))))
    periods = DAY // seconds
    per_period = steps.groupBy(*by, "period").agg(F.sum("step").alias("step")).withColumn("day", F.floor(F.col("period") / F.lit(periods)))
    per_day = per_period.groupBy(*by, "day").agg(F.sum("step").alias("step"))
    days = Window.partitionBy(*by).orderBy("day")
    carried = per_day.select(
        *by,
        "day",
        (F.sum("step").over(days) - F.col("step")).alias("before"),
        F.sum("step").over(days).alias("after"),
        F.lead("day").over(days).alias("next"),
    )
    # from one border to the next one of its day, and from the last one to the end of the day
    within = Window.partitionBy(*by, "day").orderBy("period")
    swept = per_period.join(carried.select(*by, "day", "before"), [*by, "day"])
    swept = swept.select(
        *by,
        F.col("period").alias("from"),
        (F.coalesce(F.lead("period").over(within), (F.col("day") + 1) * periods) - 1).alias("to"),
        (F.col("before") + F.sum("step").over(within)).alias("n"),
    )
    first = per_period.groupBy(*by, "day").agg(F.min("period").alias("period")).join(carried.select(*by, "day", "before"), [*by, "day"])
    head = first.select(*by, (F.col("day") * periods).alias("from"), (F.col("period") - 1).alias("to"), F.col("before").alias("n"))
    # days without a border keep what the day before left
    quiet = carried.filter((F.col("next") > F.col("day") + 1) & (F.col("after") > 0))
    quiet = quiet.select(*by, F.explode(F.sequence(F.col("day") + 1, F.col("next") - 1)).alias("day"), "after")
    quiet = quiet.select(*by, (F.col("day") * periods).alias("from"), ((F.col("day") + 1) * periods - 1).alias("to"), F.col("after").alias("n"))
    runs = swept.unionByName(head).unionByName(quiet).filter("n > 0 AND `from` <= `to`")
    return runs.select(*by, F.explode(F.sequence(F.col("from") * seconds, F.col("to") * seconds, F.lit(seconds).cast("long"))).alias("start"), "n")


def overdue_per_period(approvals: DataFrame, until: Column, seconds: int = 300) -> DataFrame:
    """Entries past their deadline and not yet reviewed, per period; the alert fires wherever there is a row."""
    return open_per_period(approvals, "sla_deadline", "reviewed_at", seconds, until).withColumnRenamed("n", "n_overdue")


# --- alerts ------------------------------------------------------------------


def breach_runs(points: DataFrame, series: list[str], breach: Column, seconds: int) -> DataFrame:
    """Runs of neighbouring periods that all breach: series, first and last (starts of periods).

    Runs are found within a day of a series first. Of these only the ones that touch a border of their day can go on,
    at most two a day; they are joined along the days. So no series, nor the lack of one, puts all points in one task.
    """
    hits = points.filter(F.coalesce(breach, F.lit(False))).select(*series, "start").distinct()
    day = F.floor(F.col("start") / F.lit(DAY))
    within = Window.partitionBy(*series, "day").orderBy("start")
    island = F.col("start") - F.row_number().over(within) * F.lit(seconds)
    runs = hits.withColumn("day", day).withColumn("island", island).groupBy(*series, "day", "island").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    border = (F.col("first") % DAY < seconds) | ((F.col("last") + seconds) % DAY < seconds)
    inner = runs.filter(~border).select(*series, "first", "last")
    along = Window.partitionBy(*series).orderBy("first")
    edge = runs.filter(border).withColumn("new", F.coalesce(F.lag("last").over(along) + seconds < F.col("first"), F.lit(True)).cast("int"))
    edge = edge.withColumn("run", F.sum("new").over(along)).groupBy(*series, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return inner.unionByName(edge.select(*series, "first", "last"))


def alert_events(points: DataFrame, series: list[str], breach: Column, seconds: int, duration: int, until: Column | None = None) -> DataFrame:
    """``opened`` when a condition has held in every period of ``duration``, ``closed`` with the first period that does
    not breach or has no point: series, event and at (start of that period). With ``until`` (epoch seconds), a run whose
    next period is not before it is still open."""
    runs = breach_runs(points, series, breach, seconds).filter(F.col("last") - F.col("first") >= duration - seconds)
    opened = F.struct(F.lit("opened").alias("event"), (F.col("first") + (duration - seconds)).alias("at"))
    closed = F.struct(F.lit("closed").alias("event"), (F.col("last") + seconds).alias("at"))
    events = runs.select(*series, F.inline(F.array(opened, closed)))
    return events if until is None else events.filter((F.col("event") == "opened") | (F.col("at") < until))


# --- bans at the edge --------------------------------------------------------

#: State of a client between two chunks of requests: refused until a time (in the past if there is no ban), or in a window
#: that was opened at a time and has taken a number of requests.
BANNED, COUNTING = 0, 1
NEVER = -(1 << 62)
State = tuple[int, int, int]
FRESH: State = (BANNED, NEVER, 0)
#: Clients with more requests than this are cut into chunks, and a chunk spans so many windows and bans: by then most
#: openings have fallen into line, so that the summary of a chunk is far smaller than the chunk.
SPREAD, SPANS = 200_000, 16


class _Windows:
    """For sorted times: what becomes of a window that opens at each of them."""

    def __init__(self, ts: np.ndarray, limit: int, interval: int, ban: int) -> None:
        n = len(ts)
        self.ts, self.limit, self.interval, self.ban = ts, limit, interval, ban
        inside = np.searchsorted(ts, ts + interval, "left") - np.arange(n)
        self.crossed = inside > limit
        self.until = np.where(self.crossed, ts[np.minimum(np.arange(n) + limit, n - 1)] + ban, ts + interval)
        self.following = np.searchsorted(ts, self.until, "left")

    def left_at(self, opening: int) -> State:
        """State behind the last request if no window opens after this one."""
        if self.crossed[opening]:
            return BANNED, int(self.until[opening]), 0
        return COUNTING, int(self.ts[opening]), len(self.ts) - opening

    def lasts(self) -> np.ndarray:
        """The last window that opens if one opens at each request: pointers are followed in doubled steps."""
        to = np.where(self.following < len(self.ts), self.following, np.arange(len(self.ts)))
        while True:
            after = to[to]
            if (after == to).all():
                return to
            to = after

    def entered(self, state: State) -> tuple[int, int, int, State | None]:
        """(refused from, refused to, first opening, state behind the last request if none opens)."""
        kind, time, count = state
        n, at = len(self.ts), 0
        if kind == COUNTING:
            over = int(np.searchsorted(self.ts, time + self.interval, "left"))
            if count + over <= self.limit:
                return 0, 0, over, (COUNTING, time, count + n) if over == n else None
            at = self.limit - count
            time = int(self.ts[at]) + self.ban
        free = max(at, int(np.searchsorted(self.ts, time, "left")))
        return at, free, free, (BANNED, time, 0) if free == n else None


def edge_summary(ts: np.ndarray, limit: int, interval: int, ban: int) -> dict:
    """What a chunk of sorted times does to any state: its first times, its last one and, by the time from which a window
    may open, the state behind it. Neighbouring openings that end alike are one step, as windows soon fall into line. A
    state from before the chunk frees its client within ``interval`` and ``ban``, so later openings are not listed."""
    windows = _Windows(ts, limit, interval, ban)
    last = windows.lasts()
    ends = np.append(np.flatnonzero(np.diff(last)), len(ts) - 1)
    ends = ends[: int(np.searchsorted(ts[ends], ts[0] + interval + ban, "left")) + 1]
    states = [windows.left_at(int(last[e])) for e in ends]
    return {
        "n": len(ts), "head": ts[:limit].tolist(), "most": int(ts[-1]),
        "upto": ts[ends].tolist(), "kind": [s[0] for s in states], "time": [s[1] for s in states], "count": [s[2] for s in states],
    }


def state_after(state: State, chunk: dict, limit: int, interval: int, ban: int) -> State:
    """The state behind a chunk that is entered with a state, from its summary alone."""
    kind, time, count = state
    if kind == COUNTING:
        at = limit - count
        if at < len(chunk["head"]) and chunk["head"][at] < time + interval:
            time = chunk["head"][at] + ban
        elif chunk["most"] < time + interval:
            return COUNTING, time, count + chunk["n"]
        else:
            time += interval
    if time > chunk["most"]:
        return BANNED, time, 0
    step = int(np.searchsorted(chunk["upto"], time, "left"))
    return chunk["kind"][step], chunk["time"][step], chunk["count"][step]


def _judged(ts: np.ndarray, limit: int, interval: int, ban: int, state: State) -> tuple[np.ndarray, State]:
    """For sorted times entered with a state, the end of the ban that refuses each of them, NEVER where it passes; and the
    state behind them."""
    out = np.full(len(ts), NEVER)
    windows = _Windows(ts, limit, interval, ban)
    start, stop, at, left = windows.entered(state)
    if stop > start:
        out[start:stop] = state[1] if state[0] == BANNED else ts[start] + ban
    if left is not None:
        return out, left
    following, crossed = windows.following.tolist(), windows.crossed.tolist()
    while at < len(ts):
        opening, at = at, following[at]
        if crossed[opening]:
            out[opening + limit : at] = windows.until[opening]
    return out, windows.left_at(opening)


def edge_verdicts(ts: np.ndarray, limit: int, interval: int, ban: int, state: State) -> np.ndarray:
    """For sorted times entered with a state, the end of the ban that refuses each of them; NEVER where it passes."""
    return _judged(ts, limit, interval, ban, state)[0]


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before it; nulls are alike."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    other = pc.fill_null(pc.not_equal(a, b), False)
    return np.asarray(pc.or_(other, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False), dtype=bool)


def _in_line(ts: np.ndarray, new: np.ndarray, apart: int) -> np.ndarray:
    """The times of many histories, one behind the other, on one axis: histories, and requests of one that are farther
    ``apart`` than any state lasts, stand just so far from each other. ``new`` marks the first request of a history."""
    steps = np.minimum(np.diff(ts), apart)
    steps[new[1:]] = apart
    return ts[0] + np.concatenate([[0], np.cumsum(steps)])


def edge_bans(
    requests: DataFrame, limit: int, interval: int, ban: int, client: str = "client", ts: str = "ts", order: str = "log_id", chunk_seconds: int | None = None, spread: int = SPREAD
) -> DataFrame:
    """Every request with ``allowed`` and, if refused, ``ban_start`` and ``ban_end`` (microseconds since the epoch).

    A client's window of ``interval`` seconds opens with the first request that no window or ban holds. The request beyond
    ``limit`` in it is refused and starts a ban of ``ban`` seconds; requests within the ban are refused and open nothing.
    Requests of one time count in the order of ``order``. Null client: one client; null time: allowed, never counted.

    Requests are judged in one sorted stream, an Arrow batch of any number of clients at a time; only the state at the end
    of a batch is kept. The history of a client with more than ``spread`` requests is cut into chunks of ``chunk_seconds``
    (by default some windows and bans long). Each is summed up as what it does to any state, the states are carried over
    one row per chunk, and each chunk is judged with the state that it is entered with. So a client with a third of all
    requests is spread out, and any chunk size gives the same result.
    """
    interval_us, ban_us = interval * 1_000_000, ban * 1_000_000
    apart = interval_us + ban_us + 1
    length = (chunk_seconds or SPANS * (interval + ban)) * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = requests.withColumns({"__at": at, "__client": F.col(client).cast("string")})
    known = timed.filter("__at IS NOT NULL")
    summary = "__client string, __chunk long, n long, head array<long>, most long, upto array<long>, kind array<int>, time array<long>, count array<long>"
    carried = "__client string, __chunk long, kind int, time long, count long"
    summed, passed_on = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (summary, carried))

    def sum_up(key: tuple, rows: pa.Table) -> pa.Table:
        times = np.sort(rows.column("__at").to_numpy())
        row = {"__client": key[0].as_py(), "__chunk": key[1].as_py()} | edge_summary(times, limit, interval_us, ban_us)
        return pa.Table.from_pylist([row], schema=summed)

    def carry(key: tuple, chunks: pa.Table) -> pa.Table:
        state, out = FRESH, []
        chunks = chunks.sort_by("__chunk")
        for i in range(len(chunks)):  # a row at a time: Python lists of one chunk only
            chunk = chunks.slice(i, 1).to_pylist()[0]
            out.append({"__client": chunk["__client"], "__chunk": chunk["__chunk"], "kind": state[0], "time": state[1], "count": state[2]})
            state = state_after(state, chunk, limit, interval_us, ban_us)
        return pa.Table.from_pylist(out, schema=passed_on)

    # of clients with many requests there are few
    busy = known.groupBy("__client").count().filter(F.col("count") > spread).select(F.col("__client").alias("__busy"), F.lit(True).alias("__cut"))
    met = known.join(F.broadcast(busy), F.col("__client").eqNullSafe(F.col("__busy")), "left")
    cut = met.filter("__cut").withColumn("__chunk", F.floor(F.col("__at") / F.lit(length)))
    chunks = cut.select("__client", "__chunk", "__at").groupBy("__client", "__chunk").applyInArrow(sum_up, summary)
    states = chunks.groupBy("__client").applyInArrow(carry, carried)
    keys = [f.name for f in requests.schema]
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", allowed boolean, ban_start long, ban_end long"

    same = cut["__client"].eqNullSafe(states["__client"]) & (cut["__chunk"] == states["__chunk"])
    columns = [*keys, "__client", "__chunk", "__at", "kind", "time", "count"]
    entered = cut.join(states, same).select(*[cut[k] for k in keys], cut["__client"], cut["__chunk"], "__at", "kind", "time", "count")
    whole = met.filter("__cut IS NULL").withColumns({"__chunk": F.lit(0).cast("long"), "kind": F.lit(FRESH[0]), "time": F.lit(FRESH[1]), "count": F.lit(FRESH[2]).cast("long")})
    # rows of one chunk meet in one task, in order
    lined_up = whole.select(*columns).unionByName(entered).repartition("__client", "__chunk")
    lined_up = lined_up.sortWithinPartitions("__client", "__chunk", "__at", F.asc_nulls_last(order))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, FRESH
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            here, chunk = batch.column("__client"), batch.column("__chunk")
            new = np.concatenate([[before != (here[0].as_py(), chunk[0].as_py())], _differs(here) | _differs(chunk)])
            times = batch.column("__at").to_numpy()
            kind, time, count = (batch.column(c).to_numpy() for c in ("kind", "time", "count"))
            # a chunk with a state of its own starts anew; all that begin without one stand in line
            starts = np.union1d([0], np.flatnonzero(new & ((kind != FRESH[0]) | (time != FRESH[1])))).astype(int)
            ends = np.full(n, NEVER)
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                if new[low]:
                    state = int(kind[low]), int(time[low]), int(count[low])
                line = _in_line(times[low:high], new[low:high], apart)
                found, (of, until, taken) = _judged(line, limit, interval_us, ban_us, state)
                moved = times[low:high] - line
                ends[low:high] = np.where(found == NEVER, NEVER, found + moved)
                state = of, until + int(moved[-1]) if until != NEVER else NEVER, taken
            before = here[n - 1].as_py(), chunk[n - 1].as_py()
            passed = ends == NEVER
            verdict = [pa.array(passed), pa.array(ends - ban_us, pa.int64(), mask=passed), pa.array(ends, pa.int64(), mask=passed)]
            yield pa.record_batch([batch.column(k) for k in keys] + verdict, names=[*keys, "allowed", "ban_start", "ban_end"])

    judged = lined_up.mapInArrow(judge, result)
    untimed = timed.filter("__at IS NULL").select(*keys, F.lit(True).alias("allowed"), F.lit(None).cast("long").alias("ban_start"), F.lit(None).cast("long").alias("ban_end"))
    return judged.unionByName(untimed)
