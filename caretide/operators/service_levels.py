"""Metric alignment, alert conditions, error budgets, rate limits.

Raw points are first aggregated per (series, period), a partial aggregation; windows then run over at most
one row per series and period.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from caretide import settings as S
from caretide.operators.screening import is_2xx

MINUTE, HOUR, DAY = 60, 3_600, 86_400


def period_start(ts: str, seconds: int) -> Column:
    """Start of the aligned period, in epoch seconds."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(seconds)) * F.lit(seconds)


def align(df: DataFrame, series: list[str], ts: str, value: str, seconds: int, how: str) -> DataFrame:
    """One value per series and aligned period: ``how`` in min, mean, max, sum, count, rate, delta."""
    x = F.col(value)
    aligned = {
        "min": F.min(x), "mean": F.avg(x), "max": F.max(x), "sum": F.sum(x), "delta": F.sum(x),
        "count": F.count(x), "rate": F.sum(x) / F.lit(float(seconds)),
    }[how]
    return df.groupBy(*series, period_start(ts, seconds).alias("start")).agg(aligned.alias("value"))


def sustained(points: DataFrame, series: list[str], breach: Column, seconds: int, duration: int) -> DataFrame:
    """Adds ``firing``: the condition held in every aligned period of ``duration``; a gap breaks the run.

    A series is cut into spans of time, each preceded by a copy of what its windows look back at, so no task holds a whole
    history, with or without a series.
    """
    back = duration - seconds
    span = max(DAY, 16 * duration)
    own = F.floor(F.col("start") / span)
    reached = F.floor((F.col("start") + back) / span)
    spans = points.withColumn("__hit", F.coalesce(breach, F.lit(False))).withColumn("__span", F.explode(F.sequence(own, reached)))
    w = Window.partitionBy(*series, "__span").orderBy("start").rangeBetween(-back, 0)
    full = F.count("*").over(w) == duration // seconds
    fired = spans.withColumn("firing", full & F.min("__hit").over(w))
    return fired.filter(own == F.col("__span")).drop("__hit", "__span")


# --- percentiles -------------------------------------------------------------

def exact_percentile(df: DataFrame, keys: list[str], value: str, q: float, out: str, width: float) -> DataFrame:
    """Interpolated percentile per group without gathering a group; null keys are a group.

    The rows are read once and counted per distinct value, map-side first. A histogram of these counts in buckets
    ``width`` wide says where the wanted ranks lie; its entries join the values as rows of their own, so the values of a
    bucket are counted up beside what comes before it. Any width is exact, it only moves the work.
    """
    bucket = F.floor(F.col("__v") / F.lit(width))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c")).withColumn("__b", bucket)
    groups = Window.partitionBy(*keys)
    histogram = counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__n"))
    histogram = histogram.withColumns({"__upto": F.sum("__n").over(groups.orderBy("__b")), "__total": F.sum("__n").over(groups)})
    position = F.lit(q) * (F.col("__total") - 1)
    base = F.col("__upto") - F.col("__n")
    wanted = histogram.filter((base <= F.ceil(position)) & (F.col("__upto") > F.floor(position)))
    known = F.struct(base.alias("base"), F.floor(position).alias("lo"), F.ceil(position).alias("hi"), (position - F.floor(position)).alias("frac"))
    heads = wanted.select(*keys, "__b", F.lit(None).cast(counts.schema["__v"].dataType).alias("__v"), F.lit(0).cast("long").alias("__c"), known.alias("__known"))
    both = heads.unionByName(counts.withColumn("__known", F.lit(None).cast(heads.schema["__known"].dataType)))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.asc_nulls_first("__v"))  # the head of a bucket comes first
    ranked = both.withColumns({"__end": F.sum("__c").over(inside), "__known": F.first("__known").over(inside)})
    ranked = ranked.filter(F.col("__known").isNotNull() & F.col("__v").isNotNull())
    end = F.col("__known.base") + F.col("__end")
    start = end - F.col("__c")

    def at(rank: str) -> Column:
        return F.max(F.when((start <= F.col(f"__known.{rank}")) & (F.col(f"__known.{rank}") < end), F.col("__v")))

    picked = ranked.groupBy(*keys).agg(at("lo").alias("__vlo"), at("hi").alias("__vhi"), F.max("__known.frac").alias("__frac"))
    return picked.select(*keys, (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__frac")).alias(out))


def percentile_sketches(logs: DataFrame, series: list[str], value: str, seconds: int, k: int = 800) -> DataFrame:
    """A mergeable sketch of ``value`` per series and aligned period: ``start``, ``n``, ``sketch``. Works on a stream too,
    whose state is one sketch per open group; periods are joined later by ``merged_percentile``."""
    grouped = logs.filter(F.col(value).isNotNull()).groupBy(*series, F.window("ts", f"{seconds} seconds").alias("w"))
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch")
    return grouped.agg(F.count("*").alias("n"), sketch).select(*series, F.unix_seconds("w.start").alias("start"), "n", "sketch")


def merged_percentile(sketches: DataFrame, keys: list[str], q: float, out: str, k: int = 800) -> DataFrame:
    """Percentile per ``keys`` over several periods, from their sketches alone: one of the values, whose rank is off by
    about half a percent of ``n`` with the default ``k``."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(out))


def p99_latency(
    logs: DataFrame, series: list[str], seconds: int = MINUTE, exact: bool = True, bucket_ms: float = 100.0
) -> DataFrame:
    """p99 per series and period, then the largest across series: ``start``, ``p99_ms``."""
    points = logs.withColumn("start", period_start("ts", seconds))
    keys = [*series, "start"]
    if exact:
        per_series = exact_percentile(points, keys, "latency_ms", 0.99, "p99_ms", bucket_ms)
    else:
        per_series = points.groupBy(*keys).agg(F.approx_percentile("latency_ms", 0.99, 10_000).alias("p99_ms"))
    return per_series.groupBy("start").agg(F.max("p99_ms").alias("p99_ms"))


def p99_latency_alert(logs: DataFrame, series: list[str], seconds: int = MINUTE, duration: int = 300) -> DataFrame:
    points = p99_latency(logs, series, seconds)
    return sustained(points, [], F.col("p99_ms") > S.P99_LATENCY_MS, seconds, duration)


# --- error rates and budgets -------------------------------------------------

def request_rate_by_service(logs: DataFrame, seconds: int = MINUTE) -> DataFrame:
    """Requests and non-2xx requests per second, by service and period."""
    bad = ~is_2xx(F.col("response_class"))
    return logs.groupBy("service", period_start("ts", seconds).alias("start")).agg(
        (F.count("*") / F.lit(float(seconds))).alias("request_rate"),
        (F.count_if(bad) / F.lit(float(seconds))).alias("error_rate"),
    )


def error_rate(logs: DataFrame, seconds: int = MINUTE) -> DataFrame:
    """Percent of non-2xx requests per service and period; periods without errors give no row."""
    bad = ~is_2xx(F.col("response_class"))
    counted = logs.groupBy("service", period_start("ts", seconds).alias("start")).agg(
        F.count_if(bad).alias("errors"), F.count("*").alias("total")
    )
    return counted.filter("errors > 0").withColumn("error_percent", F.col("errors") / F.col("total") * 100)


def error_rate_alert(logs: DataFrame, seconds: int = MINUTE, duration: int = 120) -> DataFrame:
    return sustained(error_rate(logs, seconds), ["service"], F.col("error_percent") > S.ERROR_RATE_PERCENT, seconds, duration)


def good_total(logs: DataFrame, good: Column, seconds: int) -> DataFrame:
    return logs.groupBy("service", period_start("ts", seconds).alias("start")).agg(
        F.count_if(good).alias("good"), F.count("*").alias("total")
    )


def _rolling(column: str, seconds: int, span: int) -> Column:
    w = Window.partitionBy("service").orderBy("start").rangeBetween(-(span - seconds), 0)
    return F.sum(column).over(w)


def slo(logs: DataFrame, good: Column, goal: float, days: int = S.SLO_DAYS, seconds: int = HOUR) -> DataFrame:
    """Rolling good/total ratio per service at every aligned step, and whether the goal is met."""
    points = good_total(logs, good, seconds)
    ratio = _rolling("good", seconds, days * DAY) / _rolling("total", seconds, days * DAY)
    return points.select("service", "start", ratio.alias("sli")).withColumn("met", F.col("sli") >= goal)


def slo_availability(logs: DataFrame, seconds: int = HOUR) -> DataFrame:
    return slo(logs, is_2xx(F.col("response_class")), S.SLO_AVAILABILITY, seconds=seconds)


def slo_latency(logs: DataFrame, seconds: int = HOUR) -> DataFrame:
    return slo(logs, F.col("latency_ms") < S.SLO_LATENCY_MS, S.SLO_LATENCY, seconds=seconds)


def burn_rate(logs: DataFrame, good: Column, goal: float, seconds: int = MINUTE) -> DataFrame:
    """Fast and slow burn of the error budget at every step; both must exceed their limit to fire."""
    points = good_total(logs, good, seconds)

    def burn(minutes: int) -> Column:
        bad = 1 - _rolling("good", seconds, minutes * MINUTE) / _rolling("total", seconds, minutes * MINUTE)
        return bad / F.lit(1 - goal)

    (fast_min, fast), (slow_min, slow) = S.FAST_BURN, S.SLOW_BURN
    return points.select("service", "start", burn(fast_min).alias("fast_burn"), burn(slow_min).alias("slow_burn")).withColumn(
        "firing", (F.col("fast_burn") > fast) & (F.col("slow_burn") > slow)
    )


# --- model usage -------------------------------------------------------------

def llm_usage_points(calls: DataFrame) -> DataFrame:
    """Four metric points per model call, with their labels."""
    empty = F.lit(None).cast("string")

    def point(metric: str, node: Column, token_type: Column, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), node.alias("node"), token_type.alias("token_type"),
            value.cast("double").alias("value"),
        )

    node = F.col("node")
    points = F.array(
        point("token_count", node, F.lit("input"), F.col("tokens_in")),
        point("token_count", node, F.lit("output"), F.col("tokens_out")),
        point("cost_usd", empty, empty, F.col("cost_usd")),
        point("request_count", node, empty, F.lit(1)),
    )
    return calls.select("ts", "model", F.explode(points).alias("p")).select("ts", "model", "p.*")


def usage_by_period(points: DataFrame, metric: str, by: list[str], seconds: int) -> DataFrame:
    return align(points.filter(F.col("metric") == metric), by, "ts", "value", seconds, "sum")


def daily_cost_alert(points: DataFrame, threshold: float = S.DAILY_COST_USD["default"]) -> DataFrame:
    return usage_by_period(points, "cost_usd", [], DAY).filter(F.col("value") > threshold)


def log_metric(logs: DataFrame, pattern: str, seconds: int = 300) -> DataFrame:
    return (
        logs.filter(F.col("message").rlike(pattern))
        .groupBy(period_start("ts", seconds).alias("start"))
        .agg(F.count("*").alias("n"))
    )


def rate_limit_breaches(logs: DataFrame, limit: int, seconds: int = MINUTE, ban_seconds: int | None = None) -> DataFrame:
    """Clients over ``limit`` requests in a fixed window, and until when they are banned."""
    over = logs.groupBy("client", period_start("ts", seconds).alias("start")).agg(F.count("*").alias("requests"))
    over = over.filter(F.col("requests") > limit)
    return over if ban_seconds is None else over.withColumn("banned_until", F.col("start") + seconds + ban_seconds)
