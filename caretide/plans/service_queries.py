"""Alert, budget, usage and rate-limit queries over request and call logs.

The given event log is sparse (one row every few minutes), so alert runs are evaluated on hourly periods.
"""

from pyspark.sql import functions as F

from caretide import settings as S
from caretide.operators import intervals as N, screening, service_levels as L
from caretide.plans.inputs import ctes, load
from caretide.plans.registry import at, query, sql_period
from caretide.sources.tables import table

HOUR, DAY = L.HOUR, L.DAY


def _requests(spark, d):
    return load(spark, d, "requests")


@query("non_2xx", f"{ctes('requests')} SELECT service, count(*) FILTER (response_class <> '2xx') AS failed, count(*) FILTER (response_class = '2xx') AS good FROM requests GROUP BY 1")
def non_2xx(spark, d):
    ok = screening.is_2xx(F.col("response_class"))
    return _requests(spark, d).groupBy("service").agg(F.count_if(~ok).alias("failed"), F.count_if(ok).alias("good"))


def sustained_sql(source: str, series: str, breach: str, seconds: int, duration: int, columns: str) -> str:
    part = f"PARTITION BY {series} " if series else ""
    w = f"OVER ({part}ORDER BY start RANGE BETWEEN {duration - seconds} PRECEDING AND CURRENT ROW)"
    return f"SELECT {columns}, start, count(*) {w} = {duration // seconds} AND bool_and(coalesce({breach}, false)) {w} AS firing FROM {source}"


_rates = f"""{ctes('requests')}, rates AS (SELECT service, {sql_period('ts', HOUR)} AS start, count(*) FILTER (response_class <> '2xx') AS errors, count(*) AS total FROM requests GROUP BY 1, 2 HAVING errors > 0)"""


@query("error_rate", f"{_rates} SELECT service, start, errors, total, round(CAST(errors AS DOUBLE) / total * 100, 6) AS error_percent FROM rates")
def error_rate(spark, d):
    return L.error_rate(_requests(spark, d), HOUR).withColumn("error_percent", F.round("error_percent", 6))


@query("error_rate_alert", f"{_rates} {sustained_sql('rates', 'service', 'CAST(errors AS DOUBLE) / total * 100 > 5', HOUR, 2 * HOUR, 'service, errors')}")
def error_rate_alert(spark, d):
    return L.error_rate_alert(_requests(spark, d), HOUR, 2 * HOUR).select("service", "errors", "start", "firing")


@query(
    "request_rate_by_service",
    f"{ctes('requests')} SELECT service, {sql_period('ts', 60)} AS start, round(count(*) / 60.0, 6) AS request_rate, round(count(*) FILTER (response_class <> '2xx') / 60.0, 6) AS error_rate FROM requests GROUP BY 1, 2",
)
def request_rate_by_service(spark, d):
    return L.request_rate_by_service(_requests(spark, d)).withColumns({c: F.round(c, 6) for c in ("request_rate", "error_rate")})


_p99 = f"""{ctes('requests')}, per AS (SELECT service, revision, {sql_period('ts', DAY)} AS start, quantile_cont(latency_ms, 0.99) AS p FROM requests GROUP BY 1, 2, 3),
p99 AS (SELECT start, max(p) AS p99_ms FROM per GROUP BY 1)"""


@query("p99_latency", f"{_p99} SELECT start, round(p99_ms, 6) AS p99_ms FROM p99")
def p99_latency(spark, d):
    return L.p99_latency(_requests(spark, d), ["service", "revision"], seconds=DAY).withColumn("p99_ms", F.round("p99_ms", 6))


@query("p99_latency_alert", f"{_p99} {sustained_sql('p99', '', 'p99_ms > 5000', DAY, 3 * DAY, 'round(p99_ms, 6) AS p99_ms')}")
def p99_latency_alert(spark, d):
    out = L.p99_latency_alert(_requests(spark, d), ["service", "revision"], DAY, 3 * DAY)
    return out.withColumn("p99_ms", F.round("p99_ms", 6))


@query(
    "p99_latency_by_minute",
    f"""{ctes('requests')}, per AS (SELECT service, revision, {sql_period('ts', 60)} AS start, quantile_cont(latency_ms, 0.99) AS p FROM requests GROUP BY 1, 2, 3)
SELECT start, round(max(p), 6) AS p99_ms FROM per GROUP BY 1""",
)
def p99_latency_by_minute(spark, d):
    return L.p99_latency(_requests(spark, d), ["service", "revision"]).withColumn("p99_ms", F.round("p99_ms", 6))


_points = {
    "subscription": "CASE user_id % 3 WHEN 0 THEN 'triage-completed-dlq-sub' WHEN 1 THEN 'audit-events-dlq-sub' ELSE 'triage-approved-dlq-sub' END",
    "ts": "ts",
    "depth": "CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 9 END",
    "connections": "(event_id % 4)",
    "cpu": "0.5 + CAST(event_id % 50 AS DOUBLE) / 100.0",
}
_points_sql = "WITH points AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _points.items()) + " FROM events)"


def metric_points(spark, d):
    return table(spark, d, "events").selectExpr(*[f"{e} AS {c}" for c, e in _points.items()])


def _aligned(value: str, how: str, seconds: int = HOUR) -> str:
    return f"{_points_sql}, a AS (SELECT subscription, {sql_period('ts', seconds)} AS start, {how}({value}) AS value FROM points GROUP BY 1, 2)"


@query("dlq_depth", f"{_aligned('depth', 'max')} {sustained_sql('a', 'subscription', 'value > 0', HOUR, 5 * HOUR, 'subscription, value')}")
def dlq_depth(spark, d):
    aligned = L.align(metric_points(spark, d), ["subscription"], "ts", "depth", HOUR, "max")
    return L.sustained(aligned, ["subscription"], F.col("value") > 0, HOUR, 5 * HOUR)


@query("db_connections", f"{_aligned('connections', 'min')} {sustained_sql('a', 'subscription', 'value < 1', HOUR, HOUR, 'subscription, value')}")
def db_connections(spark, d):
    aligned = L.align(metric_points(spark, d), ["subscription"], "ts", "connections", HOUR, "min")
    return L.sustained(aligned, ["subscription"], F.col("value") < 1, HOUR, HOUR)


@query("db_cpu", f"{_aligned('cpu', 'avg')}, b AS (SELECT subscription, start, round(value, 6) AS value FROM a) {sustained_sql('b', 'subscription', 'value > 0.8', HOUR, 2 * HOUR, 'subscription, value')}")
def db_cpu(spark, d):
    aligned = L.align(metric_points(spark, d), ["subscription"], "ts", "cpu", HOUR, "mean").withColumn("value", F.round("value", 6))
    return L.sustained(aligned, ["subscription"], F.col("value") > 0.8, HOUR, 2 * HOUR)


@query("sustained", f"{_aligned('depth', 'sum')} {sustained_sql('a', 'subscription', 'value > 10', HOUR, 3 * HOUR, 'subscription, CAST(value AS BIGINT) AS value')}")
def sustained(spark, d):
    aligned = L.align(metric_points(spark, d), ["subscription"], "ts", "depth", HOUR, "sum")
    return L.sustained(aligned, ["subscription"], F.col("value") > 10, HOUR, 3 * HOUR)


def _rolled(good: str, seconds: int) -> str:
    return f"""{ctes('requests')}, g AS (SELECT service, {sql_period('ts', seconds)} AS start, count(*) FILTER ({good}) AS good, count(*) AS total FROM requests GROUP BY 1, 2)"""


def _ratio(span: int, seconds: int) -> str:
    w = f"OVER (PARTITION BY service ORDER BY start RANGE BETWEEN {span - seconds} PRECEDING AND CURRENT ROW)"
    return f"CAST(sum(good) {w} AS DOUBLE) / sum(total) {w}"


@query("slo_availability", f"""{_rolled("response_class = '2xx'", HOUR)} SELECT service, start, round({_ratio(30 * DAY, HOUR)}, 9) AS sli, {_ratio(30 * DAY, HOUR)} >= 0.995 AS met FROM g""")
def slo_availability(spark, d):
    return L.slo_availability(_requests(spark, d)).withColumn("sli", F.round("sli", 9))


@query("slo_latency", f"{_rolled('latency_ms < 3000', HOUR)} SELECT service, start, round({_ratio(30 * DAY, HOUR)}, 9) AS sli, {_ratio(30 * DAY, HOUR)} >= 0.95 AS met FROM g")
def slo_latency(spark, d):
    return L.slo_latency(_requests(spark, d)).withColumn("sli", F.round("sli", 9))


def burn_sql(good: str, goal: float) -> str:
    fast, slow = (f"(1 - {_ratio(m * 60, 60)}) / CAST({1 - goal!r} AS DOUBLE)" for m in (60, 360))
    return f"{_rolled(good, 60)}, b AS (SELECT service, start, {fast} AS f, {slow} AS s FROM g) SELECT service, start, round(f, 6) AS fast_burn, round(s, 6) AS slow_burn, f > 14.4 AND s > 6 AS firing FROM b"


@query("burn_rate", burn_sql("response_class = '2xx'", S.SLO_AVAILABILITY))
def burn_rate(spark, d):
    out = L.burn_rate(_requests(spark, d), screening.is_2xx(F.col("response_class")), S.SLO_AVAILABILITY)
    return out.withColumns({c: F.round(c, 6) for c in ("fast_burn", "slow_burn")})


@query("burn_rate_latency", burn_sql("latency_ms < 3000", S.SLO_LATENCY))
def burn_rate_latency(spark, d):
    out = L.burn_rate(_requests(spark, d), F.col("latency_ms") < S.SLO_LATENCY_MS, S.SLO_LATENCY)
    return out.withColumns({c: F.round(c, 6) for c in ("fast_burn", "slow_burn")})


# --- model usage -------------------------------------------------------------

def _usage(spark, d):
    return L.llm_usage_points(load(spark, d, "calls"))


@query(
    "llm_usage_points",
    f"""{ctes('calls')} SELECT model, 'token_count' AS metric, node, 'input' AS token_type, CAST(tokens_in AS DOUBLE) AS value FROM calls
UNION ALL SELECT model, 'token_count', node, 'output', CAST(tokens_out AS DOUBLE) FROM calls
UNION ALL SELECT model, 'cost_usd', NULL, NULL, cost_usd FROM calls UNION ALL SELECT model, 'request_count', node, NULL, 1.0 FROM calls""",
)
def llm_usage_points(spark, d):
    return _usage(spark, d).drop("ts")


@query("tokens_hourly_by_model", f"{ctes('calls')} SELECT model, {sql_period('ts', HOUR)} AS start, CAST(sum(tokens_in + tokens_out) AS DOUBLE) AS value FROM calls GROUP BY 1, 2")
def tokens_hourly_by_model(spark, d):
    return L.usage_by_period(_usage(spark, d), "token_count", ["model"], HOUR)


@query("requests_hourly_by_model", f"{ctes('calls')} SELECT model, {sql_period('ts', HOUR)} AS start, CAST(count(*) AS DOUBLE) AS value FROM calls GROUP BY 1, 2")
def requests_hourly_by_model(spark, d):
    return L.usage_by_period(_usage(spark, d), "request_count", ["model"], HOUR)


_daily = f"{ctes('calls')}, c AS (SELECT {sql_period('ts', DAY)} AS start, sum(cost_usd) AS v FROM calls GROUP BY 1)"


@query("cost_daily", f"{_daily} SELECT start, round(v, 6) AS value FROM c")
def cost_daily(spark, d):
    return L.usage_by_period(_usage(spark, d), "cost_usd", [], DAY).withColumn("value", F.round("value", 6))


@query("daily_cost_alert", f"{_daily} SELECT start, round(v, 6) AS value FROM c WHERE v > 50")
def daily_cost_alert(spark, d):
    return L.daily_cost_alert(_usage(spark, d)).withColumn("value", F.round("value", 6))


@query("log_metric", f"{ctes('requests')} SELECT {sql_period('ts', 300)} AS start, count(*) AS n FROM requests WHERE regexp_matches(message, '{S.OVERDUE_LOG_PATTERN}') GROUP BY 1")
def log_metric(spark, d):
    return L.log_metric(_requests(spark, d), S.OVERDUE_LOG_PATTERN)


@query("rate_limit_breaches", f"{ctes('requests')} SELECT client, {sql_period('ts', HOUR)} AS start, count(*) AS requests, {sql_period('min(ts)', HOUR)} + 3660 AS banned_until FROM requests GROUP BY 1, 2 HAVING count(*) > 2")
def rate_limit_breaches(spark, d):
    return L.rate_limit_breaches(_requests(spark, d), 2, HOUR, S.EDGE_BAN_SECONDS)


# --- along time --------------------------------------------------------------

_UNTIL = "1995-06-01"
_deadlines = {
    "sla_deadline": "submitted_at + make_interval(0, 0, 0, 2, 0, 0, order_key % 86400)",
    "reviewed_at": "CASE WHEN order_key % 9 <> 0 THEN submitted_at + make_interval(0, 0, 0, 2 + order_key % 11, 0, 0, customer % 86400) END",
}
_overdue_sql = f"""{ctes('approvals')}, o AS (SELECT epoch(submitted_at) + 172800 + order_key % 86400 AS s,
  CASE WHEN order_key % 9 <> 0 THEN epoch(submitted_at) + 86400 * (2 + order_key % 11) + customer % 86400 END AS e, epoch(TIMESTAMP '{_UNTIL}') AS u FROM approvals),
i AS (SELECT CAST(floor(s / 300) AS BIGINT) AS a, CAST(floor((least(coalesce(e, u), u) - 1) / 300) AS BIGINT) AS b FROM o WHERE s < u AND (e IS NULL OR e > s))
SELECT p * 300 AS start, count(*) AS n_overdue FROM (SELECT unnest(range(a, b + 1)) AS p FROM i) GROUP BY 1"""


@query("overdue_per_period", _overdue_sql)
def overdue_per_period(spark, d):
    """Overdue entries in every period of 300 s, as of a day; the last ninth is never reviewed."""
    approvals = load(spark, d, "approvals").withColumns({c: F.expr(e) for c, e in _deadlines.items()})
    return N.overdue_per_period(approvals, at(_UNTIL))


def alert_sql(series: str) -> str:
    """``series``: empty, or a column and a comma."""
    part, grouped = (f"PARTITION BY {series.rstrip(', ')}", series) if series else ("", "")
    return f"""{_points_sql}, a AS (SELECT {series}{sql_period('ts', HOUR)} AS start, sum(depth) AS value FROM points GROUP BY ALL),
r AS (SELECT {series}start, start - {HOUR} * row_number() OVER ({part} ORDER BY start) AS g FROM a WHERE value > 10),
x AS (SELECT {series}min(start) AS first, max(start) AS last FROM r GROUP BY {grouped}g HAVING count(*) >= 3)
SELECT {series}'opened' AS event, first + {2 * HOUR} AS at FROM x UNION ALL SELECT {series}'closed', last + {HOUR} FROM x"""


@query("alert_events", alert_sql("subscription, "))
def alert_events(spark, d):
    """When alerts open and close: a condition held for three hours, in each subscription."""
    aligned = L.align(metric_points(spark, d), ["subscription"], "ts", "depth", HOUR, "sum")
    return N.alert_events(aligned, ["subscription"], F.col("value") > 10, HOUR, 3 * HOUR)


@query("alert_events_overall", alert_sql(""))
def alert_events_overall(spark, d):
    """The same without a series: runs are carried over the days."""
    aligned = L.align(metric_points(spark, d), [], "ts", "depth", HOUR, "sum")
    return N.alert_events(aligned, [], F.col("value") > 10, HOUR, 3 * HOUR)


_LIMIT, _INTERVAL, _BAN = 3, 3_600, 5_400
_edge_client = "CASE WHEN log_id % 3 = 0 THEN 'hot' ELSE client END"
_edge_sql = f"""WITH RECURSIVE {ctes('requests').removeprefix('WITH ')}, q AS (SELECT log_id, {_edge_client} AS client, epoch_us(ts) AS t FROM requests),
n AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, log_id) AS rn FROM q),
w AS (SELECT log_id, client, t, rn, t AS opened, 1 AS used, CAST(NULL AS BIGINT) AS banned, false AS refused FROM n WHERE rn = 1
  UNION ALL SELECT n.log_id, n.client, n.t, n.rn,
    CASE WHEN w.banned IS NOT NULL AND n.t < w.banned THEN w.opened WHEN w.banned IS NOT NULL OR n.t >= w.opened + {_INTERVAL * 10**6} THEN n.t ELSE w.opened END,
    CASE WHEN w.banned IS NOT NULL AND n.t < w.banned THEN w.used WHEN w.banned IS NOT NULL OR n.t >= w.opened + {_INTERVAL * 10**6} THEN 1 ELSE w.used + 1 END,
    CASE WHEN w.banned IS NOT NULL AND n.t < w.banned THEN w.banned WHEN w.banned IS NOT NULL OR n.t >= w.opened + {_INTERVAL * 10**6} THEN NULL WHEN w.used + 1 > {_LIMIT} THEN n.t + {_BAN * 10**6} END,
    (w.banned IS NOT NULL AND n.t < w.banned) OR (w.banned IS NULL AND n.t < w.opened + {_INTERVAL * 10**6} AND w.used + 1 > {_LIMIT})
  FROM w JOIN n ON n.client = w.client AND n.rn = w.rn + 1)
SELECT log_id, client, NOT refused AS allowed, CASE WHEN refused THEN banned - {_BAN * 10**6} END AS ban_start, CASE WHEN refused THEN banned END AS ban_end FROM w"""


@query("edge_bans", _edge_sql)
def edge_bans(spark, d):
    """Requests at the edge, allowed or refused; a third of them is one client's."""
    requests = _requests(spark, d).withColumn("client", F.expr(_edge_client)).select("log_id", "client", "ts")
    return N.edge_bans(requests, _LIMIT, _INTERVAL, _BAN).drop("ts")
