"""Registered queries with, where plain SQL can say it, the equivalent statement."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def bar(array: str | Column) -> Column:
    """Array as text, so that every engine returns the same cell."""
    return F.array_join(array, "|")


def epoch(ts: str | Column) -> Column:
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def sql_epoch(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


def sql_period(ts: str, seconds: int) -> str:
    return f"CAST(floor(epoch({ts}) / {seconds}) * {seconds} AS BIGINT)"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")
