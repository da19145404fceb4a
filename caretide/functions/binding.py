"""Evaluate an expression once and use it several times."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside AND/OR and CASE branches Spark evaluates a repeated sub-expression each time it is written.
    """
    return F.transform(F.array(value), body)[0]
