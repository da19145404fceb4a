"""Decimal text for doubles, rounded on the exact binary value."""

from pyspark.sql import Column, functions as F


def fixed(value: Column, digits: int, ties: str = "even") -> Column:
    """Text of ``value`` with ``digits`` decimals.

    ``format_string('%.2f')`` rounds the shortest decimal form half up; reports need rounding of
    the binary value itself, with exact ties going to the even digit (``ties='even'``) or away
    from zero (``ties='up'``). The double is split at 2**-26 so that both scaled parts are exact.
    """
    scale = 10**digits
    x = F.abs(value)
    high = F.floor(x * F.lit(float(2**26))) / F.lit(float(2**26))
    low = x - high
    whole = F.floor(x * F.lit(float(scale))).cast("bigint")
    excess = (high * scale - (whole + F.lit(0.5))) + low * scale
    up = F.when(excess > 0, 1).when(excess < 0, 0).otherwise(F.lit(1) if ties == "up" else whole % 2)
    units = (whole + up).cast("bigint")
    sign = F.when(value < 0, "-").otherwise("")
    if digits == 0:
        return F.concat(sign, units.cast("string"))
    fraction = F.lpad((units % scale).cast("string"), digits, "0")
    return F.concat(sign, F.floor(units / F.lit(scale)).cast("string"), F.lit("."), fraction)
