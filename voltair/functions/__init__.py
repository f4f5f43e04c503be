"""Column functions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of the MAD scale, the smallest argument of the guarded logarithm.
MAD_QUANTILE = 0.6745
LOG_FLOOR = 1e-304


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp without zone (session time zone: UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def guarded_log(x: Column) -> Column:
    return F.when(x > LOG_FLOOR, F.ln(x)).otherwise(F.lit(-math.inf))


def popcount(x: Column) -> Column:
    """Bits that are set."""
    return F.bit_count(x)


def numeric_suffix(name: Column) -> Column:
    """The number a name ends with; null without one."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)$", 1), F.lit("")).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of equal bins on [low, high]; the last bin is closed."""
    width = (high - low) / bins
    return F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((x - low) / width), F.lit(bins - 1))).cast("long")


def split_state(joint: Column, base: int, rings: int) -> list[Column]:
    """States of each ring from a mixed-radix joint number."""
    return [F.pmod(F.floor(joint / base**k), F.lit(base)).cast("long") for k in range(rings)]


def chi2_tail(stat: float, df: float) -> float:
    """P(X > stat) for a chi-square variable: regularised upper incomplete gamma by series or continued fraction."""
    a, x = df / 2, stat / 2
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - lead * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return lead * h
