"""Column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
# Fixed value: the average Gregorian month (365.2425 / 12 days) in seconds,
# the unit of month-based durations.
SECONDS_PER_AVG_MONTH = 2_629_746
# Fixed value: Earth radius in km used by the haversine distance.
EARTH_RADIUS_KM = 6371


def micros_between(start: Column, end: Column) -> Column:
    """Exact (end - start) in microseconds; independent of the session time
    zone for zone-less timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start: Column, end: Column) -> Column:
    """(end - start) in fractional days; NULL if either side is NULL."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def avg_months_between(start: Column, end: Column) -> Column:
    """(end - start) in average months (not calendar months)."""
    return micros_between(start, end) / F.lit(float(SECONDS_PER_AVG_MONTH * 1_000_000))


def micros_sums(x: Column, name: str, weight: Column | None = None) -> list[Column]:
    """Exact sum of a microsecond column (each row ``weight`` times) as two
    bigint sums: whole seconds (``{name}_s``) and leftover microseconds
    (``{name}_us``).

    Integer sums are exact and order-independent, so partial aggregates can
    be combined in any grouping. The value is split before it is weighted: a
    month's seconds times any count of reviews stays far below 2^63, where
    its microseconds would not. They stay on the fast bigint path (a
    decimal(38,0) sum costs about 2.5x more per row).
    """
    us = F.pmod(x, F.lit(1_000_000))
    s = F.call_function("div", x - us, F.lit(1_000_000).cast("bigint"))
    w = F.lit(1) if weight is None else weight
    return [F.sum(s * w).alias(f"{name}_s"), F.sum(us * w).alias(f"{name}_us")]


def resum(name: str) -> list[Column]:
    """Sum partial ``micros_sums`` columns again (next aggregation level)."""
    return [F.sum(f"{name}_s").alias(f"{name}_s"), F.sum(f"{name}_us").alias(f"{name}_us")]


def mean_days(name: str, n: Column) -> Column:
    """Mean duration in days over ``n`` rows from ``micros_sums`` columns:
    the exact total, converted to double once, divided once."""
    total = F.col(f"{name}_s").cast("decimal(38,0)") * F.lit(1_000_000) + F.col(f"{name}_us")
    return F.try_divide(total.cast("double"), n * F.lit(float(MICROS_PER_DAY)))


def active_months(first: Column, last: Column) -> Column:
    """Started average months of activity: 1 for a single date, NULL if none."""
    return F.floor(avg_months_between(first, last) + 1).cast("double")


def late_micros(start: Column, end: Column) -> Column:
    """Microseconds by which ``end`` is after ``start``; 0 when early, on
    time or unknown."""
    d = micros_between(start, end)
    return F.when(d > 0, d).otherwise(F.lit(0))


def late_days(start: Column, end: Column) -> Column:
    """Days by which ``end`` is after ``start``; 0 when early, on time or unknown."""
    return late_micros(start, end) / F.lit(float(MICROS_PER_DAY))


def late_days_keep_null(start: Column, end: Column) -> Column:
    """Like ``late_days`` but an unknown date stays NULL (superseded rule)."""
    d = days_between(start, end)
    return F.when(d < 0, F.lit(0.0)).otherwise(d)


def score_flag(score: Column, value: int) -> Column:
    """1 when ``score == value``, else 0 (a NULL score gives 0)."""
    return F.coalesce(score == value, F.lit(False)).cast("int")


def review_cost(score: Column, low_base: float, mid_cost: float) -> Column:
    """Cost of one review: base/score for 1 and 2 stars, a flat cost for 3.

    Scores outside 1..5 (and NULL) cost nothing; see ``bad_scores`` in the
    review operators for the data-quality count of such rows.
    """
    return (
        F.when(score.isin(1, 2), F.lit(float(low_base)) / score)
        .when(score == 3, F.lit(float(mid_cost)))
        .otherwise(F.lit(0.0))
    )


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km; arguments in degrees, longitude first."""
    lo1, la1, lo2, la2 = (F.radians(c) for c in (lon1, lat1, lon2, lat2))
    s_lat = F.sin((la2 - la1) / 2)
    s_lon = F.sin((lo2 - lo1) / 2)
    a = s_lat * s_lat + F.cos(la1) * F.cos(la2) * s_lon * s_lon
    # asin(x > 1) is NaN; rounding can push a a hair above 1 for antipodes.
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def round_half_even(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals with ties to even (numpy's rule)."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def sqrt2pi() -> Column:
    return F.lit(math.sqrt(2 * math.pi))
