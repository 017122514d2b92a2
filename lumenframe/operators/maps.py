"""Choices of layout, and times, as expressions: how large tiles are, when things happened."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_shape(apertures: int, components: int, populations: int, wavelengths: int, budget_bytes: int = 1 << 30, value_bytes: int = 4, most: int = 128) -> tuple[int, int, int]:
    """Apertures, components and populations of a tile that stays within a budget: all populations if they fit, one component, as many apertures as then fit."""
    if min(apertures, components, populations, wavelengths) < 1:
        raise ValueError("every axis needs a length")
    row = wavelengths * value_bytes
    p = min(populations, max(1, budget_bytes // row))
    s = min(apertures, most, max(1, budget_bytes // (row * p)))
    c = min(components, max(1, budget_bytes // (row * p * s))) if s == min(apertures, most) and p == populations else 1
    return s, c, p


def power_of_two_below(n: int) -> int:
    return 1 << int(math.log2(n)) if n >= 1 else 0


def stamped(df: DataFrame, ts: str = "ts", name: str = "stamp") -> DataFrame:
    """An event's time as text, in UTC if the session is: for names and reports."""
    return df.withColumn(name, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def seconds_between(later: str, earlier: str) -> Column:
    """Seconds from one time to another, with their fractions."""
    return F.col(later).cast("double") - F.col(earlier).cast("double")


def events_by_hour(events: DataFrame, by: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Per group and hour: events and the mean of their values."""
    hour = F.date_format(F.date_trunc("hour", F.col(ts).cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return events.groupBy(by, hour.alias("hour")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def with_default(column: str, default: float, low: float | None = None, high: float | None = None) -> Column:
    """A setting as a number: the default where it is missing or no number, drawn into its bounds."""
    value = F.coalesce(F.expr(f"try_cast({column} AS double)"), F.lit(float(default)))
    value = F.when(F.isnan(value), F.lit(float(default))).otherwise(value)
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    return F.least(value, F.lit(float(high))) if high is not None else value
