"""Dates: months, cyclic features, formatting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    return F.trunc(day.cast("date"), "month")


def month_sin(day: Column) -> Column:
    return F.sin(2 * math.pi * F.month(day) / 12)


def month_cos(day: Column) -> Column:
    return F.cos(2 * math.pi * F.month(day) / 12)


def between(day: Column, start, end) -> Column:
    """Both ends included."""
    return (day >= F.lit(start)) & (day <= F.lit(end))


def year_month(millis: Column) -> Column:
    """``yyyy-MM`` of milliseconds since 1970, also before it."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM")
