"""Zone-free integer time. Table timestamps carry no zone, so they are never cast through one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of a zone-less timestamp, as BIGINT."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def epoch_minute(ts: str | Column) -> Column:
    """Whole minutes since 1970-01-01."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 1440 + F.hour(c) * 60 + F.minute(c)


def floor_div(value: str | Column, width: int) -> Column:
    """Floor division of an integer column, as BIGINT."""
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c / F.lit(width)).cast("long")
