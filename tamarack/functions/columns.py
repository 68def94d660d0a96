"""Small helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


DAY_MS = 86_400_000


def wall_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp's own clock, whatever the session's time zone; for columns without one."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return (seconds * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000)).cast("long")


def utc_date(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(DAY_MS)).cast("int"))


def date_ms(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS


def once(x: Column) -> Column:
    """The value by way of a generator of one row: the optimizer moves no filter below it and copies it nowhere, so it is computed once."""
    return F.explode(F.array(x))
