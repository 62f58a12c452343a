"""Times: seconds of a timestamp column, bounds that reach the scan, expansion and formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(c: Column, kind: str) -> Column:
    """Whole seconds since 1970 of a timestamp or timestamp_ntz column (the latter is UTC), whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_seconds(c)
    days = F.date_diff(c.cast("date"), F.expr("DATE '1970-01-01'")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def literal(when: dt.datetime, kind: str) -> Column:
    """A naive UTC datetime as a literal of the column's type, so that comparisons are pushed down to the scan."""
    if kind == "timestamp":
        return F.expr(f"TIMESTAMP '{when:%Y-%m-%d %H:%M:%S} UTC'")
    return F.expr(f"TIMESTAMP_NTZ '{when:%Y-%m-%d %H:%M:%S}'")


def expand(c: Column, prefix: str = "dt_") -> dict[str, Column]:
    """Parts of a timestamp; weekday counts from Monday 0, yearday from 1."""
    parts = {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "weekday": F.weekday(c), "yearday": F.dayofyear(c)}
    return {prefix + k: v for k, v in parts.items()}


def rfc2822(c: Column) -> Column:
    """timestamp of ``[Tue, ]10 Oct 2000 13:55[:36] -0700``; null where it isn't one."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\s*\([^)]*\)$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r" (GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))


def syslog_date(c: Column, year: int) -> Column:
    """timestamp_ntz of ``Oct  1 13:55:36`` in a given year; null where it isn't one."""
    packed = F.concat(F.lit(f"{year} "), F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.try_to_timestamp(packed, F.lit("yyyy MMM d HH:mm:ss"))


def display(c: Column, kind: str, zone: str = "UTC") -> Column:
    """``05 Jan 2024 10:00:00 UTC`` in the named zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz") if kind == "timestamp_ntz" else F.to_timestamp_ntz(F.to_utc_timestamp(c, F.expr("current_timezone()"))))
    return F.concat(F.date_format(local, "dd MMM yyyy HH:mm:ss"), F.lit(f" {zone}"))
