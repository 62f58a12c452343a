"""Order, limits and pages. The only order is that of event ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evid import Evid, beyond

ORDER = ("ts_sec", "evid_offset")


def in_order(df: DataFrame, reverse: bool = False) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() if reverse else F.col(c).asc() for c in ORDER))


def page(df: DataFrame, limit: int, last: Evid | None = None, reverse: bool = False) -> DataFrame:
    """The next ``limit`` rows strictly beyond ``last``; sorting and cutting are one step, which keeps ``limit`` rows a task."""
    if last is not None:
        df = df.filter(beyond(last, reverse))
    return in_order(df, reverse).limit(limit)


def scrollback(df: DataFrame, lines: int = 1000) -> DataFrame:
    """The newest rows, oldest first."""
    return in_order(in_order(df, reverse=True).limit(lines))
