"""Periods of time, at whole seconds, in UTC."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import times

SECOND = dt.timedelta(seconds=1)
EPOCH = dt.datetime(1970, 1, 1)


def utcnow() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)


@dataclass(frozen=True)
class Period:
    """From start to end; None is open. Both ends belong to it unless exclusive: an included end means all of its second."""

    start: dt.datetime | None
    end: dt.datetime | None
    start_exclusive: bool = False
    end_exclusive: bool = False

    @classmethod
    def last_hour(cls, now: dt.datetime | None = None) -> Period:
        now = now or utcnow()
        return cls(now - dt.timedelta(hours=1), now)

    def bounds(self) -> tuple[dt.datetime | None, dt.datetime | None]:
        """Half-open: the first moment that belongs to the period and the first one after it."""
        lo, hi = self.start, self.end
        if lo is not None and self.start_exclusive:
            lo += SECOND
        if hi is not None and not self.end_exclusive:
            hi += SECOND
        return lo, hi

    def contains_second(self, ts: int) -> bool:
        lo, hi = self.bounds()
        at = EPOCH + dt.timedelta(seconds=ts)
        return (lo is None or at >= lo) and (hi is None or at < hi)

    def condition(self, ts: Column, kind: str) -> Column:
        """On the raw column, so that it is pushed down and prunes row groups and partitions."""
        lo, hi = self.bounds()
        out = F.lit(True)
        if lo is not None:
            out = ts >= times.literal(lo, kind)
        if hi is not None:
            below = ts < times.literal(hi, kind)
            out = below if lo is None else out & below
        return out
