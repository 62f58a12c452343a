"""Event ids: (seconds, offset) pairs, ordered lexicographically and printed as ``seconds:offset``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_MAX, OFFSET_MAX = 2**32 - 1, 2**64 - 1


@dataclass(frozen=True, order=True)
class Evid:
    ts: int
    offset: int

    def __post_init__(self):
        if not (0 <= self.ts <= TS_MAX and 0 <= self.offset <= OFFSET_MAX):
            raise ValueError(f"event id out of range: {self.ts}:{self.offset}")

    def __str__(self) -> str:
        return f"{self.ts}:{self.offset}"

    def __add__(self, n: int) -> Evid:
        """The id ``n`` further on; offsets carry over into seconds. Past either end it is an error."""
        whole = self.ts * (OFFSET_MAX + 1) + self.offset + n
        return Evid(*divmod(whole, OFFSET_MAX + 1))

    def __sub__(self, n: int) -> Evid:
        return self + -n

    @classmethod
    def parse(cls, text) -> Evid:
        if isinstance(text, Evid):
            return text
        if isinstance(text, (tuple, list)):
            return cls(*text)
        ts, _, offset = str(text).partition(":")
        return cls(int(ts), int(offset))


EVID_MIN, EVID_MAX = Evid(0, 0), Evid(TS_MAX, OFFSET_MAX)


def evid_column(ts_sec="ts_sec", offset="evid_offset") -> Column:
    return F.struct(F.col(ts_sec).cast("long").alias("ts"), F.col(offset).cast("long").alias("offset"))


def evid_string(ts_sec="ts_sec", offset="evid_offset") -> Column:
    return F.concat_ws(":", F.col(ts_sec).cast("string"), F.col(offset).cast("string"))


def from_string(c: Column) -> Column:
    """struct<ts, offset> of a printed id; null where it isn't one."""
    part = F.split(c, ":", 2)
    ok = c.rlike(r"^\d+:\d+$")
    return F.when(ok, F.struct(F.element_at(part, 1).try_cast("long").alias("ts"), F.element_at(part, 2).try_cast("long").alias("offset")))


def beyond(last: Evid, reverse: bool = False, ts_sec="ts_sec", offset="evid_offset") -> Column:
    """Rows strictly after ``last``, or before it in reverse."""
    t, o = F.col(ts_sec), F.col(offset)
    if reverse:
        return (t < last.ts) | ((t == last.ts) & (o < last.offset))
    return (t > last.ts) | ((t == last.ts) & (o > last.offset))
