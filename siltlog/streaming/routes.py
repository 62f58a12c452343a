"""Routes: a source, filters in a row, and sinks; from code or from INI sections."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from ..operators import filters as _filters  # noqa: F401 (registers filters)
from ..operators.filters import DROPPED, Filter
from ..settings import Settings
from ..sources.store import stream_id
from .contracts import Contract, chain

log = logging.getLogger(__name__)


@dataclass
class Route:
    """Filters are checked against each other when the route is made. ``apply`` works on batches and streams alike."""

    name: str
    filters: list[Filter] = field(default_factory=list)
    source: Contract = field(default_factory=lambda: Contract(sign=True))

    def __post_init__(self):
        self.contract = chain([self.source, *(f.contract for f in self.filters)])

    def run(self, events: DataFrame) -> DataFrame:
        """All events with ``error``: what each filter expects is checked before it, what it guarantees after."""
        df = events.withColumn("error", F.lit(None).cast("string"))
        for f in self.filters:
            df = df.withColumn("error", F.coalesce("error", f.contract.unmet(set(df.columns), "expects")))
            df = f.apply(df)
            df = f.contract.validated(df)
            df = df.withColumn("error", F.coalesce("error", f.contract.unmet(set(df.columns), "guarantees")))
        return df

    def types(self) -> dict[str, str]:
        """The fields that leave the route, with their types."""
        return {a.name: a.type for a in self.contract if not a.ephemeral and a.name not in ("input", "hostname", "message")}

    def accepted(self, events: DataFrame) -> DataFrame:
        """Events that passed, without ephemeral fields."""
        df = self.run(events)
        return df.filter(F.col("error").isNull()).drop("error", *(a.column for a in self.contract if a.ephemeral))

    def rejected(self, events: DataFrame) -> DataFrame:
        """Events with an error; those dropped on purpose are neither here nor there."""
        df = self.run(events)
        return df.filter(F.col("error").isNotNull() & (F.col("error") != DROPPED))

    def counts(self, events: DataFrame) -> DataFrame:
        """(outcome, n): accepted, dropped and failed events."""
        outcome = F.when(F.col("error").isNull(), "accepted").when(F.col("error") == DROPPED, "dropped").otherwise("failed")
        return self.run(events).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))

    def store(self, events: DataFrame, *stores, checkpoint: str | None = None, rejects: str | None = None, **trigger):
        """Write a batch, or start a query that writes a stream, to one or several stores; each batch is computed once for all.
        ``rejects``: a folder for the events that failed."""

        def write(df: DataFrame, batch: int | None) -> None:
            every = self.run(df).persist()
            try:
                good = every.filter(F.col("error").isNull()).drop("error", *(a.column for a in self.contract if a.ephemeral))
                stream = None if batch is None else stream_id(events.sparkSession, checkpoint)
                for s in stores:
                    s.append(good, self.types(), stream, batch)
                if rejects:
                    bad = every.filter(F.col("error").isNotNull() & (F.col("error") != DROPPED))
                    bad.select("ts", "input", "hostname", "message", "error").write.mode("append" if stream is None else "overwrite").parquet(rejects if stream is None else f"{rejects}/stream={stream}/batch={batch}")
            finally:
                every.unpersist()

        if not events.isStreaming:
            return write(events, None)
        writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(self.name)
        return (writer.trigger(**trigger) if trigger else writer).start()


def filter_of(name: str, settings: Settings) -> Filter:
    """A filter by the name of its section ``[filter:name]``, whose ``type`` says what it is (by default its name)."""
    section = settings.like("filter").get(name)
    values = dict(section.values) if section else {}
    kind = values.pop("type", name)
    return plugins.make("filter", kind, **{k.replace(" ", "_"): v for k, v in values.items()})


def routes_of(settings: Settings) -> dict[str, tuple[str, Route, list[str]]]:
    """By name: input, route and outputs of each section ``[route:name]`` (``input``, ``filter = a | b``, ``output = x, y``). A route that
    can't be made is left out with a warning."""
    out = {}
    for name, section in settings.like("route").items():
        try:
            source, sinks = section.text("input"), section.items("output")
            if not source or not sinks:
                raise ValueError("input and output are needed")
            out[name] = (source, Route(name, [filter_of(f, settings) for f in section.items("filter", "|")]), sinks)
        except Exception as e:  # any plugin may fail in its own way, and other routes go on
            log.warning("route %s is left out: %s", name, e)
    return out
