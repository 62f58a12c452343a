"""Tailing: the Column of a search applied to a stream. The cursor is the stream's checkpoint, so a query can be stopped and go on."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.project import split_event
from ..plans.catalog import Index
from ..plans.compiler import compile_query
from ..plans.parser import parse_tail

#: Seconds between two looks, of the command line and of a console.
REFRESH, CONSOLE_REFRESH = 3, 2


def tail_stream(query: str, index: Index, stream: DataFrame, fields: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Matching events as they arrive, shaped like results. ``stream`` has the columns of the index. Every new event is seen, also one
    that is older than those before it."""
    p = compile_query(parse_tail(query), index, compat)
    live = replace(index, df=stream)
    rows = stream.filter(F.lit(False) if p is None else p)
    return split_event(live, rows, fields)


def start(rows: DataFrame, sink, checkpoint: str, seconds: float = REFRESH):
    """Hand each batch to ``sink(df, batch)``; stop() pauses, starting again with the same checkpoint resumes."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
