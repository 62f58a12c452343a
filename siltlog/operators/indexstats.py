"""Statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evid import Evid
from ..plans.ast import All, And, Node, Not, Or, Term
from ..plans.catalog import Index
from ..plans.compiler import compile_query, resolve


def _ids(index: Index) -> DataFrame:
    return index.df.select(index.ts_sec(), F.col(index.offset).cast("long").alias("evid_offset"), *(F.col(c) for c in ("segment", "modified") if c in index.df.columns))


def index_stats(index: Index) -> DataFrame:
    """One row: index_size, last_ts and last_offset, segments, current_segment_size, last_modified. An index without
    segments is one segment."""
    ids = _ids(index)
    has = set(ids.columns)
    segment = F.col("segment").cast("long") if "segment" in has else F.lit(0).cast("long")
    rows = ids.withColumn("seg", segment)
    per = rows.groupBy("seg").agg(F.count("*").alias("n"), F.max(F.struct("ts_sec", "evid_offset")).alias("last"), (F.max("modified") if "modified" in has else F.max(F.timestamp_seconds("ts_sec"))).alias("m"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("index_size"), F.max("last.ts_sec").alias("last_ts"), F.max("last")["evid_offset"].alias("last_offset"),
        F.count("*").alias("segments"), F.coalesce(F.max_by("n", "seg"), F.lit(0)).cast("long").alias("current_segment_size"), F.max("m").alias("last_modified"),
    )


def last_event(index: Index) -> Evid | None:
    top = _ids(index).agg(F.max(F.struct("ts_sec", "evid_offset")).alias("e")).first().e
    return None if top is None else Evid(top.ts_sec, top.evid_offset)


def field_list(index: Index) -> DataFrame:
    spark = index.df.sparkSession
    return spark.createDataFrame([(n, t) for n, t in sorted(index.fields)], "field_name string, field_type string")


def field_presence(index: Index) -> DataFrame:
    """(field_name, field_type, n_events): events that have each field, in one pass."""
    fields = sorted(index.fields.items())
    row = index.df.agg(*(F.count(F.col(c)).alias(f"c{i}") for i, (_, c) in enumerate(fields)))
    entries = F.array(*(F.struct(F.lit(n).alias("field_name"), F.lit(t).alias("field_type"), F.col(f"c{i}").alias("n_events")) for i, ((n, t), _) in enumerate(fields)))
    return row.select(F.inline(entries))


def exact_size(node: Node, index: Index, compat: bool = False) -> int:
    """How many events match."""
    p = compile_query(node, index, compat)
    return 0 if p is None else index.df.filter(p).count()


def range_estimate(counts: DataFrame, field: str, kind: str, low=None, high=None, low_exclusive: bool = False, high_exclusive: bool = False) -> DataFrame:
    """One row, ``size``: an upper bound of the events with a term of an interval, the sum of the terms' counts (see postings.term_counts). Exact for fields with
    one term an event. Counts are read, postings are not."""
    term = F.col("term").cast("bigint") if kind in ("int", "datetime") else F.col("term")
    rows = counts.filter((F.col("field") == field) & (F.col("type") == kind))
    if low is not None:
        rows = rows.filter(term > low if low_exclusive else term >= low)
    if high is not None:
        rows = rows.filter(term < high if high_exclusive else term <= high)
    return rows.agg(F.coalesce(F.sum("n_events"), F.lit(0)).cast("long").alias("size"))


def estimate(node: Node, index: Index) -> int:
    """An upper bound from exact counts of the leaves, which are taken in one pass: the least for a conjunction, the sum for a disjunction,
    all for a negation, but no more than there are."""
    leaves: list[Node] = []

    def walk(n: Node) -> None:
        if isinstance(n, Term) and n not in leaves:
            leaves.append(n)
        for c in getattr(n, "children", ()) or ((n.child,) if isinstance(n, Not) else ()):
            walk(c)

    walk(node)
    found = [(n, p) for n in leaves if (p := resolve(n, index)) is not None]
    row = index.df.agg(F.count("*").alias("all"), *(F.count_if(p.column).alias(f"n{i}") for i, (_, p) in enumerate(found))).first()
    sizes = {n: row[f"n{i}"] for i, (n, _) in enumerate(found)}

    def size(n: Node) -> int | None:
        if isinstance(n, (All, Not)):
            return row["all"]
        if isinstance(n, Term):
            return sizes.get(n)
        parts = [x for c in n.children if (x := size(c)) is not None]
        if not parts:
            return None
        return min(parts) if isinstance(n, And) else min(row["all"], sum(parts))

    assert isinstance(node, (All, And, Or, Not, Term))
    return size(node) or 0
