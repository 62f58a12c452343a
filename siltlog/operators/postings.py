"""The inverted index as a table: (field, type, term, ts_sec, evid_offset, pos), and what is computed from it.

Searches don't need it, since they scan columns; it serves term statistics, and lookups of rare terms when written
sorted by term (``write_postings``), where row-group statistics prune all but a few groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fieldtypes import TYPES
from ..plans.catalog import Index

EVID = ["ts_sec", "evid_offset"]


def build_postings(index: Index, fields: list[tuple[str, str]] | None = None, positions: bool = True) -> DataFrame:
    """A row for each event, field and distinct term. Terms of text have positions; other values have one term at 0. Without
    ``positions`` (pos is null then) nothing is shuffled, which is all that statistics and boolean lookups need."""
    parts = []
    ids = [index.ts_sec(), F.col(index.offset).cast("long").alias("evid_offset")]
    for (name, kind), column in sorted(index.fields.items()):
        if fields is not None and (name, kind) not in fields:
            continue
        terms = TYPES[kind].terms(index.ref(column))
        head = [F.lit(name).alias("field"), F.lit(kind).alias("type")]
        if kind == "text" and positions:
            each = index.df.select(*head, *ids, F.posexplode(terms).alias("p", "term"))
            rows = each.groupBy("field", "type", "term", *EVID).agg(F.sort_array(F.collect_list("p")).alias("pos"))
        else:
            each = index.df.select(*head, *ids, F.explode(F.array_distinct(terms)).alias("term")).filter(F.col("term").isNotNull())
            rows = each.withColumn("pos", F.array(F.lit(0)) if positions else F.lit(None).cast("array<int>"))
        parts.append(rows.select("field", "type", "term", *EVID, "pos"))
    return reduce(DataFrame.union, parts)


def write_postings(postings: DataFrame, path: str) -> None:
    """Partitioned by field and sorted by term, so that a lookup reads few row groups."""
    postings.repartitionByRange("field", "term", "ts_sec").sortWithinPartitions("field", "term", *EVID).write.mode("append").partitionBy("field").parquet(path)


def lookup(postings: DataFrame, field: str, kind: str, term: str) -> DataFrame:
    """Events with a term."""
    return postings.filter((F.col("field") == field) & (F.col("type") == kind) & (F.col("term") == term)).select(*EVID, "pos")


def lookup_range(postings: DataFrame, field: str, kind: str, low=None, high=None, low_exclusive: bool = False, high_exclusive: bool = False) -> DataFrame:
    """Events with a term of an interval, each once; numbers are compared as numbers, other terms as text."""
    term = F.col("term").cast("bigint") if kind in ("int", "datetime") else F.col("term")
    rows = postings.filter((F.col("field") == field) & (F.col("type") == kind))
    if low is not None:
        rows = rows.filter(term > low if low_exclusive else term >= low)
    if high is not None:
        rows = rows.filter(term < high if high_exclusive else term <= high)
    return rows.select(*EVID).distinct()


def terms(postings: DataFrame, field: str, kind: str) -> DataFrame:
    """The dictionary of a field: its distinct terms in order."""
    return postings.filter((F.col("field") == field) & (F.col("type") == kind)).select("term").distinct().orderBy("term")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, EVID, "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, EVID, "left_anti")


def unite(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [x.select(*EVID) for x in lists]).distinct()


def phrase(postings: DataFrame, field: str, words: list[str]) -> DataFrame:
    """Events in which the words stand one after another: their positions, each less its place in the phrase, have one in common."""
    wanted = F.create_map(*(x for i, w in enumerate(dict.fromkeys(words)) for x in (F.lit(w), F.array(*(F.lit(j) for j, v in enumerate(words) if v == w)))))
    rows = postings.filter((F.col("field") == field) & (F.col("type") == "text") & F.col("term").isin(list(set(words))))
    begins = rows.select(*EVID, F.explode(wanted[F.col("term")]).alias("place"), "pos").select(*EVID, F.explode("pos").alias("at"), "place").select(*EVID, (F.col("at") - F.col("place")).alias("begin"), "place")
    return begins.groupBy(*EVID, "begin").agg(F.count("*").alias("n")).filter(F.col("n") == len(words)).select(*EVID).distinct()


def fetch(events: DataFrame, found: DataFrame) -> DataFrame:
    """The events of a posting list; ``events`` has ts_sec and evid_offset."""
    return events.join(found.select(*EVID), EVID, "inner")


def field_counts(postings: DataFrame) -> DataFrame:
    """Postings of each field."""
    return postings.groupBy("field", "type").agg(F.count("*").alias("n_postings"))


def term_counts(postings: DataFrame) -> DataFrame:
    """Events that hold each term."""
    return postings.groupBy("field", "type", "term").agg(F.count("*").alias("n_events"))


def estimate(postings: DataFrame, field: str, kind: str, term: str) -> int:
    """Events with a term, exactly."""
    return lookup(postings, field, kind, term).count()
