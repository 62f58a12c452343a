"""What of an event is returned and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..plans.catalog import DEFAULT_FIELD, Index


def split_event(index: Index, df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(ts_sec, evid_offset, default_field, default_value, fields): the default field apart from the others, of which only wanted
    ones are kept; the default field always is."""
    return df.select(index.ts_sec(), F.col(index.offset).cast("long").alias("evid_offset"), F.lit(DEFAULT_FIELD).alias("default_field"), F.col(index.fields[DEFAULT_FIELD, "text"]).alias("default_value"), index.field_map(wanted).alias("fields"))


def field_names(rows: DataFrame) -> DataFrame:
    """Distinct names of the fields in the maps of some rows."""
    return rows.select(F.explode(F.map_keys("fields")).alias("field_name")).distinct()


def drop_ephemeral(df: DataFrame, contract) -> DataFrame:
    """Fields that a contract has as ephemeral end with the route."""
    return df.drop(*(a.column for a in contract if a.ephemeral))


def expanded(fields: Column, hidden: tuple[str, ...] = ()) -> Column:
    """array<struct<key, value>> of the fields to list below an event: by name, without hidden and empty ones."""
    shown = F.map_filter(fields, lambda k, v: (v != "") & ~k.isin(list(hidden)) if hidden else v != "")
    return F.array_sort(F.map_entries(shown))


def display(rows: DataFrame, zone: str = "UTC", verbose: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """(line): results as the command line prints them, ``05 Jan 2024 10:00:00 UTC: message``, with the fields if ``verbose``."""
    when = times.display(F.timestamp_seconds(F.col("evid.ts")), "timestamp", zone)
    line = F.concat(when, F.lit(": "), F.coalesce("default_value", F.lit("")))
    if verbose or wanted is not None:
        fields = F.col("fields") if wanted is None else F.map_filter("fields", lambda k, _: k.isin(wanted))
        line = F.concat(line, F.array_join(F.transform(expanded(fields), lambda e: F.concat(F.lit("\n\t"), e["key"], F.lit("="), e["value"])), ""))
    return rows.select(line.alias("line"))
