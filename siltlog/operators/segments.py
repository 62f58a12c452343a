"""Segments of an index: rotation by number of events, retention of the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_events(df: DataFrame, order: list[str], column: str = "n") -> DataFrame:
    """Number rows from 0 in the order of some columns without bringing them to one task: ranges are sorted each by itself, and each
    one's numbers begin after the rows of those before. The range split is cut off first, so that both passes see the same."""
    from ..runtime import cut_lineage

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    id_ = F.monotonically_increasing_id()
    placed = cut_lineage(ranged.withColumn("_range", F.shiftright(id_, 33)).withColumn("_in", id_.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return placed.join(F.broadcast(before), "_range").withColumn(column, F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def rotate(df: DataFrame, every: int, order=("ts_sec", "evid_offset")) -> DataFrame:
    """Add ``segment``: a new one after each ``every`` events, in order. 0 is no rotation."""
    if every <= 0:
        return df.withColumn("segment", F.lit(0).cast("long"))
    return number_events(df, list(order), "_n").withColumn("segment", F.floor(F.col("_n") / every).cast("long")).drop("_n")


def retain(df: DataFrame, newest: int) -> DataFrame:
    """Rows of the newest segments; 0 keeps all. Only the segment numbers are ranked."""
    if newest <= 0:
        return df
    keep = df.select("segment").distinct().orderBy(F.desc("segment")).limit(newest)
    return df.join(F.broadcast(keep), "segment", "left_semi")
