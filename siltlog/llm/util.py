"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage as cut_lineage
from ..runtime import forget as forget

#: Bits of a bitmap of ids; a fuller one only passes more rows on.
FILTER_BITS = 1 << 27
#: Stands for a null doc_id in keys, so that joins need no null-safe equality.
NULL_ID = -(2**63)


def fresh(name: str, taken) -> str:
    """``name``, with underscores appended until no column in ``taken`` has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def id_key(df: DataFrame, column: str = "doc_id") -> Column:
    """A non-null bigint key for an id column."""
    return F.coalesce(df[column].cast("long"), F.lit(NULL_ID))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of ids. It is put together in pieces on the executors and never exceeds FILTER_BITS bits."""
    bits = min(FILTER_BITS, 1 << max(16, (ids.count() * 16).bit_length()))

    def piece(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 16, dtype=bool)
        out[table.column("bit").to_numpy()] = True
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    low = F.col("id").bitwiseAND(F.lit(bits - 1))
    pieces = ids.select(F.shiftright(low, 16).alias("piece"), low.bitwiseAND(F.lit(0xFFFF)).alias("bit")).groupBy("piece").applyInArrow(piece, "piece long, bits binary")
    out = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for r in pieces.collect():
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()
