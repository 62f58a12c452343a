"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fresh, text_of

#: Sizes are raised to this power and normalised where no weights are given.
TEMPERATURE = 0.5
SEED = 17
#: CDF entries up to which the table of sources is broadcast; beyond, it is joined on source.
BROADCAST_ENTRIES = 500_000


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where nothing of double precision remains; empty for rate 0."""
    if not rate > 0:
        return [1.0]
    k = np.arange(int(rate + 12 * math.sqrt(rate) + 30))
    pmf = np.exp(k * math.log(rate) - rate - np.fromiter((math.lgamma(x + 1) for x in k), float, len(k)))
    return np.cumsum(pmf).tolist()


def _with_cdf(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([poisson_cdf(r or 0.0) for r in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["source", "rate", "cdf"])


def source_rates(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): mean number of copies of each document of the source, so that the expected characters of each source
    are its weight's share of all characters of docs. Null is a source like another. A source that holds no character has
    rate 0, as has one with no entry in ``weights``."""
    sizes = docs.groupBy("source").agg(F.sum(F.length(text_of(docs)).cast("long")).alias("size"))
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    sizes = sizes.withColumn("w", F.when(F.col("size") > 0, raw).otherwise(0.0))
    total = sizes.agg(F.sum("w").alias("all_w"), F.sum("size").alias("all_size"))
    rate = F.col("w") / F.col("all_w") * F.col("all_size") / F.col("size")
    return sizes.crossJoin(F.broadcast(total)).select("source", F.coalesce(F.when((F.col("size") > 0) & (F.col("all_w") > 0), rate), F.lit(0.0)).alias("rate"))


def uniform(doc_id, seed: int):
    """52 random bits from md5 of the seed and the id, in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_sources(docs: DataFrame, weights: dict | None = None, temperature: float = TEMPERATURE, seed: int = SEED, copy: str | None = "copy") -> DataFrame:
    """Replicate each document by an inverse-Poisson draw whose mean is its source's rate, and shuffle all copies globally.

    ``weights``: target share of characters by source; by default shares are proportional to size to the power
    ``temperature``. The expected volume is that of ``docs``. A document's draw depends on the seed and its doc_id alone, so
    it repeats on any cluster; rows with the same doc_id (null is an id too) get the same draw. Null and empty texts are
    drawn like others of their source. Documents drawn 0 times are absent. An empty table gives an empty table.

    Returns the columns of docs and, unless ``copy`` is None, the copy's number from 1 (the name gets underscores if docs has
    such a column). Rows are spread over partitions and ordered in them by a hash of seed, doc_id and copy."""
    spark = docs.sparkSession
    rates = source_rates(docs, weights, temperature)
    table = [(r.source, r.rate, poisson_cdf(r.rate)) for r in rates.limit(BROADCAST_ENTRIES // 40).collect()]
    kind = docs.schema["source"].dataType.simpleString()
    if len(table) < BROADCAST_ENTRIES // 40 and sum(len(x[2]) for x in table) <= BROADCAST_ENTRIES:
        cdfs = F.broadcast(spark.createDataFrame(table, f"source {kind}, rate double, cdf array<double>"))
    else:
        cdfs = rates.mapInArrow(_with_cdf, f"source {kind}, rate double, cdf array<double>")
    taken = set(docs.columns)
    src, cdf, n, k = (fresh(x, taken) for x in ("_src", "_cdf", "_n", copy or "_copy"))
    cdfs = cdfs.select(F.col("source").alias(src), F.col("cdf").alias(cdf))
    u = uniform(docs["doc_id"], seed)
    out = docs.join(cdfs, docs["source"].eqNullSafe(F.col(src)))
    # a draw is the number of CDF entries at or below u; the last entry may fall short of 1 by rounding
    out = out.withColumn(n, F.size(F.filter(cdf, lambda c: c <= u))).where(F.col(n) > 0)
    out = out.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))).alias(k))
    order = F.xxhash64(F.lit(seed), out["doc_id"], out[k])
    out = out.repartition(order).sortWithinPartitions(order)
    return out.drop(k) if copy is None else out
