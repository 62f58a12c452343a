"""Line dedup over overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fresh, id_key, text_of

WINDOW = 3


def line_dedup(docs: DataFrame, removed: str = "n_removed", drop_emptied: bool = False) -> DataFrame:
    """Remove every later occurrence of three consecutive lines from the whole table.

    Lines are split at newlines and compared after trimming spaces; blank lines are skipped when windows are formed and are never
    removed. Windows are ordered by (doc_id, place); the first of equal windows stays, and every line that some later one
    covers goes. Since a removed line always has an equal line earlier in that order, one copy of each line remains.

    Returns the columns of ``docs`` with ``text`` (and ``n_chars``, where there is one) brought up to date, and the count of
    removed lines under ``removed`` (with underscores appended if docs has such a column). Texts that lose nothing are
    returned byte for byte. Null and empty texts and texts of fewer than three lines that are not blank have no window and
    stay. A null doc_id comes first in the order. Rows with equal doc_id and text are one document; rows with equal doc_id and
    different texts are different documents. ``drop_emptied``: leave out documents in which nothing but blank lines remains.

    Equal windows are recognised by 128 bits of hash. The count of windows and their first place is a partial aggregate, so
    a window with any number of copies costs no more than another; only hashes and places are shuffled for it. The text is
    shuffled once, to meet its removed lines."""
    taken = set(docs.columns)
    key, th, later = (fresh(x, taken) for x in ("_key", "_text_hash", "_later"))
    text = text_of(docs)
    numbered = F.filter(F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("p"), F.trim(s).alias("s"))), lambda v: v["s"] != "")
    lines = docs.select(id_key(docs).alias("k"), F.xxhash64(text).alias("t"), F.transform(numbered, lambda v: v["s"]).alias("lines")).where(F.size("lines") >= WINDOW)
    at = lambda i, j: F.element_at("lines", i + j + 1)
    windows = lines.select(
        "k",
        "t",
        F.inline(
            F.transform(
                F.sequence(F.lit(0), F.size("lines") - WINDOW),
                lambda i: F.struct(F.xxhash64(*(at(i, j) for j in range(WINDOW))).alias("h1"), F.xxhash64(F.lit(1), *(at(i, j) for j in range(WINDOW))).alias("h2"), i.alias("i")),
            )
        ),
    )
    place = F.struct("k", "t", "i")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    gone = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first")).groupBy("k", "t").agg(F.collect_set("i").alias("later"))
    gone = gone.select(F.col("k").alias(key), F.col("t").alias(th), F.col("later").alias(later))
    out = docs.withColumns({key: id_key(docs), th: F.xxhash64(text)}).join(gone, [key, th], "left")

    split = F.split(text, "\n")
    places = F.transform(numbered, lambda v: v["p"])
    covered = F.array_distinct(F.flatten(F.transform(F.col(later), lambda i: F.array(*(F.element_at(places, i + j + 1) for j in range(WINDOW))))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), covered)
    hit = F.col(later).isNotNull()
    new = F.when(hit, F.array_join(F.transform(kept, lambda p: F.element_at(split, p + 1)), "\n")).otherwise(docs["text"])
    count = F.when(hit, F.size(covered)).otherwise(0).cast("long")
    changed, cut = fresh("_new_text", taken), fresh(removed, taken)
    out = out.withColumns({changed: new, cut: count})
    if drop_emptied:
        out = out.where(~hit | (F.regexp_replace(changed, r"[\n ]+", "") != ""))
    columns = [F.col(changed).alias(c) if c == "text" else F.when(hit, F.length(changed)).otherwise(docs[c]).cast(t).alias(c) if c == "n_chars" else docs[c] for c, t in docs.dtypes]
    return out.select(*columns, cut)
