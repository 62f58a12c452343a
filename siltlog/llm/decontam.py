"""Benchmark decontamination by winnowed k-gram fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U, Words, chunks
from .util import bitmap, cut_lineage, fresh, id_key, text_of

#: Words in a fingerprinted gram, and grams in a winnowing window. A shared run of K + W - 1 words always shares a fingerprint.
K, W = 6, 7
MIN_WORDS = K + W - 1
#: Characters of benchmark up to which its fingerprints go to every task; beyond, fingerprints are joined by a shuffle.
BROADCAST_CHARS = 20_000_000
SPANS = "item_id long, doc_start long, item_start long, n_words long"


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places (word numbers over all texts) and hashes of the fingerprints: the least k-gram hash of each window of W grams,
    the rightmost of equal ones. Texts of fewer than MIN_WORDS words have no window."""
    grams, _ = words.grams(K)
    n = len(grams) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, where = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, W):
        other = grams[j : j + n]
        less = other <= best
        best[less], where[less] = other[less], j
    inside = np.zeros(n, dtype=bool)
    for a, b in zip(words.first[:-1], words.first[1:]):
        inside[a : max(a, b - MIN_WORDS + 1)] = True
    places = np.unique((np.arange(n) + where)[inside])
    return places, grams[places]


def extend(doc: np.ndarray, item: np.ndarray, hits) -> list[tuple[int, int, int]]:
    """Maximal equal runs (doc start, item start, words) of at least MIN_WORDS through the hits (doc place, item place)."""
    out, reached = [], {}
    for i, j in sorted(hits):
        if reached.get(i - j, -1) >= i:
            continue
        a = 0
        while a < i and a < j and doc[i - a - 1] == item[j - a - 1]:
            a += 1
        b = 0
        while i + b < len(doc) and j + b < len(item) and doc[i + b] == item[j + b]:
            b += 1
        reached[i - j] = i + b
        if a + b >= MIN_WORDS:
            out.append((i - a, j - a, a + b))
    return out


class Index:
    """Fingerprints of the benchmark in sorted arrays."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [x[0] for x in items]
        words = Words([x[1] for x in items])
        self.items = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        places, prints = winnow(words)
        order = np.argsort(prints, kind="stable")
        self.prints, places = prints[order], places[order]
        self.item = np.searchsorted(words.first, places, side="right") - 1
        self.place = places - words.first[self.item]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.prints & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def spans(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item_id, doc start, item start, words)"""
        words = Words(texts)
        places, prints = winnow(words)
        maybe = np.flatnonzero(self.sieve[(prints & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.prints, prints[maybe], side) for side in ("left", "right"))
        found: dict[tuple[int, int], list] = {}
        for k in np.flatnonzero(hi > lo):
            p = places[maybe[k]]
            d = int(np.searchsorted(words.first, p, side="right")) - 1
            for m in range(lo[k], hi[k]):
                found.setdefault((d, int(self.item[m])), []).append((int(p - words.first[d]), int(self.place[m])))
        return [(d, self.ids[i], *span) for (d, i), hits in found.items() for span in extend(words.hash[words.first[d] : words.first[d + 1]], self.items[i], hits)]


def _finder(items: list[tuple[int, str]]):
    cache: list[Index] = []

    def find(texts: list) -> list:
        if not cache:
            cache.append(Index(items))
        return [(a + d, *rest) for a, b in chunks(texts) for d, *rest in cache[0].spans(texts[a:b])]

    return find


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), text_of(benchmark).alias("text")).distinct()


def _small(items: DataFrame) -> list[tuple[int, str]] | None:
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return [tuple(r) for r in items.collect()] if chars <= BROADCAST_CHARS else None


def _prints(df: DataFrame, key: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, place, print); with a bitmap, only prints that may be wanted."""

    def run(batches):
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                places, prints = winnow(words)
                if wanted is not None:
                    low = (prints & U(8 * len(wanted) - 1)).astype(np.int64)
                    some = (wanted[low >> 3] >> (7 - (low & 7)) & 1).astype(bool)
                    places, prints = places[some], prints[some]
                d = np.searchsorted(words.first, places, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([ids[lo + x] for x in d], pa.int64()), pa.array(places - words.first[d]), pa.array(prints.view(np.int64))], names=[key, f"{key}_at", "print"])

    return df.select(key, "text").mapInArrow(run, f"{key} long, {key}_at long, print long")


def _spans_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(uid, spans) for a benchmark of any size: fingerprints meet by a shuffle, and both texts meet at their hits. A bitmap of the benchmark's prints, of
    bounded size, keeps most of the documents' prints out of the shuffle."""
    items = items.withColumn("ikey", F.xxhash64("item_id", "text"))
    known = cut_lineage(_prints(items, "ikey"))
    wanted = bitmap(known.select(F.col("print").alias("id")))
    hits = _prints(docs, "uid", wanted).join(known, "print").groupBy("uid", "ikey").agg(F.collect_list(F.struct("uid_at", "ikey_at")).alias("hits"))
    both = hits.join(items.select("ikey", "item_id", F.col("text").alias("item_text")), "ikey").join(docs.select("uid", F.col("text").alias("doc_text")), "uid")

    def run(batches):
        for b in batches:
            out = []
            for uid, item, hits, item_text, doc_text in zip(*(b.column(n).to_pylist() for n in ("uid", "item_id", "hits", "item_text", "doc_text"))):
                out += [(uid, item, *s) for s in extend(Words([doc_text]).hash, Words([item_text]).hash, {(h["uid_at"], h["ikey_at"]) for h in hits})]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=["uid", "item_id", "doc_start", "item_start", "n_words"])

    return both.select("uid", "item_id", "hits", "item_text", "doc_text").mapInArrow(run, "uid long, " + SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): every maximal run of at least MIN_WORDS words that a document shares
    with a benchmark item, with the run's first word in either, counted from 0.

    Words are lower-cased runs of letters and digits, so case, punctuation and line breaks don't hide a passage. Winnowing
    guarantees that each such run shares a fingerprint; runs are then extended both ways, and shorter ones dropped, so the
    result is that of comparing all places. Null and empty texts share nothing. Equal rows of the benchmark count once; each
    row of docs is judged by itself, so repeated rows repeat their runs. A null doc_id or item_id is carried along."""
    items = _items(benchmark)
    small = _small(items)
    if small is None:
        ids = docs.select(id_key(docs).alias("k"), text_of(docs).alias("text"), docs["doc_id"].cast("long").alias("doc_id")).withColumn("uid", F.xxhash64("k", "text"))
        return ids.select("uid", "doc_id").join(_spans_by_join(ids.select("uid", "text").distinct(), items), "uid").drop("uid")
    find = _finder(small)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[d], *rest) for d, *rest in find(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "item_id", "doc_start", "item_start", "n_words"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, " + SPANS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that share no run of MIN_WORDS words with the benchmark."""
    items = _items(benchmark)
    small = _small(items)
    if small is None:
        uid = fresh("_uid", docs.columns)
        keyed = docs.withColumn(uid, F.xxhash64(id_key(docs), text_of(docs)))
        bad = _spans_by_join(keyed.select(F.col(uid).alias("uid"), text_of(docs).alias("text")).distinct(), items).select(F.col("uid").alias(uid)).distinct()
        return keyed.join(bad, uid, "left_anti").drop(uid)
    find, at = _finder(small), docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for d, *_ in find(b.column(at).to_pylist()):
                keep[d] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
