"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax, trained by numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U, _char_values, chunks, mix64
from .util import text_of

CLASSES = ("clean", "junk", "toxic")
#: Labelled documents of each class that training uses at most; those with the least hash of doc_id are taken, whole.
MAX_PER_CLASS = 2500
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 18, 12, 6, 0.15, 5
CHARS = (3, 4, 5)
#: A document is kept if its probability of being clean is at least this.
KEEP = 0.5
_SPACE = np.zeros(0x3001, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = True


def features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, and character n-grams of each length: bucket numbers, ordered by text, and bounds of each text.

    A word is a run without white space; its n-grams include one space at either end. Case counts. A word equal to the one
    before it is hashed as one mark of repetition, whatever the word."""
    joined = " " + " ".join(t or "" for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts)))
    begins = np.concatenate([[0], ends])
    space = _SPACE[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
    values = _char_values()[codes]
    values[space] = U(7)
    seen = np.concatenate([[0], np.cumsum(space)])
    out = []
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    hashed = np.zeros(len(codes), np.uint64)
    mask = U(BUCKETS - 1)
    # words: a position-dependent sum over the characters of each run
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(codes)]])))
    if len(start):
        run = np.where(space, U(0), mix64(values + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
        words, bounds = mix64(np.add.reduceat(run, start)), np.searchsorted(start, begins)
        again = np.concatenate([[False], words[1:] == words[:-1]])
        again[bounds[bounds < len(words)]] = False
        words[again] = U(1)
        out.append(((words & mask).astype(np.int32), bounds))
    else:
        out.append((np.zeros(0, np.int32), np.zeros(len(begins), np.int64)))
    n = 0
    for size in range(1, max(CHARS) + 1):
        m = len(codes) - size + 1
        if m <= 0:
            hashed = hashed[:0]
        else:
            hashed = hashed[:m] * U(0xD6E8FEB86659FD93) + values[size - 1 : size - 1 + m]
        if size in CHARS:
            n += 1
            good = np.flatnonzero(seen[size - 1 : size - 1 + len(hashed)] == seen[1 : 1 + len(hashed)])
            h = hashed[good] + U(n)
            h ^= h >> U(31)
            h *= U(0x94D049BB133111EB)
            out.append(((h >> U(40) & mask).astype(np.int32), np.searchsorted(good, begins)))
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their shares of its features."""
    idx, counts = np.unique(np.concatenate([f for f, _ in features([text])]), return_counts=True)
    return idx, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """Class scores of every bucket relative to the first class: a document's logits are their mean over its features."""

    table: np.ndarray  # complex64: junk and toxic
    bias: np.ndarray

    def probabilities(self, texts: list) -> np.ndarray:
        total, count = np.zeros(len(texts), np.complex128), np.zeros(len(texts))
        for idx, bounds in features(texts):
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            if len(some):
                total[some] += np.add.reduceat(self.table[idx], bounds[some])
                count += n
        mean = total / np.maximum(count, 1)
        logits = np.stack([np.zeros(len(texts)), mean.real, mean.imag], axis=1) + self.bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], classes: list[int]) -> Model:
    """SGD with per-parameter step sizes (Adagrad), one document at a time; classes weigh the same."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out = np.zeros((len(CLASSES), DIM), np.float32)
    bias, g_bias, g_emb, g_out = np.zeros(len(CLASSES)), np.full(len(CLASSES), 1e-6), np.full(BUCKETS, 1e-12, np.float32), np.full_like(out, 1e-6)
    bags = [bag(t) for t in texts]
    share = np.bincount(classes, minlength=len(CLASSES))
    weight = len(classes) / np.maximum(share, 1) / max(1, (share > 0).sum())
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(texts)):
            idx, w = bags[i]
            if not len(idx):
                continue
            e = emb.take(idx, axis=0)
            h = w @ e
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[classes[i]] -= 1
            p = (p * weight[classes[i]]).astype(np.float32)
            back = p @ out
            norm = float(back @ back) / DIM
            if norm > 1e-12:  # a bucket stands once in a document
                g = g_emb.take(idx) + w * w * np.float32(norm)
                g_emb[idx] = g
                e -= np.multiply.outer(np.float32(rate) * w / np.sqrt(g), back)
                emb[idx] = e
            step = np.outer(p, h)
            g_out += step * step
            out -= rate * step / np.sqrt(g_out)
            g_bias += p * p
            bias -= rate * p / np.sqrt(g_bias)
        if epoch == 0 and not np.any(out):
            break
    scores = emb @ out.T
    scores -= scores[:, :1]
    return Model(np.ascontiguousarray(scores[:, 1] + 1j * scores[:, 2]).astype(np.complex64), bias - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> list[tuple[int, str, int]]:
    """(doc_id, text, class) of at most ``per_class`` labelled documents of each class. A doc_id has the least quality and the greatest toxicity of its
    rows in labels, and of its texts that of the least hash, so repeated rows change nothing and no more than that many texts are gathered."""
    lab = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("q"), labels["toxic"].cast("int").alias("t")).dropna()
    lab = lab.groupBy("doc_id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    kind = F.when(F.col("t") > 0, 2).when(F.col("q") > 0, 0).otherwise(1)
    lab = lab.select("doc_id", kind.alias("c"))
    picked = [lab.where(F.col("c") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect() for c in range(len(CLASSES))]
    ids = docs.sparkSession.createDataFrame([tuple(r) for rows in picked for r in rows], "doc_id long, c int")
    got = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(ids), "doc_id")
    one = got.groupBy("doc_id", "c").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return sorted((r.doc_id, r.text, r.c) for r in one.collect())


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Model | None:
    rows = training_rows(docs, labels, per_class)
    return fit([r[1] for r in rows], [r[2] for r in rows]) if rows else None


def _scores(model: Model | None, texts: list) -> np.ndarray:
    if model is None:
        return np.tile([1.0, 0.0, 0.0], (len(texts), 1))
    return np.concatenate([model.probabilities(texts[a:b]) for a, b in chunks(texts)] or [np.zeros((0, 3))])


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, label, p_clean, p_junk, p_toxic, keep) for each row of docs.

    label is the most probable class; keep is p_clean >= KEEP. A null or empty text has no feature: its scores are those of
    the bias, and it is kept (there is nothing to object to). Without labelled rows (``model`` None) everything is clean.
    Whole texts are averaged, whatever their length. Equal texts get equal scores; a null doc_id is carried along."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            p = _scores(model, texts)
            keep = (p[:, 0] >= KEEP) | np.fromiter((not t.strip() for t in texts), bool, len(texts))
            label = pa.array([CLASSES[k] for k in p.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), label, *(pa.array(p[:, k]) for k in range(3)), pa.array(keep)], names=["doc_id", "label", "p_clean", "p_junk", "p_toxic", "keep"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, label string, p_clean double, p_junk double, p_toxic double, keep boolean")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, that ``classify`` keeps: those with a null or empty text are, repeated rows are all or
    none, and an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            keep = (_scores(model, texts)[:, 0] >= KEEP) | np.fromiter((not t.strip() for t in texts), bool, len(texts))
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
