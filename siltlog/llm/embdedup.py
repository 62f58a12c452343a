"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products in cells, one representative of each group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import _forest, components
from .util import NULL_ID, cut_lineage, id_key

#: Least cosine of near duplicates.
THRESHOLD = 0.9
#: Rounds of k-means, and vectors in a cell, about: the number of cells grows with the vectors.
ROUNDS, CELL = 4, 2048
#: Centres that are held at once; for more cells, each cell of a first level is divided again.
MAX_CENTRES = 2048
#: Bytes of vectors of a block; what meets in larger cells is compared block by block.
BLOCK_BYTES = 16 << 20
#: What rounding may add to a difference of cosines.
SLACK = 1e-5
#: Vectors for each centre from which those of the second level are made.
SAMPLE = 32


def _unit(batch: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 (zeros appended up to dim), and which rows can be: null ones, zero ones and those with NaN can't."""
    lengths = np.array([len(x) if x.is_valid else 0 for x in batch])
    flat = batch.flatten()
    values = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float32), nan=np.inf)
    out = np.zeros((len(batch), dim), np.float32)
    out[np.repeat(np.arange(len(batch)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    scale = np.abs(out).max(axis=1, initial=0)
    good = np.isfinite(scale) & (scale > 0)
    out = out[good] / scale[good, None]
    return out / np.linalg.norm(out, axis=1)[:, None], good


def unit_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(k, v): least id and bytes of every distinct direction; and the number of dimensions."""
    e = embeddings.select(id_key(embeddings, "vec_id").alias("k"), embeddings["embedding"].cast("array<float>").alias("e"))
    dim = e.agg(F.max(F.size("e"))).first()[0] or 0

    def run(batches):
        for b in batches:
            v, good = _unit(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array([x.tobytes() for x in v], pa.binary())], names=["k", "v"])

    return e.where(F.size("e") > 0).mapInArrow(run, "k long, v binary"), max(0, dim)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def kmeans(vectors: DataFrame, dim: int, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length 1. Every round reads all vectors; a task sends its sums, not its vectors. Begins with those of least hash."""
    begin = vectors.orderBy(F.xxhash64("k"), "k").limit(cells).select("v").toArrow()
    centres = _matrix(begin.column("v"), dim)

    def sums(batches, c):
        total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for b in batches:
            x = _matrix(b.column(1), dim)
            home = (x @ c.T).argmax(axis=1)
            np.add.at(total, home, x)
            count += np.bincount(home, minlength=len(c))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[i].tobytes() for i in some], pa.binary())], names=["cell", "s"])

    def add(table: pa.Table) -> pa.Table:
        s = np.frombuffer(b"".join(table.column("s").to_pylist())).reshape(-1, dim).sum(axis=0)
        return pa.table({"cell": table.column("cell").slice(0, 1), "s": pa.array([s.tobytes()], pa.binary())})

    for _ in range(rounds):
        got = vectors.mapInArrow(lambda batches, c=centres: sums(batches, c), "cell int, s binary").groupBy("cell").applyInArrow(add, "cell int, s binary").toArrow()
        new = centres.copy()
        for cell, s in zip(got.column("cell").to_pylist(), got.column("s").to_pylist()):
            v = np.frombuffer(s)
            if (n := np.linalg.norm(v)) > 0:
                new[cell] = v / n
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def _local_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of some vectors in memory; begins with the first ones."""
    centres = x[:cells]
    for _ in range(ROUNDS):
        home = (x @ centres.T).argmax(axis=1)
        total = np.zeros((len(centres), x.shape[1]))
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        centres = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-30)[:, None], centres).astype(np.float32)
    return centres


def _apart(centres: np.ndarray) -> np.ndarray:
    wide = centres.astype(float)
    return np.sqrt(np.maximum((wide**2).sum(axis=1)[:, None] + (wide**2).sum(axis=1) - 2 * wide @ wide.T, 1e-12)).astype(np.float32)


def _visits(x: np.ndarray, centres: np.ndarray, apart: np.ndarray, reach) -> tuple[np.ndarray, np.ndarray]:
    """Home cells, and which cells are within ``reach`` of each vector: that far it may be from their border."""
    s = x @ centres.T
    home = s.argmax(axis=1)
    rows = np.arange(len(s))
    visit = (s[rows, home][:, None] - s) <= np.asarray(reach, np.float32).reshape(-1, 1) * apart[home] + SLACK
    visit[rows, home] = True
    return home, visit


def _placed(vectors: DataFrame, dim: int, cells: int, far: float, limit: float = math.inf) -> DataFrame | None:
    """(cell, home, k, v): each vector in its home cell and in those whose border is within half the distance of near duplicates, so of two that are on
    either side of a border, one visits the other's home at least. With more than MAX_CENTRES cells there are two levels: a vector visits the cells of a
    first one in this way, and the cells into which its home there is divided. In a cell of the first level that is not its home, it visits
    those within the whole distance, as those who live there needn't come to it. None if more than ``limit`` comparisons would be made in the cells of the first level, which
    is counted before any vector is sent."""
    top = cells if cells <= MAX_CENTRES else math.ceil(math.sqrt(cells))
    centres = kmeans(vectors, dim, top)
    apart = _apart(centres)

    def assign(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                home, visit = _visits(_matrix(part.column(1), dim), centres, apart, far / 2)
                row, cell = np.nonzero(visit)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(cell == home[row]), *part.take(pa.array(row)).columns], names=["cell", "home", "k", "v"])

    def tally(batches):
        there, native = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                home, visit = _visits(_matrix(b.slice(lo, 1024).column(1), dim), centres, apart, far / 2)
                there += visit.sum(axis=0)
                native += np.bincount(home, minlength=len(centres))
        some = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(there[some].astype(float)), pa.array(native[some].astype(float))], names=["cell", "n", "h"])

    if limit < math.inf:
        by = vectors.mapInArrow(tally, "cell long, n double, h double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
        if (by.agg(F.sum(F.col("n") * F.col("h"))).first()[0] or 0) > limit:
            return None
    placed = cut_lineage(vectors.mapInArrow(assign, "cell long, home boolean, k long, v binary"))
    if cells == top:
        return placed
    most, cell_size, sample = 4 * math.ceil(cells / top), CELL, SAMPLE
    salt_size = BLOCK_BYTES // (4 * dim)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("h"))
    sizes = cut_lineage(sizes.select("cell", F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("h") / cell_size))).cast("int").alias("subs"), "h", F.ceil(F.col("n") / salt_size).cast("int").alias("salts")))
    chosen = placed.join(sizes, "cell").where(F.col("home") & (F.pmod(F.xxhash64("k", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("h") / (sample * F.col("subs"))))) == 0))

    def divide(table: pa.Table) -> pa.Table:
        c = _local_centres(_matrix(table.column("v"), dim), table.column("subs")[0].as_py())
        return pa.table({"at": table.column("cell").slice(0, 1), "centres": pa.array([c.tobytes()], pa.binary())})

    made = chosen.select("cell", "subs", "v").groupBy("cell").applyInArrow(divide, "at long, centres binary")
    # a cell of the first level that nobody has as home has no centres and no pair
    made = made.join(sizes.select(F.col("cell").alias("at"), "salts"), "at").select("at", "centres", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("to"))
    salted = placed.join(sizes.select("cell", "salts"), "cell").select("cell", F.pmod(F.xxhash64("k"), "salts").cast("int").alias("salt"), "home", "k", "v")

    def assign_again(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "home": pa.array([], pa.bool_()), "k": pa.array([], pa.int64()), "v": pa.array([], pa.binary())})
        c = np.frombuffer(right.column("centres")[0].as_py(), np.float32).reshape(-1, dim)
        between, base, out = _apart(c), left.column("cell")[0].as_py() << 24, []
        for lo in range(0, left.num_rows, 1024):
            part = left.slice(lo, 1024)
            native = part.column("home").to_numpy()
            home, visit = _visits(_matrix(part.column("v"), dim), c, between, np.where(native, far / 2, far))
            row, cell = np.nonzero(visit)
            took = part.take(pa.array(row))
            out.append(pa.table({"cell": pa.array(base + cell.astype(np.int64)), "home": pa.array(native[row] & (cell == home[row])), "k": took.column("k"), "v": took.column("v")}))
        return pa.concat_tables(out)

    return cut_lineage(salted.groupBy("cell", "salt").cogroup(made.groupBy("at", "to")).applyInArrow(assign_again, "cell long, home boolean, k long, v binary"))


def near_pairs(vectors: DataFrame, dim: int, t: float = THRESHOLD, forest: bool = False) -> DataFrame:
    """(a, b, cosine) with a < b for pairs of vectors (k, v) with a cosine of t or more, each once. With ``forest`` only edges (a, b) that connect what is
    similar; some may stand more than once. No pair is lost. An empty table has none.

    In a cell, those at home are compared with all who are there. Vectors far from each other in no direction visit so many cells that these take more
    comparisons than all pairs, block by block; then there is one cell. Both ways find the same."""
    n = vectors.count()
    cells = math.ceil(n / CELL)
    far = math.sqrt(max(0.0, 2 - 2 * t))
    placed = None
    if cells > 1:
        placed = _placed(vectors, dim, cells, far, n * n / 2)
    whole = placed is None
    if whole:
        placed = vectors.select(F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "k", "v")
    # at home by blocks i, all who are there by blocks j; of few vectors the blocks are smaller, for there to be enough tasks
    block = max(CELL, min(math.ceil(n / 8), BLOCK_BYTES // (4 * max(1, dim))))
    size = placed.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / block).cast("int").alias("lefts"), F.ceil(F.count("*") / block).cast("int").alias("rights"))
    mine = placed.join(size, "cell").where("lefts > 0").withColumn("i0", F.pmod(F.xxhash64("k"), "lefts").cast("int")).withColumn("j0", F.pmod(F.xxhash64("k", F.lit(2)), "rights").cast("int"))
    row = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(F.col("i0").alias("i"), j.alias("j")))
    column = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.col("j0").alias("j")))
    if whole:  # each two blocks once
        mine = mine.withColumn("j0", F.col("i0"))
        to = F.explode(F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda o: F.struct(F.least("i0", o).alias("i"), F.greatest("i0", o).alias("j"))))
    else:
        to = F.explode(F.when(F.col("home"), F.array_union(row, column)).otherwise(column))
    dealt = mine.withColumn("to", to).select("cell", F.col("to.i").alias("i"), F.col("to.j").alias("j"), (F.col("home") & (F.col("i0") == F.col("to.i"))).alias("left"), (F.col("j0") == F.col("to.j")).alias("right"), "home", "k", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, home = table.column("k").to_numpy(), table.column("home").to_numpy()
        ordered = not whole or table.column("i")[0].as_py() == table.column("j")[0].as_py()
        x = _matrix(table.column("v"), dim)
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        out, held = [], 0
        y = np.ascontiguousarray(x[right].T)
        for lo in range(0, len(left), 256):
            a = left[lo : lo + 256]
            z = x[a]
            for at in range(0, len(right), 4096):
                b = right[at : at + 4096]
                cos = (z @ y[:, at : at + 4096]).ravel()
                near = np.flatnonzero(cos >= t)
                if not len(near):
                    continue
                u, w = a[near // len(b)], b[near % len(b)]
                good = np.where(home[w] & ordered, keys[u] < keys[w], keys[u] != keys[w])
                edges = np.stack([np.minimum(keys[u], keys[w])[good], np.maximum(keys[u], keys[w])[good]])
                if forest:
                    out.append(edges)
                    held += edges.shape[1]
                    if held > 1_000_000:  # only what connects them is kept
                        out = [np.stack([c.to_numpy() for c in _forest(np.concatenate(out, axis=1), ("a", "b")).columns])]
                        held = out[0].shape[1]
                else:
                    out.append((*edges, cos[near][good].astype(float)))
        if forest:
            return _forest(np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64), ("a", "b"))
        a, b, c = (np.concatenate(y) for y in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    groups = dealt.groupBy("cell", "i", "j")
    if forest:
        return groups.applyInArrow(compare, "a long, b long")
    return groups.applyInArrow(compare, "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def dedup_embeddings(embeddings: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(vec_id, representative, kept) for each vec_id: groups are connected by cosines of ``t`` or more; the least vec_id of
    each represents it and is kept (null is an id, and the least).

    Vectors of fewer dimensions than the longest count as padded with zeros. Null and empty vectors, those of length zero and those with a
    null, NaN or infinite component are similar to nothing and are kept. Rows of one vec_id are one item, which is similar to whatever one of them
    is. Vectors of equal direction are grouped by their bytes and only the first is compared. An empty table gives an empty one. Other columns
    are not read. No pair is lost."""
    all_ids = embeddings.select(id_key(embeddings, "vec_id").alias("k")).distinct()
    units, dim = unit_vectors(embeddings)
    if not dim:
        return all_ids.select(_id("k").alias("vec_id"), _id("k").alias("representative"), F.lit(True).alias("kept"))
    units = cut_lineage(units)
    firsts = cut_lineage(units.groupBy("v").agg(F.min("k").alias("k")).select("k", "v"))
    copies = units.join(firsts.select(F.col("k").alias("a"), "v"), "v").where("a <> k").select("a", F.col("k").alias("b"))
    # two directions may have the same least id: rows of one vec_id are one item, so no pair is lost by that
    pairs = near_pairs(firsts, dim, t, forest=True).union(copies)
    groups = components(pairs)
    out = all_ids.join(groups.select("root", F.col("node").alias("k")), "k", "left")
    return out.select(_id("k").alias("vec_id"), _id(F.coalesce("root", "k")).alias("representative"), F.col("root").isNull().alias("kept"))


def _id(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != NULL_ID, c)
