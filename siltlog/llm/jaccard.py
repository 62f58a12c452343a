"""Near-duplicate join by Jaccard similarity of word n-gram sets, over token-combination prefixes.

Tokens are hashed word n-grams. How many documents have each is counted in ranges of tokens, and the counts go back to the
documents by the same way, so no list of tokens is gathered anywhere. A token that FREQUENT documents have is frequent. The global
order puts rare tokens first, by hash, then frequent ones. Let a document have r rare tokens of n, f frequent ones, and let
p = n - ceil(t n) + 1 be its prefix length at threshold t. Similar documents have an overlap c of at least o = t/(1+t) (n1 + n2).

* The first m = min(r, p) tokens are indexed singly. Of the common tokens, at most max(n1 - m1, n2 - m2) are not among those
  that both have indexed. So a pair is a candidate if it shares o less that many indexed tokens, and one at least.
* A similar pair that shares no rare token has r < p in both, and all its common tokens are frequent. Take the u = f1 + f2 - c frequent
  tokens of either, by hash. Of the u - 3 windows of four, 2 c - u - 3 or more hold three common tokens; of three tokens in a window two at
  least are next to each other, in both documents too. So documents with r < p index
  - each two neighbouring frequent tokens (k = 2), unless both are so frequent that unrelated documents have them together: then
  - each three frequent tokens within four neighbouring ones (k = 3) that hold such a hot pair of neighbours.
  If the two that are neighbours in the window aren't hot, both documents index them; if they are, both index the three.
  A combination stands in three windows at most, so (3 o - f1 - f2 - 3)/3 or more are in both, and a document may leave out
  the most frequent ones, fewer than any partner must share with it.
* Where that is less than one, both sets are tiny. They share two tokens at least among the first p + 1 (rare ones first, then
  by frequency), and index all pairs of frequent ones among these.

All parts are exact: no list is capped. A combination's list of DENSE sets or more, most of whose pairs are similar by their bitmaps, gives no pairs:
its sets become one family, families with a set in common are one, and all pairs of a family are compared by products of matrices, a tile of TILE times TILE sets
a task. So a group of near copies costs a few nanoseconds a pair, whatever number of combinations its sets share. A pair within a family
is taken there and nowhere else; what a range knows of families keeps its other lists from giving such pairs. Other lists longer than LONG are cut to blocks, and pairs of blocks are dealt to tasks. Candidates are
tried on bitmaps (of how many tokens fall on a bit, whether that is odd: two sets differ in as many tokens at least as their bitmaps
differ in bits), those of combinations on bitmaps of up to SKETCH bytes where their lists meet, and those that pass are verified on whole sets. Candidates are sought with 40 bits of the tokens' hashes, and
two tokens that have these in common only add candidates. Sets are compared by 48 bits and told apart by 64: two different tokens or sets
are taken for one with chances of 2^-48 and 2^-64."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U, Words, chunks, mix64
from .util import bitmap, cut_lineage, forget, fresh, id_key, shuffle_width, text_of

#: Words in a gram; least similarity.
N, THRESHOLD = 2, 0.6
#: Documents from which a token counts as frequent. It only moves work between the two kinds of index.
FREQUENT = 8
#: A pair of neighbours is hot if so many unrelated documents are expected to have both.
HOT = 32
#: Tokens that a task indexes together, and tokens in a range; the number of ranges follows from the input.
CHUNK_TOKENS, RANGE_TOKENS = 1_000_000, 2_000_000
#: Tokens in what a chunk sends to a range, at least; tasks of a shuffle, at most.
ROW_TOKENS, TASKS = 200, 20_000
#: Entries of a posting list that are paired in one place.
LONG = 2048
#: Bytes of a bitmap that goes with the sets of combinations, at most.
SKETCH = 32
#: Ranges of single tokens to one of combinations, which are fewer: a range has each set's sketch once for all its combinations there.
COMBINED = 4
#: The lists of a chunk are sent in turns, each of so many times the chunk's own bytes at most, about.
TURN = 1.5
#: Entries from which a list of similar sets becomes a family; sets, and tokens, along a tile of its pairs, about.
DENSE, TILE, TILE_TOKENS = 128, 2048, 1_000_000
#: Columns of a tile's matrices at a time; sets of a tile from which a token has a column. Pairs by other tokens are counted one by one.
COLUMNS, COLUMN_SETS = 1024, 24
#: Sets, and pairs, in a connected part of the candidates up to which it is verified in one place.
LARGE_PART, LARGE_PAIRS = 5_000, 50_000
_40, _48 = U((1 << 40) - 1), U((1 << 48) - 1)


def gram_sets(texts: list, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of each text, one after another, and bounds. A text of 1 to n - 1 words has one gram, all of it."""
    words = Words(texts)
    grams, counts = words.grams(n)
    have = np.diff(words.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words.first[:-1], counts)
    tokens = grams[place] if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero((have > 0) & (have < n))
    if len(short):
        extra = []
        for d in short:
            h = np.zeros(1, np.uint64)
            for w in words.hash[words.first[d] : words.first[d + 1]]:
                h = mix64(h * U(31) + w)
            extra.append(h[0])
        owner, tokens = np.concatenate([owner, short]), np.concatenate([tokens, np.array(extra, np.uint64)])
        order = np.argsort(owner, kind="stable")
        owner, tokens = owner[order], tokens[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    out, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for d in range(len(counts)):
        s = np.sort(tokens[bounds[d] : bounds[d + 1]])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
        sizes[d + 1] = len(s)
    return np.concatenate(out) if out else tokens, np.cumsum(sizes)


def set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix64(tokens ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    sizes = np.diff(bounds)
    ids = mix64(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64))
    ids[sizes == 0] = 0
    return ids


def _prefix(sizes: np.ndarray, t: float) -> np.ndarray:
    """Lengths of prefixes."""
    return sizes - np.ceil(t * sizes - 1e-9).astype(np.int64) + 1


# --- columns of numbers as compressed bytes ---------------------------------------------------------------------------------------


def low_bytes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width]


def from_bytes(blob: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = blob.reshape(-1, width)
    return out.view("<u8").ravel()


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of numbers, each with a width in bytes: their lengths, then plane by plane."""
    head = np.array([len(x) for x, _ in columns], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(low_bytes(x.astype(np.uint64, copy=False), w).T).tobytes() for x, w in columns))


def unpack(blob, *widths: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    lengths = raw[: 4 * len(widths)].view(np.uint32)
    out, at = [], 4 * len(widths)
    for n, w in zip(lengths.tolist(), widths):
        out.append(from_bytes(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).ravel(), w))
        at += n * w
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; np.cumsum undoes it."""
    return np.diff(x, prepend=U(0))


def _blobs(table: pa.Table, column: str = "blob") -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in table.column(column)]


def _slices(x: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of sorted 40-bit numbers begin, and the end."""
    edges = np.array([-(-(i << 40) // ranges) for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])


def _token_sets(batches, n):
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in chunks(texts):
            yield gram_sets(texts[lo:hi], n)


# --- how many documents have each token ---------------------------------------------------------------------------------------------


def _ask(batches, n: int, ranges: int, at_once: int):
    """(part, chunk, kind, blob): the distinct tokens of ``at_once`` by range, with how many of the chunk's sets have each (kind 0), so a token that all
    documents have is sent once for each chunk; and the sets' ids and sizes, and the tokens' owners in the order of the tokens (kind 1), which pass through.
    Of equal sets in a task one is sent."""
    seen: set[int] = set()
    task = TaskContext.get().partitionId()
    base, number = task << 24, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    count = size = 0

    def give():
        tokens, owner = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        more, tokens = np.diff(np.append(begin, len(tokens))) - 1, tokens[begin]
        cuts = _slices(tokens, ranges)
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        blobs = [pack((steps(tokens[a:b]), 5), (more[a:b], 3)) for a, b in zip(cuts[some], cuts[some + 1])]
        blobs.append(pack((np.concatenate(ids), 8), (np.concatenate(sizes), 4), (owner, 3)))
        parts = [*some.tolist(), (task * 31 + number) % ranges]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([base + number] * len(parts), pa.int64()), pa.array([0] * len(some) + [1], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "chunk", "kind", "blob"])

    for tokens, bounds in _token_sets(batches, n):
        sid, lengths = set_ids(tokens, bounds), np.diff(bounds)
        new = np.array([k for k, (i, m) in enumerate(zip(sid.tolist(), lengths.tolist())) if m and i not in seen and not seen.add(i)], np.int64)
        if not len(new):
            continue
        keep = np.zeros(len(sid), bool)
        keep[new] = True
        held.append((tokens[np.repeat(keep, lengths)] & _40, np.repeat(np.arange(count, count + len(new)), lengths[new])))
        ids.append(sid[new])
        sizes.append(lengths[new])
        count, size = count + len(new), size + len(held[-1][0])
        if size >= at_once:
            yield give()
            number, count, size, held, ids, sizes = number + 1, 0, 0, [], [], []
    if held:
        yield give()


def _answer(table: pa.Table, frequent: int, places: int) -> pa.Table:
    """What came, with the place that each chunk goes to, and the heat of each token: 8 times the logarithm of how many sets have it; 0 for rare ones. A set that several tasks
    sent counts as often."""
    kinds = table.column("kind").to_numpy()
    rows = np.flatnonzero(kinds == 0)
    blobs = _blobs(table)
    got = [unpack(blobs[i], 5, 3) for i in rows]
    tokens = [np.cumsum(a, dtype=np.uint64) for a, _ in got]
    heats: list = [None] * len(kinds)
    if len(rows):
        every = np.concatenate(tokens)
        order = np.argsort(every)
        ranked = every[order]
        runs = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        times = np.diff(np.append(runs, len(ranked)))
        counts = np.add.reduceat(np.concatenate([b for _, b in got]).astype(np.int64)[order] + 1, runs)
        heat = np.where(counts >= frequent, np.minimum(255, np.rint(8 * np.log2(counts))), 0).astype(np.uint64)
        of = np.empty(len(every), np.uint64)
        of[order] = np.repeat(heat, times)
        at = 0
        for i, t in zip(rows, tokens):
            heats[i] = pack((of[at : at + len(t)], 1))
            at += len(t)
    chunk = table.column("chunk").to_numpy()
    dest = ((chunk >> 24) * 8 + (chunk & 0xFFFFFF)) % places
    return pa.table({"dest": pa.array(dest.astype(np.int32)), "chunk": table.column("chunk"), "part": table.column("part"), "kind": table.column("kind"), "blob": pa.array(blobs, pa.binary()), "heat": pa.array(heats, pa.binary())})


# --- the index ----------------------------------------------------------------------------------------------------------------------

#: Sizes are kept up to here; a pair with a larger set is a candidate once it shares a token.
LARGE = (1 << 24) - 1
#: Counts as sharing enough.
PLENTY = (1 << 24) - 1


def tiny_sets(t: float) -> int:
    """Sizes up to which a pair of sets may have no window with three common tokens."""
    return int(4 / (2 * t - 1) + 1e-9)


def left_out(size: np.ndarray, frequent: np.ndarray, t: float) -> np.ndarray:
    """Combinations that sets may leave out: one less than any similar set, at least t times as large, must share with each."""
    a = 3 * t / (1 + t)
    return np.maximum(0, np.ceil(((a - 1) * t * size + a * size - frequent - 3) / 3 - 1e-9) - 1).astype(np.int64)


def bitmap_bytes(sizes):
    """Bytes of a bitmap: a power of two, with 1.5 bits a token at least."""
    return 1 << np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1) * 1.5)).astype(np.int64) - 3)


def bitmaps(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    order = np.argsort(owner, kind="stable")
    spots, ends = mix64(tokens[order] ^ U(0x5851F42D4C957F2D)), np.cumsum(sizes)
    out = []
    for lo, hi, n in zip((ends - sizes).tolist(), ends.tolist(), (8 * bitmap_bytes(sizes)).tolist()):
        odd = np.bincount((spots[lo:hi] & U(n - 1)).astype(np.int64), minlength=n) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def may_be_similar(a: bytes, b: bytes, n: int, m: int, t: float) -> bool:
    """Whether sets of n and m tokens with these bitmaps can be."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count() <= (n + m) * (1 - t) / (1 + t) + 1e-9


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """Words of 64 bits of the sketches: bitmaps of one word at least, of SKETCH bytes at most."""
    return np.clip(bitmap_bytes(sizes), 8, SKETCH) // 8


def sketches(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of SKETCH bytes as words for each set, zeros after its sketch. Owners ascend."""
    last, width = U(64) * sketch_words(sizes).astype(np.uint64) - U(1), 8 * SKETCH
    spots = (mix64(tokens ^ U(0x5851F42D4C957F2D)) & last[owner]).astype(np.int64)
    out = []
    for lo in range(0, len(sizes), 8192):
        hi = min(lo + 8192, len(sizes))
        a, b = np.searchsorted(owner, [lo, hi])
        odd = np.bincount((owner[a:b] - lo) * width + spots[a:b], minlength=(hi - lo) * width) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").view("<u8").reshape(-1, SKETCH // 8))
    return np.concatenate(out) if out else np.zeros((0, SKETCH // 8), np.uint64)


def _filled(sizes: np.ndarray) -> np.ndarray:
    """Which words of the rows of sketches are in use."""
    return np.arange(SKETCH // 8) < sketch_words(sizes)[:, None]


def padded(words: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Rows of sketches from the words in use; none of no words."""
    if not len(words):
        return None
    out = np.zeros((len(sizes), SKETCH // 8), np.uint64)
    out[_filled(sizes)] = words
    return out


class Sketches:
    """Sketches of numbered sets, folded to each number of words."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, t: float):
        self.sizes, self.words, self.t = sizes, sketch_words(sizes), t
        self.folded = {k: np.bitwise_xor.reduce(rows.reshape(len(rows), -1, k), axis=1) for k in (1 << i for i in range((SKETCH // 8).bit_length()))}

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs: in how many bits they differ, of how many, and in how many tokens similar ones differ at most."""
        words = np.minimum(self.words[x], self.words[y])
        bits = np.zeros(len(x), np.int64)
        for k, rows in self.folded.items():
            some = np.flatnonzero(words == k)
            if len(some):
                bits[some] = np.bitwise_count(rows[x[some]] ^ rows[y[some]]).sum(axis=1, dtype=np.int64)
        return bits, 64 * words, (self.sizes[x] + self.sizes[y]) * (1 - self.t) / (1 + self.t)

    def may_be_similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits, _, most = self.apart(x, y)
        return bits <= most + 1e-9

    def mostly_similar(self, own: np.ndarray) -> bool:
        """Whether more than half the pairs of these sets look similar, by 256 of them: they differ in no more bits than such with three quarters of the difference allowed do
        in the mean. It only decides how pairs are compared."""
        r = np.random.default_rng(len(own))
        x, y = own[r.integers(0, len(own), 256)], own[r.integers(0, len(own), 256)]
        x, y = x[x != y], y[x != y]
        bits, of, most = self.apart(x, y)
        low, high = np.minimum(self.sizes[x], self.sizes[y]), np.maximum(self.sizes[x], self.sizes[y])
        return len(x) > 0 and np.mean((bits <= of * (1 - np.exp(-1.5 * most / of)) / 2) & (low >= self.t * high - 1e-9)) >= 0.55


def _within(owner: np.ndarray) -> np.ndarray:
    """Places within the runs of an owner."""
    if not len(owner):
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))


def _pair_of(x, y):
    return mix64(x * U(0xD6E8FEB86659FD93) + mix64(y + U(1))) & _40


def _triple_of(x, y, z):
    return mix64(_pair_of(x, y) * U(0x9E3779B97F4A7C15) + mix64(z + U(2))) & _40


def postings(tokens: np.ndarray, owner: np.ndarray, heat: np.ndarray, sizes: np.ndarray, t: float, total: int, together: int):
    """For the single and the combined index: tokens or combinations, their owners, and what stands before (0 for nothing); and how
    many tokens each set has indexed singly. ``total``: how many sets there are, about; ``together``: see HOT."""
    p = _prefix(sizes, t)
    order = np.lexsort((tokens, heat > 0, owner))
    tokens, owner, heat = tokens[order], owner[order], heat[order].astype(np.int64)
    often = heat > 0
    rare = np.bincount(owner[~often], minlength=len(sizes))
    first = ~often & (_within(owner) < p[owner])
    single, indexed = (tokens[first], owner[first]), np.minimum(rare, p)
    few = rare < p
    x, o, h = (c[often & few[owner]] for c in (tokens, owner, heat))
    frequent = np.bincount(o, minlength=len(sizes))
    logs = 8 * math.log2(max(2, total))
    # neighbours: same(d) tells whether the token d places on is of the same set
    same = lambda d: np.concatenate([o[d:] == o[:-d], np.zeros(min(d, len(o)), bool)]) if len(o) else np.zeros(0, bool)
    on = lambda c, d: np.concatenate([c[d:], np.zeros(min(d, len(c)), c.dtype)])
    s1, s2, s3 = same(1), same(2), same(3)
    x1, x2, x3, h1, h2, h3 = on(x, 1), on(x, 2), on(x, 3), on(h, 1), on(h, 2), on(h, 3)
    hot = s1 & (h + h1 - logs > 8 * math.log2(together))
    hot1, hot2 = on(hot, 1), on(hot, 2)
    made = []  # combination, place where it begins, heat, kind
    for kind, good, sig, warm in (
        (2, s1 & ~hot, _pair_of(x, x1), h + h1 - logs),
        (3, s2 & (hot | hot1), _triple_of(x, x1, x2), h + h1 + h2 - 2 * logs),
        (4, s3 & hot, _triple_of(x, x1, x3), h + h1 + h3 - 2 * logs),
        (5, s3 & hot2, _triple_of(x, x2, x3), h + h2 + h3 - 2 * logs),
    ):
        at = np.flatnonzero(good)
        made.append((sig[at], at, warm[at], np.full(len(at), kind)))
    sig, at, warm, kind = (np.concatenate(c) for c in zip(*made))
    gone = np.where(sizes > tiny_sets(t), left_out(sizes, frequent, t), 0)
    hottest = np.lexsort((sig, -warm, o[at]))
    keep = np.ones(len(sig), bool)
    keep[hottest] = _within(o[at][hottest]) >= gone[o[at][hottest]]
    sig, at, kind = sig[keep], at[keep], kind[keep]
    # a pair of sets is taken where its common run of tokens begins: the combination before this one, if both sets have it, has the pair too
    pair_there, triple_there = np.zeros(len(o) + 1, bool), np.zeros(len(o) + 1, bool)
    pair_there[at[kind == 2]] = True
    triple_there[at[kind == 3]] = True
    prior = np.where(at > 0, at - 1, len(o))
    before = np.where(kind == 2, np.where(pair_there[prior], x[prior - (prior == len(o))] if len(o) else at, 0), 0).astype(np.uint64)
    if len(at):
        linked = (kind > 2) & triple_there[prior]
        before[linked] = _triple_of(x[prior[linked]], x[at[linked]], x1[at[linked]])
    before = np.where(before > 0, np.maximum(mix64(before) & U(0xFFFFFFFF), U(1)), U(0))
    owners = o[at]
    small = np.flatnonzero(few & (sizes <= tiny_sets(t)) & (frequent > 1))
    if len(small):
        mine = np.isin(o, small)
        y, q, g = x[mine], o[mine], h[mine]
        order = np.lexsort((y, g, q))
        y, q = y[order], q[order]
        part = _within(q) < (p + 1 - rare)[q]
        y, q = y[part], q[part]
        extra, whose = [], []
        for d in range(1, int(np.bincount(q).max(initial=1))):
            both = np.flatnonzero(q[d:] == q[:-d])
            extra.append(_pair_of(np.minimum(y[both], y[both + d]), np.maximum(y[both], y[both + d])))
            whose.append(q[both])
        if extra:
            sig, owners = np.concatenate([sig, *extra]), np.concatenate([owners, *whose])
            before = np.concatenate([before, np.zeros(len(sig) - len(before), np.uint64)])
    return (*single, None), (sig, owners, before), indexed


def combined_ranges(ranges: int) -> int:
    return -(-ranges // COMBINED)


def _chunk(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Distinct tokens of a chunk, how many more of its sets have each, and their heat; ids and sizes of the sets, and the tokens' owners."""
    tokens, more, heat = [], [], []
    table = table.sort_by([("kind", "ascending"), ("part", "ascending")])  # as the owners are
    for kind, blob, hot in zip(table.column("kind").to_pylist(), _blobs(table), table.column("heat").to_pylist()):
        if kind == 1:
            rest = unpack(blob, 8, 4, 3)
        else:
            a, b = unpack(blob, 5, 3)
            tokens.append(np.cumsum(a, dtype=np.uint64))
            more.append(b)
            heat.append(unpack(hot, 1)[0])
    return (*(np.concatenate(x) for x in (tokens, more, heat)), *rest)


def _index(table: pa.Table, t: float, total: int, ranges: int, together: int) -> pa.Table:
    """See _lists."""
    return _lists(*_chunk(table), t, total, ranges, together)


def _whole(table: pa.Table, t: float, total: int, ranges: int, together: int) -> pa.Table:
    """(blob, bytes, lists): a chunk in one row, and its size; of one chunk in many also how many bytes its lists have."""
    columns, chunk = _chunk(table), table.column("chunk")[0].as_py()
    blob, tried = pack(*zip((steps(columns[0]), *columns[1:]), (5, 3, 1, 8, 4, 3))), chunk % (1 << 28) == 0
    lists = sum(map(len, _blobs(_lists(*columns, t, total, ranges, together)))) if tried else 0
    return pa.table({"blob": pa.array([blob], pa.binary()), "bytes": pa.array([len(blob)], pa.int64()), "lists": pa.array([lists], pa.int64())})


def _lists_of(batches, t: float, total: int, ranges: int, together: int, turn: int, turns: int):
    """The lists that have this turn, of chunks."""
    for batch in batches:
        for blob in batch.column(0):
            tokens, *rest = unpack(blob.as_buffer(), 5, 3, 1, 8, 4, 3)
            yield from _lists(np.cumsum(tokens, dtype=np.uint64), *rest, t, total, ranges, together, turn, turns).to_batches()


def _lists(tokens, more, heat, ids, sizes, owner, t: float, total: int, ranges: int, together: int, turn: int = 0, turns: int = 1) -> pa.Table:
    """(kind, part, blob): postings of a chunk (kinds 0 and 1; the sets of combinations with their sketches), and bitmaps of its sets (kind 2). Ranges of combinations are
    numbered after those of tokens. Each blob names the sets that are in it. Every range has its turn, and is numbered among those of the turn; bitmaps have the first one."""
    times = more.astype(np.int64) + 1
    sizes, owner = sizes.astype(np.int64), owner.astype(np.int64)
    tokens = np.repeat(tokens, times)
    *found, indexed = postings(tokens, owner, np.repeat(heat, times), sizes, t, total, together)
    lacks, by_id = _prefix(sizes, t) - indexed, np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    combined = np.zeros(len(sizes), bool)
    combined[found[1][1]] = True
    order = np.argsort(owner, kind="stable")
    order = order[combined[owner[order]]]
    row = np.cumsum(combined) - 1
    sketch = sketches(tokens[order], row[owner[order]], sizes[combined])
    rows = []
    if turn == 0:
        bits = b"".join(bitmaps(tokens, owner, sizes))
        rows.append((2, int(ids[0] % U(ranges)) // turns, pack((ids, 8), (sizes, 4), (np.frombuffer(bits, np.uint8), 1))))
    for kind, (sig, own, before) in enumerate(found):
        first, count = (ranges, combined_ranges(ranges)) if kind else (0, ranges)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        before = np.zeros(0, np.uint64) if before is None else before[order]
        cuts = _slices(sig, count)
        for part in np.flatnonzero((cuts[1:] > cuts[:-1]) & ((first + np.arange(count)) % turns == turn)):
            a, b = cuts[part], cuts[part + 1]
            who, number = np.unique(rank[own[a:b]], return_inverse=True)
            who = by_id[who]
            # what is indexed is told by what it lacks of a prefix, mostly nothing
            rows.append((kind, (first + int(part)) // turns, pack((steps(sig[a:b]), 5), (number, 3), (before[a:b], 4), (steps(ids[who]), 8), (np.minimum(sizes[who], LARGE), 3), (np.minimum(lacks[who], LARGE), 3), (sketch[row[who]][_filled(sizes[who])] if kind else np.zeros(0, np.uint64), 8))))
    kinds, parts, blobs = zip(*rows) if rows else ([], [], [])
    return pa.table({"kind": pa.array(kinds, pa.int32()), "part": pa.array(parts, pa.int32()), "blob": pa.array(blobs, pa.binary())})


# --- candidates ---------------------------------------------------------------------------------------------------------------------


def _summed(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their counts added up, and needs."""
    keys, counts, needs = (np.concatenate(x) for x in zip(*held))
    if not len(keys):
        return keys, counts, needs
    order = np.argsort(keys, kind="stable")
    keys, counts, needs = keys[order], counts[order], needs[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cuts], np.add.reduceat(counts, cuts), needs[cuts]


def _taken(a, b, ia, ib, before_a, before_b, t: float):
    """Of pairs of sets with sizes a and b, of which ia and ib tokens are indexed: which are taken, what they count, and what they must count in all."""
    large = np.maximum(a, b)
    good = (np.minimum(a, b) >= t * large - 1e-9) | (large == LARGE)
    if before_a is not None:
        good &= (before_a != before_b) | (before_a == 0)
        return good, np.full(len(a), PLENTY), np.ones(len(a), np.int64)
    need = np.maximum(1, np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64) - np.maximum(a - ia, b - ib))
    need[large == LARGE] = 1
    return good, np.ones(len(a), np.int64), need


class Meeting:
    """Collects pairs of numbered sets, with counts added up."""

    def __init__(self, sizes, indexed, before, number, t, sketch=None, limit=8_000_000):
        self.family = None
        self.sizes, self.indexed, self.before, self.number, self.t, self.limit = sizes, indexed, before, number, t, limit
        self.sketch = None if sketch is None else Sketches(sketch, sizes, t)
        self.held, self.size = [], 0

    def add(self, i, j):
        """Postings i and j have one token."""
        b = self.before
        x, y = self.number[i], self.number[j]
        good, count, need = _taken(self.sizes[x], self.sizes[y], self.indexed[x], self.indexed[y], None if b is None else b[i], None if b is None else b[j], self.t)
        good &= x != y
        if self.family is not None:
            good &= self.family[x] != self.family[y]
        x, y, count, need = x[good], y[good], count[good], need[good]
        if self.sketch:
            good = self.sketch.may_be_similar(x, y)
            x, y, count, need = x[good], y[good], count[good], need[good]
        self.held.append(((np.minimum(x, y).astype(np.int64) << 32) | np.maximum(x, y), count, need))
        self.size += len(x)
        if self.size > self.limit:
            self.held = [_summed(self.held)]
            self.size = len(self.held[0][0]) // 2

    def pairs(self):
        keys, counts, needs = _summed(self.held) if self.held else (np.zeros(0, np.int64),) * 3
        return keys >> 32, keys & 0xFFFFFFFF, np.minimum(counts, PLENTY), needs


def _meet(table: pa.Table, t: float, parts: int, block: int, dense: int = DENSE) -> pa.Table:
    """(kind, part, blob) of the posting lists of one range: distinct pairs of sets, with how many tokens of the range they share and how many they
    must share over all ranges (kind 0), pairs of blocks of long lists (kind 1), and edges that connect the sets of lists of similar ones (kind 3)."""
    kind = table.column("kind")[0].as_py()
    if kind == 2:  # bitmaps pass through
        return table.select(["kind", "part", "blob"]).append_column("other", pa.nulls(len(table), pa.binary()))
    got, base = [], 0
    rows = []
    for blob in _blobs(table):
        sig, own, before, ids, sizes, lacks, words = unpack(blob, 5, 3, 4, 8, 3, 3, 8)
        sizes = sizes.astype(np.int64)
        got.append((np.cumsum(sig, dtype=np.uint64), own.astype(np.int64) + base, before, np.cumsum(ids, dtype=np.uint64), sizes, _prefix(sizes, t) - lacks.astype(np.int64)))
        rows.append(padded(words, sizes))
        base += len(ids)
    token, own, before, ids, sizes, indexed = (np.concatenate(x) for x in zip(*got))
    ids, at, same = np.unique(ids, return_index=True, return_inverse=True)  # tasks send copies of a set
    sizes, indexed, own = sizes[at], indexed[at], same[own]
    sketch = np.concatenate(rows)[at] if kind else None
    order = np.lexsort((own, token))
    token, own, before = token[order], own[order], before[order] if kind else None
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])])
    token, own, before = token[new], own[new], before[new] if kind else None
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(begin, len(token)))
    m = Meeting(sizes, indexed, before, own, t, sketch)
    blocks, alike = [], [np.zeros((2, 0), np.int64)]
    similar = np.zeros(len(begin), bool)
    for i in np.flatnonzero(length >= dense) if kind else []:
        s, n = begin[i], length[i]
        if m.sketch.mostly_similar(own[s : s + n]):
            similar[i] = True
            alike.append(np.stack([np.full(n - 1, own[s]), own[s + 1 : s + n]]))
    hubs = _forest(np.concatenate(alike, axis=1), ("a", "b"))
    if len(hubs):  # pairs within a family are compared there, so other lists needn't give them
        m.family = np.arange(len(ids))
        m.family[hubs.column("b").to_numpy()] = hubs.column("a").to_numpy()
    for n in np.unique(length[(length > 1) & ~similar]):
        starts = begin[(length == n) & ~similar]
        if n <= block:
            i, j = np.triu_indices(n, 1)
            step = max(1, 2_000_000 // len(i))
            for k in range(0, len(starts), step):
                s = starts[k : k + step, None]
                m.add((s + i).ravel(), (s + j).ravel())
            continue
        for s in starts:
            cut = []
            for a in range(s, s + n, block):
                b = min(a + block, s + n)
                cut.append(pack((ids[own[a:b]], 8), (sizes[own[a:b]], 3), (indexed[own[a:b]], 3), (before[a:b] if kind else np.zeros(0, np.uint64), 4), (sketch[own[a:b]][_filled(sizes[own[a:b]])] if kind else np.zeros(0, np.uint64), 8)))
            blocks += [(x, cut[j] if j > i else None) for i, x in enumerate(cut) for j in range(i, len(cut))]
    packed = pack_pairs(ids, *m.pairs(), parts)
    one, two = zip(*blocks) if blocks else ([], [])
    long = pa.table({"kind": pa.array([1] * len(one), pa.int32()), "part": pa.array([0] * len(one), pa.int32()), "blob": pa.array(one, pa.binary()), "other": pa.array(two, pa.binary())})
    linked = [pack(*((ids[hubs.column(c).to_numpy()], 8) for c in "ab"))] if len(hubs) else []
    family = pa.table({"kind": pa.array([3] * len(linked), pa.int32()), "part": pa.array([0] * len(linked), pa.int32()), "blob": pa.array(linked, pa.binary()), "other": pa.nulls(len(linked), pa.binary())})
    return pa.concat_tables([pa.table({"kind": pa.array([0] * len(packed), pa.int32()), "part": packed.column("part"), "blob": packed.column("pairs"), "other": pa.nulls(len(packed), pa.binary())}), long, family])


def _meet_blocks(batches, t: float, parts: int):
    """The pairs of two blocks of a list, or of one."""
    for batch in batches:
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            halves = [unpack(x, 8, 3, 3, 4, 8) for x in (one, two) if x is not None]
            ids, sizes, indexed, before, words = (np.concatenate(x) for x in zip(*halves))
            n, k, sizes = len(halves[0][0]), len(halves[-1][0]), sizes.astype(np.int64)
            m = Meeting(sizes, indexed.astype(np.int64), before if len(before) else None, np.arange(len(ids)), t, padded(words, sizes))
            if two is None:
                m.add(*np.triu_indices(n, 1))
            else:
                m.add(np.repeat(np.arange(n), k), np.tile(np.arange(n, n + k), n))
            yield from pack_pairs(ids, *m.pairs(), parts).to_batches()


def pack_pairs(ids: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray, needs: np.ndarray, parts: int) -> pa.Table:
    """(part, pairs): pairs dealt by the hash of their lesser id. A blob names each set once."""
    flip = ids[a] > ids[b]
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    part = (mix64(ids) % U(parts)).astype(np.int32)[a]
    order = np.argsort(part, kind="stable")
    part, a, b, counts, needs = part[order], a[order], b[order], counts[order], needs[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    blobs = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own, number = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
        blobs.append(pack((ids[own], 8), (number, 4), (counts[lo:hi], 3), (needs[lo:hi], 3)))
    return pa.table({"part": pa.array(part[cuts[:-1]] if len(part) else [], pa.int32()), "pairs": pa.array(blobs, pa.binary())})


def _settle(table: pa.Table) -> pa.Table:
    """Pairs that share as many tokens as they must, over all ranges."""
    got = []
    for blob in _blobs(table, "pairs"):
        ids, number, counts, needs = unpack(blob, 8, 4, 3, 3)
        number = number.astype(np.int64)
        got.append((ids[number[: len(counts)]], ids[number[len(counts) :]], counts.astype(np.int64), needs.astype(np.int64)))
    a, b, counts, needs = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((b, a))
    a, b, counts, needs = a[order], b[order], counts[order], needs[order]
    cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    good = np.add.reduceat(counts, cuts) >= np.minimum.reduceat(needs, cuts)
    return pa.table({"a": pa.array(a[cuts][good].view(np.int64)), "b": pa.array(b[cuts][good].view(np.int64))})


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """Partitioned by ``part``, each in a partition of its own if there are no more than TASKS; ``to`` is the partition."""
    n = min(parts, TASKS)
    return df.withColumn("to", F.pmod("part", F.lit(n)).cast("int")).repartitionById(n, F.col("to"))


def candidates(texts: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame | None, int]:
    """(a, b): pairs of ids of sets that may be similar; (id, family, size): sets of families, all pairs within which are to be compared besides, if there
    are any; and the number of ranges, which grows with the texts."""
    rows, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    total, frequent, together, block, dense = rows, FREQUENT, HOT, LONG, DENSE
    about = (chars or 0) // 6
    # a chunk sends a row to each range: of very many tokens both are larger, for rows to hold ROW_TOKENS
    grown = max(1.0, math.sqrt(ROW_TOKENS * about / (CHUNK_TOKENS * RANGE_TOKENS)))
    at_once = int(CHUNK_TOKENS * grown)
    ranges = max(1, math.ceil(about / (RANGE_TOKENS * grown)))
    lists = -(-ranges * 2 // 5)  # two fifths of the tokens are indexed, about
    deals = 4 * lists
    # each range and nearly each chunk gets a task of its own, up to TASKS, so what a task holds is the same for any input
    chunked = min(TASKS, 2 * max(1, about // at_once))
    asked = texts.mapInArrow(lambda batches: _ask(batches, n, ranges, at_once), "part int, chunk long, kind int, blob binary")
    answered = _dealt(asked, ranges).groupBy("to", "part").applyInArrow(lambda x: _answer(x, frequent, chunked), "dest int, chunk long, part int, kind int, blob binary, heat binary")
    # the shuffles up to here are gone before lists are sent; their ranges are sent in turns, for lists grow faster than the input
    whole = cut_lineage(answered.repartitionById(chunked, F.col("dest")).groupBy("dest", "chunk").applyInArrow(lambda x: _whole(x, t, total, lists, together), "blob binary, bytes long, lists long"))
    size, sent = whole.where("lists > 0").agg(F.sum("bytes"), F.sum("lists")).first()
    turns = max(1, math.ceil((sent or 0) / (TURN * (size or 1))))
    parts = -(-(lists + combined_ranges(lists)) // turns)

    def meet(turn: int) -> DataFrame:
        indexed = whole.select("blob").mapInArrow(lambda batches: _lists_of(batches, t, total, lists, together, turn, turns), "kind int, part int, blob binary")
        return cut_lineage(_dealt(indexed, parts).groupBy("to", "kind", "part").applyInArrow(lambda x: _meet(x, t, deals, block, dense), "kind int, part int, blob binary, other binary"))

    turned = [meet(turn) for turn in range(turns)]
    forget(whole)
    met = reduce(DataFrame.union, turned)
    pairs = met.where("kind = 0").select("part", F.col("blob").alias("pairs"))
    long = met.where("kind = 1").select("blob", "other")
    if not long.isEmpty():
        dealt = long.repartition(4 * shuffle_width(texts.sparkSession))
        pairs = pairs.union(dealt.mapInArrow(lambda batches: _meet_blocks(batches, t, deals), "part int, pairs binary"))
    settled = counted = cut_lineage(_dealt(pairs, deals).groupBy("to", "part").applyInArrow(_settle, "a long, b long"))
    maps = met.where("kind = 2").select("blob").mapInArrow(_bitmap_rows, "id long, size int, bits binary").groupBy("id").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    families = None
    alike = met.where("kind = 3").select("blob")
    if not alike.isEmpty():
        families = components(alike.mapInArrow(_alike_rows, "a long, b long"))
        families = families.select(F.col("node").alias("id"), F.col("root").alias("family")).union(families.select("root", "root").distinct())
        families = cut_lineage(families.join(maps.select("id", "size"), "id"))
        maps = maps.join(families.select("id", "family"), "id", "left")
    else:
        maps = maps.withColumn("family", F.lit(None).cast("long"))
    for end in "ab":
        settled = settled.join(maps.select(F.col("id").alias(end), F.col("size").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}"), F.col("family").alias(f"family_{end}")), end)
    settled = settled.where("family_a is null or family_b is null or family_a <> family_b").drop("family_a", "family_b")

    def sift(batches):
        for x in batches:
            c = {name: x.column(name) for name in x.schema.names}
            good = pa.array([may_be_similar(*v, t) for v in zip(c["bits_a"].to_pylist(), c["bits_b"].to_pylist(), c["size_a"].to_pylist(), c["size_b"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([c["a"].filter(good), c["b"].filter(good)], names=["a", "b"])

    sifted = cut_lineage(settled.mapInArrow(sift, "a long, b long"))
    forget(*turned, counted)
    return sifted, families, ranges


def _alike_rows(batches):
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            a, b = unpack(blob, 8, 8)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _bitmap_rows(batches):
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            ids, sizes, raw = unpack(blob, 8, 4, 1)
            ends = np.cumsum(bitmap_bytes(sizes.astype(np.int64)))
            raw = raw.astype(np.uint8).tobytes()
            bits = [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(bits, pa.binary())], names=["id", "size", "bits"])


# --- verification -------------------------------------------------------------------------------------------------------------------


def verify(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set shares with each of the others: a product of 0-1 matrices over the tokens that many have, and pairs one by one over the rest."""
    n, m = len(sets), len(others)
    tokens, owner = np.concatenate([*sets, *others]), np.repeat(np.arange(n + m), [len(x) for x in (*sets, *others)])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff(np.append(begin, len(tokens)))
    left = np.add.reduceat((owner < n).astype(np.int64), begin)  # of equal tokens, those of sets stand first
    both = (left > 0) & (left < length)
    out = np.zeros((n, m), np.float32)  # whole numbers up to 2^24 are exact, and sums come in slabs
    total = np.zeros((n, m), np.int64)
    many = np.flatnonzero(both & (length >= COLUMN_SETS))
    for at in range(0, len(many), COLUMNS):
        some = many[at : at + COLUMNS]
        where = np.repeat(begin[some] - np.cumsum(length[some]) + length[some], length[some]) + np.arange(length[some].sum())
        slab = np.zeros((n + m, len(some)), np.float32)
        slab[owner[where], np.repeat(np.arange(len(some)), length[some])] = 1
        np.matmul(slab[:n], slab[n:].T, out=out)
        total += out.astype(np.int64)
    few = np.flatnonzero(both & (length < COLUMN_SETS))
    at, total = 0, total.ravel()
    work = np.cumsum(left[few] * (length[few] - left[few]))
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 1_000_000)))
        some = few[at:to]
        i, right = left[some], length[some] - left[some]
        pairs = i * right
        place = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        r, b, skip = (np.repeat(x, pairs) for x in (right, begin[some], i))
        total += np.bincount(owner[b + place // r] * m + owner[b + skip + place % r] - n, minlength=n * m)
        at = to
    return total.reshape(n, m)


def _tile(table: pa.Table, t: float):
    """Of a tile of a family: numbers of the sets along its sides, how similar they are, and which pairs are (each once, of different sets)."""
    ids, side, weight = (table.column(c).to_numpy() for c in ("id", "side", "weight"))
    have = [np.cumsum(unpack(x, 6)[0], dtype=np.uint64) for x in _blobs(table)]
    rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # along both sides in a tile of one group
    sizes = np.array([len(x) for x in have], np.int64)
    both = overlaps([have[i] for i in rows], [have[i] for i in columns])
    sims = both / (sizes[rows][:, None] + sizes[columns] - both)
    good = sims >= t - 1e-12
    good &= rows[:, None] < columns if (side == 2).all() else True
    return ids, weight, rows, columns, sims, good


def _stars(good: np.ndarray, rows: np.ndarray, columns: np.ndarray, count: int) -> np.ndarray:
    """Edges from one node of each connected part to the others."""
    edges, at = [np.zeros((2, 0), np.int64)], [np.full(count, -1), np.full(count, -1)]
    at[0][rows], at[1][columns] = np.arange(len(rows)), np.arange(len(columns))
    seen = np.zeros(count, bool)
    for first in rows[good.any(axis=1)].tolist():
        if seen[first]:
            continue
        seen[first] = True
        wave = np.array([first])
        while len(wave):
            i, j = at[0][wave], at[1][wave]
            near = np.zeros(count, bool)
            near[columns[good[i[i >= 0]].any(axis=0)]] = True
            near[rows[good[:, j[j >= 0]].any(axis=1)]] = True
            wave = np.flatnonzero(near & ~seen)
            seen[wave] = True
            edges.append(np.stack([np.full(len(wave), first), wave]))
    return np.concatenate(edges, axis=1)


def _tiles(families: DataFrame, width: int, tokens: int) -> DataFrame:
    """(id, family, i, j, side): each set in the tiles of its family that it belongs to; side 0: along the rows, 1: along the columns, 2: along both."""
    counts = families.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / width, F.sum("size") / tokens)).cast("int").alias("groups"))
    mine = F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")
    dealt = families.join(counts, "family").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return dealt.select("id", "family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"))


def _verified(texts: DataFrame, n: int, t: float, compare, tile, out: str, weights: DataFrame | None = None) -> DataFrame:
    """``compare(a, b, sets, weights)`` of the candidates of each cell, with their sets: a connected part of the candidates meets in one cell; a
    large part is dealt to groups, and a pair is compared in the cell of its two groups. ``tile`` of each tile of a family: see _tile. ``weights``: (id, weight) of each set."""
    if not 0.5 < t <= 1:
        raise ValueError("combinations of neighbours are complete for thresholds above 0.5")
    cands, families, ranges = candidates(texts, n, t)
    roots = components(cands)
    parts = cands.join(roots.select("root", F.col("node").alias("a")), "a", "left").withColumn("root", F.coalesce("root", "a"))
    parts = cut_lineage(parts)
    nodes = parts.select("root", F.col("a").alias("id")).union(parts.select("root", F.col("b").alias("id"))).distinct()
    size = nodes.groupBy("root").agg(F.count("*").alias("n")).join(parts.groupBy("root").agg(F.count("*").alias("m")), "root")
    groups = F.ceil(F.greatest(F.col("n") / LARGE_PART, F.sqrt(F.col("m") / LARGE_PAIRS)))
    big = size.select("root", groups.cast("int").alias("groups")).where("groups > 1")
    parts = parts.join(big, "root", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    group = lambda c: F.pmod(F.xxhash64(c), F.col("groups"))
    cells = max(4 * ranges, shuffle_width(texts.sparkSession))
    cell = F.pmod(F.xxhash64("root", F.least(group("a"), group("b")), F.greatest(group("a"), group("b"))), F.lit(cells)).cast("int")
    pairs = cut_lineage(parts.select("a", "b", cell.alias("cell")))
    ends = pairs.select(F.col("a").alias("id"), "cell").union(pairs.select(F.col("b").alias("id"), "cell")).distinct()
    wanted = bitmap(ends.select("id") if families is None else ends.select("id").union(families.select("id")))

    def sets(batches):
        seen: set[int] = set()
        for tokens, bounds in _token_sets(batches, n):
            ids = set_ids(tokens, bounds)
            low = (ids & U(8 * len(wanted) - 1)).astype(np.int64)
            some = np.flatnonzero((wanted[low >> 3] >> (7 - (low & 7)) & 1).astype(bool) & (np.diff(bounds) > 0))
            some = [d for d in some.tolist() if (i := int(ids[d])) not in seen and not seen.add(i)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some].view(np.int64)), pa.array([pack((steps(np.sort(tokens[bounds[d] : bounds[d + 1]] & _48)), 6)) for d in some], pa.binary())], names=["id", "blob"])

    blobs = texts.mapInArrow(sets, "id long, blob binary").groupBy("id").agg(F.first("blob").alias("blob"))
    blobs = blobs.withColumn("weight", F.lit(1).cast("long")) if weights is None else blobs.join(weights, "id")
    if families is not None:
        blobs = cut_lineage(blobs)
    dealt = blobs.join(ends, "id").select(F.col("cell").alias("in_cell"), "id", "blob", "weight")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").to_pylist()
        have = {i: np.cumsum(unpack(x, 6)[0], dtype=np.uint64) for i, x in zip(ids, _blobs(right))}
        return compare(left.column("a").to_numpy(), left.column("b").to_numpy(), have, dict(zip(ids, right.column("weight").to_pylist())))

    found = pairs.groupBy("cell").cogroup(dealt.groupBy("in_cell")).applyInArrow(run, out)
    if families is None:
        return found
    # every tile is a task's work, however few bytes it reads
    tiled = blobs.join(_tiles(families, TILE, TILE_TOKENS), "id").repartition(shuffle_width(texts.sparkSession), "family", "i", "j")
    return found.union(tiled.groupBy("family", "i", "j").applyInArrow(lambda x: tile(*_tile(x, t)), out))


def set_pairs(texts: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard): ids of distinct sets with a similarity of t or more, over a DataFrame with one column ``text``."""

    def compare(a, b, have, _):
        sims = np.fromiter((_similar(have[x], have[y], t) for x, y in zip(a.tolist(), b.tolist())), float, len(a))
        good = sims >= t - 1e-12
        return pa.table({"a": pa.array(a[good]), "b": pa.array(b[good]), "jaccard": pa.array(sims[good])})

    def tile(ids, _, rows, columns, sims, good):
        i, j = np.nonzero(good)
        return pa.table({"a": pa.array(ids[rows[i]]), "b": pa.array(ids[columns[j]]), "jaccard": pa.array(sims[i, j])})

    return _verified(texts, n, t, compare, tile, "a long, b long, jaccard double")


def set_links(texts: DataFrame, weights: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(a, b, links) for similar sets: the weight of all sets similar to a, as seen in one cell (b = a), and edges that connect whatever is similar
    (links = 0). Pairs are counted where they are found and go nowhere."""

    def compare(a, b, have, weight):
        good = np.fromiter((_similar(have[x], have[y], t) >= t - 1e-12 for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
        a, b = a[good], b[good]
        node, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        w = np.fromiter((weight[i] for i in node.tolist()), np.int64, len(node))
        i, j = number[: len(a)], number[len(a) :]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, w[j])
        np.add.at(links, j, w[i])
        tree = _forest(np.stack([a, b]), ("a", "b"))
        return pa.concat_tables([pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(node, pa.int64()), "links": pa.array(links)}), tree.append_column("links", pa.array(np.zeros(len(tree), np.int64)))])

    def tile(ids, weight, rows, columns, _, good):
        links = np.zeros(len(ids), np.int64)
        links[rows] += good @ weight[columns]
        links[columns] += weight[rows] @ good
        a, b = _stars(good, rows, columns, len(ids))
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(ids[np.append(some, a)]), "b": pa.array(ids[np.append(some, b)]), "links": pa.array(np.append(links[some], np.zeros(len(a), np.int64)))})

    return _verified(texts, n, t, compare, tile, "a long, b long, links long", weights)


def set_forest(texts: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(a, b): edges that connect whatever sets are similar. Pairs that are connected already aren't compared."""

    def compare(a, b, have, _):
        parent = {i: i for i in have}

        def top(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        edges = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = top(x), top(y)
            if p != q and _similar(have[x], have[y], t) >= t - 1e-12:
                parent[max(p, q)] = min(p, q)
                edges.append((x, y))
        one, two = zip(*edges) if edges else ([], [])
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    def tile(ids, _, rows, columns, __, good):
        a, b = _stars(good, rows, columns, len(ids))
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return _verified(texts, n, t, compare, tile, "a long, b long")


def _similar(a: np.ndarray, b: np.ndarray, t: float) -> float:
    if min(len(a), len(b)) < t * max(len(a), len(b)) - 1e-9:
        return 0.0
    return verify(a, b)


def _forest(edges: np.ndarray, columns: tuple[str, str]) -> pa.Table:
    """Each node's least reachable node, as edges (root, node)."""
    nodes, flat = np.unique(edges, return_inverse=True)
    parent = np.arange(len(nodes))
    i, j = flat.reshape(edges.shape)
    while True:
        low = np.minimum(parent[i], parent[j])
        before = parent.copy()
        np.minimum.at(parent, parent[i], low)
        np.minimum.at(parent, parent[j], low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        if (parent == before).all():
            break
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.table(dict(zip(columns, (pa.array(nodes[parent[moved]]), pa.array(nodes[moved])))))


#: Edges that one task merges; with more, stars are built until nothing changes.
ONE_TASK = 5_000_000


def components(pairs: DataFrame) -> DataFrame:
    """(root, node) for each node of the graph of pairs (a, b) but the least of its component, which is root."""

    def reduce(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            yield from _forest(np.stack([t.column(0).to_numpy(), t.column(1).to_numpy()]), ("a", "b")).to_batches()

    edges = cut_lineage(pairs.select("a", "b").mapInArrow(reduce, "a long, b long"))
    n = edges.count()
    while True:
        if n <= ONE_TASK:
            return edges.coalesce(1).mapInArrow(reduce, "a long, b long").select(F.col("a").alias("root"), F.col("b").alias("node"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours move to the least neighbour; small star: lesser ones and the node itself do
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.where("a <> b").select(F.col("b").alias("n"), F.col("a").alias("s"))
        low = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(low, "n").select(F.col("m").alias("a"), F.explode(F.array("n", "s")).alias("b")).where("a <> b").distinct()
        new = cut_lineage(small)
        total = new.count()
        if total == n and new.exceptAll(edges.select("a", "b")).isEmpty():
            return new.select(F.col("a").alias("root"), F.col("b").alias("node"))
        edges, n = new, total


def _members(docs: DataFrame, n: int) -> DataFrame:
    """(k, t, id): key and text hash of every document, and its set, null for one without words."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in chunks(texts):
                tokens, bounds = gram_sets(texts[lo:hi], n)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_ids(tokens, bounds).view(np.int64), mask=np.diff(bounds) == 0)], names=["k", "t", "id"])

    return docs.select(id_key(docs).alias("k"), F.xxhash64(text_of(docs)).alias("t"), text_of(docs).alias("text")).mapInArrow(run, "k long, t long, id long")


def jaccard_join(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, other_id, jaccard): all pairs of documents whose sets of word n-grams have similarity ``t`` or more, with
    documents of the same set standing together: the first document (least doc_id) of each set is paired with the first of
    every similar set, and with each other document of its own set (similarity 1). All pairs follow from these: two
    documents are similar if and only if the first ones of their sets are the same or paired, and their similarity is that one.

    doc_id < other_id in every row; pairs of rows with the same doc_id are left out, so repeated rows change nothing. Texts
    that are null, empty or without words have no set and no pair. Rows with a null doc_id are left out. Words are those of textvec;
    a text of fewer than n words has one gram. Other columns are not read. An empty table has no pairs."""
    ids = docs.where(docs["doc_id"].isNotNull())
    members = cut_lineage(_members(ids, n).select("k", "id").where("id is not null").distinct())
    first = members.groupBy("id").agg(F.min("k").alias("first"))
    same = members.join(first, "id").where("k > first").select(F.col("first").alias("doc_id"), F.col("k").alias("other_id"), F.lit(1.0).alias("jaccard"))
    pairs = set_pairs(ids.select(text_of(docs).alias("text")), n, t)
    named = pairs.join(first.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b").where("fa <> fb")
    return same.union(named.select(F.least("fa", "fb"), F.greatest("fa", "fb"), "jaccard"))


def jaccard_classes(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) for each document: a class is connected by similarities of ``t`` or more between sets of word n-grams and
    has the least doc_id of its documents; n_links counts the other documents that are similar to this one, those with the same set included.

    Each distinct doc_id and set is a document, so repeated rows change nothing, and rows of one doc_id with different texts are documents
    of their own (a doc_id then stands in several rows). Texts that are null, empty or without words are similar to nothing: a class of their own, no
    links. Rows with a null doc_id are left out. Other columns are not read. An empty table gives an empty one. No pair of documents is made:
    links are counted between sets, each with the number of its documents, where the sets are compared."""
    ids = docs.where(docs["doc_id"].isNotNull())
    every = cut_lineage(_members(ids, n).select("k", "id").distinct())
    members = every.where("id is not null")
    sizes = cut_lineage(members.groupBy("id").agg(F.count("*").alias("weight"), F.min("k").alias("least")))
    found = cut_lineage(set_links(ids.select(text_of(docs).alias("text")), sizes.select("id", "weight"), n, t))
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b")).select("root", F.col("node").alias("id"))
    known = cut_lineage(sizes.join(roots, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id")))
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    of_set = known.join(least, "root").select("id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    with_words = members.join(of_set, "id").select(F.col("k").alias("doc_id"), "class_id", "n_links")
    return with_words.union(every.where("id is null").select("k", "k", F.lit(0).cast("long")))


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near copies: of each group of documents connected by similarities of ``t`` or more, the one
    with the least doc_id stays (null comes first; of equal ids, that with the lesser text hash). Rows of equal doc_id and text
    are one document and stay once. Texts without words are in no group and stay. An empty table gives an empty one."""
    taken = set(docs.columns)
    k, th = fresh("_key", taken), fresh("_text_hash", taken)
    pairs = cut_lineage(set_forest(docs.select(text_of(docs).alias("text")), n, t))
    roots = components(pairs).select("root", F.col("node").alias("id"))
    members = _members(docs, n).where("id is not null").join(roots, "id", "left").withColumn("group", F.coalesce("root", "id"))
    members = cut_lineage(members.select("k", "t", "group"))
    keepers = members.groupBy("group").agg(F.min(F.struct("k", "t")).alias("first"))
    gone = members.join(keepers, "group").where(F.struct("k", "t") > F.col("first")).select(F.col("k").alias(k), F.col("t").alias(th))
    keyed = docs.withColumns({k: id_key(docs), th: F.xxhash64(text_of(docs))})
    return keyed.join(gone, [k, th], "left_anti").dropDuplicates([k, th]).select(*docs.columns)
