"""Edit-aware token counts: segment trees over pre-tokens, of which an edit re-encodes only the part that it touches."""

from __future__ import annotations

import base64
import functools
import importlib.util
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import text_of

#: Folder of vocabulary files, and the ranks used.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Splits text into pre-tokens, which are encoded one by one. It looks at most LOOKAHEAD characters beyond a pre-token's end and never
#: back, so a pre-token that ends earlier than that before an edit stays.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOKAHEAD = 2
#: Pre-tokens in a leaf of a new tree; a leaf that grows to 8 times that makes the tree be built anew.
LEAF = 64
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
#: Pre-tokens whose counts a Python worker remembers.
REMEMBERED = 400_000
_split = regex.compile(PATTERN)


@functools.cache
def _encoding(folder: str):
    import tiktoken

    if not Path(folder, RANKS).exists() and (spec := importlib.util.find_spec("public_tokenizers")):
        folder = str(Path(spec.origin).parent)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, RANKS).read_bytes().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Token counts of pre-tokens, made when first asked for."""

    def __init__(self, folder: str = TOKENIZERS):
        super().__init__()
        self.encoding = _encoding(folder)

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))


def _sums(leaves: np.ndarray) -> np.ndarray:
    """Heap of subtree sums; the leaves stand at the end, padded to a power of two."""
    width = 1 << max(0, len(leaves) - 1).bit_length()
    tree = np.zeros(2 * width, np.int64)
    tree[width : width + len(leaves)] = leaves
    while width > 1:
        tree[width // 2 : width] = tree[width : 2 * width].reshape(-1, 2).sum(axis=1)
        width //= 2
    return tree


class Tree:
    """Segment tree of one document. A leaf holds some consecutive pre-tokens: their text, their lengths and their token counts;
    inner nodes hold sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.encoded = 0  # pre-tokens encoded since the tree was made
        pieces = _split.findall(text)
        self._build(text, [len(p) for p in pieces], counter.counts(pieces))

    def _build(self, text: str, lengths, tokens) -> None:
        lengths, tokens = np.asarray(lengths, np.int64), np.asarray(tokens, np.int64)
        cuts = np.arange(0, len(lengths), LEAF)
        ends = np.cumsum(lengths)
        begin = (ends - lengths)[cuts].tolist() + [len(text)]
        self.texts = [text[a:b] for a, b in zip(begin, begin[1:])] or [""]
        self.lengths = [lengths[a : a + LEAF] for a in cuts] or [lengths]
        self.tokens = [tokens[a : a + LEAF] for a in cuts] or [tokens]
        self.chars = _sums(np.add.reduceat(lengths, cuts) if len(cuts) else np.zeros(1, np.int64))
        self.sums = _sums(np.add.reduceat(tokens, cuts) if len(cuts) else np.zeros(1, np.int64))

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.texts)

    def to_columns(self) -> tuple[str, bytes, bytes]:
        """Text, and lengths and counts of its pre-tokens as 32-bit integers: what a table keeps of the tree."""
        return self.text(), np.concatenate(self.lengths).astype("<u4").tobytes(), np.concatenate(self.tokens).astype("<u4").tobytes()

    @classmethod
    def from_columns(cls, text: str, lengths: bytes, tokens: bytes, counter: Counter) -> Tree:
        """The tree that to_columns wrote; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded = counter, 0
        tree._build(text, np.frombuffer(lengths, "<u4"), np.frombuffer(tokens, "<u4"))
        return tree

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with text, for the end) and the place where it begins."""
        node, begin, width = 1, 0, len(self.chars) // 2
        at = min(at, self.n_chars - 1)
        while node < width:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        return node - width, begin

    def _put(self, leaf: int, text: str, lengths, tokens) -> None:
        self.texts[leaf], self.lengths[leaf], self.tokens[leaf] = text, np.asarray(lengths, np.int64), np.asarray(tokens, np.int64)
        node = len(self.chars) // 2 + leaf
        self.chars[node], self.sums[node] = self.lengths[leaf].sum(), self.tokens[leaf].sum()
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start:end. Bounds beyond the text are moved to its ends; an end before start counts as start."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if start == end and not new:
            return
        if not self.n_chars:
            pieces = _split.findall(new)
            self.encoded += len(pieces)
            self._build(new, [len(p) for p in pieces], self.counter.counts(pieces))
            return
        # pre-tokens that end too early to see the edit stay; the first that may see it is where encoding begins
        first, begin = self._leaf(max(0, start - LOOKAHEAD - 1))
        ends = begin + np.cumsum(self.lengths[first])
        keep = int(np.searchsorted(ends, start - LOOKAHEAD, side="left"))
        at = begin if keep == 0 else int(ends[keep - 1])
        # old text from there, grown by leaves until a new pre-token begins beyond the edit where an old one began
        last, reach = self._leaf(end)
        olds = [self.texts[i] for i in range(first, last + 1)]
        held = reach + len(self.texts[last])
        shift = len(new) - (end - start)
        while True:
            old = "".join(olds)[at - begin :]
            whole = old[: start - at] + new + old[end - at :]
            lengths = np.concatenate([self.lengths[i] for i in range(first, last + 1)])[keep:]
            places = at + np.concatenate([[0], np.cumsum(lengths)])
            known = set((places[places >= end] + shift).tolist())
            final = held == self.n_chars
            pieces, p, meet = [], at, None
            for m in _split.finditer(whole):
                if m.start() + at in known and m.start() + at >= end + shift and m.start() >= start - at + len(new):
                    meet = m.start() + at
                    break
                pieces.append(m.group())
                p = m.end() + at
            # a pre-token near the end of what is held might go on in the next leaf
            if meet is None and final:
                meet = p
            if meet is not None and (final or meet - at + LOOKAHEAD < len(whole)):
                break
            last += 1
            olds.append(self.texts[last])
            held += len(self.texts[last])
        rest = int(np.searchsorted(places, meet - shift, side="left"))
        self.encoded += len(pieces)
        tokens = np.concatenate([self.tokens[i] for i in range(first, last + 1)])[keep:]
        new_lengths = np.concatenate([self.lengths[first][:keep], np.fromiter(map(len, pieces), np.int64, len(pieces)), lengths[rest:]])
        new_tokens = np.concatenate([self.tokens[first][:keep], np.array(self.counter.counts(pieces), np.int64), tokens[rest:]])
        text = "".join(olds)[: at - begin] + whole
        for leaf in range(first + 1, last + 1):
            self._put(leaf, "", [], [])
        self._put(first, text, new_lengths, new_tokens)
        if len(new_lengths) > 8 * LEAF:
            self._build(self.text(), np.concatenate(self.lengths), np.concatenate(self.tokens))


TREE = "doc_id long, text string, lengths binary, tokens binary, n_tokens long"


def build_trees(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text, lengths, tokens, n_tokens): each document's pre-tokens and their counts, from which ``apply_edits`` makes its
    segment tree again without encoding. Null and empty texts have no pre-token and 0 tokens. A null doc_id is carried along;
    repeated rows have a tree each."""

    def run(batches):
        counter = Counter(folder)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = []
                for text in part.column(1).to_pylist():
                    pieces = _split.findall(text)
                    n = np.array(counter.counts(pieces), "<u4")
                    out.append((np.fromiter(map(len, pieces), "<u4", len(pieces)).tobytes(), n.tobytes(), int(n.sum())))
                a, t, n = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a, pa.binary()), pa.array(t, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "text", "lengths", "tokens", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, TREE)


def apply_edits(trees: DataFrame, edits: str = "edits", folder: str = TOKENIZERS) -> DataFrame:
    """Apply each row's ``edits`` (an array of start, end, text; in order, each against the text that the ones before left) to its tree.

    Returns the columns of ``build_trees`` for the new text, with n_before, the count before, and n_encoded, the pre-tokens that
    were encoded. A null bound or text reads as 0 or empty, a null array or element as no edit. Trees without edits pass unchanged."""

    def run(batches):
        counter = Counter(folder)
        for b in batches:
            rows = []
            for doc, text, lengths, tokens, n, todo in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "lengths", "tokens", "n_tokens", edits))):
                tree = None
                for e in todo or ():
                    if e is not None:
                        tree = tree or Tree.from_columns(text, lengths, tokens, counter)
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((doc, text, lengths, tokens, n, n, 0) if tree is None else (doc, *tree.to_columns(), tree.n_tokens, n, tree.encoded))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "text", "lengths", "tokens", "n_tokens", "n_before", "n_encoded"])

    return trees.mapInArrow(run, TREE + ", n_before long, n_encoded long")


def edited_counts(docs: DataFrame, edits, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_before, n_tokens, n_encoded) of every document before and after edits: ``edits`` is a column of docs' rows (EDITS), so that
    documents are read once and nothing is shuffled. Texts are read whole.

    Null and empty texts have 0 tokens before. A null bound or text of an edit reads as 0 or empty, a null array or element as no edit; bounds beyond the text
    are cut to it. Each row of docs is counted by itself: repeated rows repeat their counts, a null doc_id is carried along. Other columns are not
    read; an empty table gives an empty one. ``folder`` holds the vocabulary. Trees are made once and brought up to date by each edit; n_encoded of the edits' pre-tokens were encoded, all else kept."""

    def run(batches):
        counter = Counter(folder)
        for b in batches:
            rows = []
            for doc, text, todo in zip(*(b.column(k).to_pylist() for k in range(3))):
                t = Tree(text, counter)
                before = t.n_tokens
                for e in todo or ():
                    if e is not None:
                        t.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((doc, before, t.n_tokens, t.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "n_before", "n_tokens", "n_encoded"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), edits.cast(EDITS).alias("edits")).mapInArrow(run, "doc_id long, n_before long, n_tokens long, n_encoded long")


def house_edits(docs: DataFrame):
    """The edits of the registered query, as a column: a line with the source is put before the text, forty characters in the middle
    go, and a newline is added at the end."""
    n = F.length(text_of(docs)).cast("long")
    head = F.concat(F.coalesce(docs["source"].cast("string"), F.lit("")), F.lit("\n"))
    h = F.length(head).cast("long")
    middle = F.floor(n / 2) + h
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), t.alias("text"))
    cut = F.least(F.lit(40).cast("long"), n + h - middle)
    return F.array(edit(F.lit(0), F.lit(0), head), edit(middle, middle + cut, F.lit("")), edit(n + h - cut, n + h - cut, F.lit("\n")))
