"""Personal data and secrets: a skip-chain conditional random field with loopy message passing."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import chunks
from .util import text_of

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "IBAN", "ID")
L = len(LABELS)
#: Labelled documents generated for training (a fixed number, from formats in this module), passes over them, and the generator's seed.
TRAINING_DOCS, EPOCHS, SEED = 1500, 8, 11
BUCKETS = 1 << 16
#: Message passing ends when no message changes by more. Every so many rounds in which that isn't reached, messages are damped more, so
#: many times; documents whose messages move even then are reported.
TOLERANCE, ROUNDS, DAMPING, DAMPED = 1e-4, 60, 0.3, 8
OUT = "doc_id long, label string, start long, end long, converged boolean"

# --- tokens and the graph -------------------------------------------------------------------------------------------------------

_INSIDE = re.compile(r"[+(]*\w(?:.*\w)?", re.S)


#: What is said before a secret, with a colon or an equals sign after it.
_KEY = re.compile(r"(?:^|[^a-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api.?key|key|auth\w*|credentials?|bearer|login)[\"']?\s*[:=]+$|^bearer$", re.I)


@functools.cache
def _digits_of_all_scripts() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Nd" for c in range(sys.maxunicode + 1)])


def open_tokens(text: str) -> list[tuple[int, int, str, str]]:
    """(number, place, token, word before): the tokens, runs without white space, that may bear a label other than O: those with a digit of
    any script, @ or =, those with eight capitals in a row, those of 16 characters or more with three changes from a small letter to a capital, and the one after a
    key word (such as ``password:``). All others are held at O; given that, the graph is cut there and no marginal changes. The word before is the
    last one that has a letter or digit, however far it is."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return []
    space = (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | ((codes >= 0x2000) & (codes <= 0x200B)) | (codes == 0x2028) | (codes == 0x2029) | (codes == 0x3000)
    hit = ((codes >= 48) & (codes <= 57)) | (codes == 64) | (codes == 61)
    wide = np.flatnonzero(codes > 0x65F)
    if len(wide):
        hit[wide] |= _digits_of_all_scripts()[codes[wide]]
    capital = (codes >= 65) & (codes <= 90)
    if capital.sum() >= 3:
        run = np.concatenate([[0], np.cumsum(capital)])
        full = np.flatnonzero(run[8:] - run[:-8] == 8)
        hit[full] = True
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    if not len(begins):
        return []
    opened = np.unique(np.searchsorted(begins, np.flatnonzero(hit), side="right") - 1).tolist()
    small = (codes >= 97) & (codes <= 122)
    rises = np.concatenate([[0], np.cumsum(np.concatenate([[False], small[:-1] & capital[1:]]))])
    opened += np.flatnonzero((ends - begins >= 16) & (rises[ends] - rises[begins] >= 3)).tolist()
    last = codes[ends - 1]
    said = np.flatnonzero((last == 58) | (last == 61) | ((ends - begins == 6) & ((last | 32) == 114))).tolist()  # the last: Bearer
    for n in said:
        if n + 1 < len(begins) and ends[n] - begins[n] <= 64:
            whole = text[begins[n] : ends[n]]
            if whole.strip(":=") == "" and n:
                whole = text[begins[n - 1] : ends[n - 1]] + whole
            if _KEY.search(whole):
                opened.append(n + 1)
    out = []
    for n in sorted(set(opened)):
        before = ""
        for k in range(n - 1, -1, -1):
            before = text[begins[k] : ends[k]]
            if _WORD.search(before):
                break
        out.append((n, int(begins[n]), text[begins[n] : ends[n]], before if _WORD.search(before) else ""))
    return out


_WORD = re.compile(r"\w")


def core(token: str) -> tuple[int, str]:
    """The token without punctuation at its ends (an opening + or parenthesis stays), and where that begins."""
    m = _INSIDE.search(token)
    return (m.start(), m.group()) if m else (0, token)


def shape(s: str) -> str:
    """Characters by kind, runs shortened to one."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a", s)
    return re.sub(r"\d+", "9", s)


def _bucket(s: str) -> int:
    h = 1469598103934665603
    for c in s.encode("utf-8", "surrogatepass"):
        h = (h ^ c) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) & (BUCKETS - 1)


_MEMO: dict[str, int] = {}


def bucket(s: str) -> int:
    got = _MEMO.get(s)
    if got is None:
        if len(_MEMO) > 200_000:
            _MEMO.clear()
        got = _MEMO[s] = _bucket(s)
    return got


def _traits(token: str) -> list[str]:
    c = core(token)[1]
    digits = sum(x.isdigit() for x in c)
    lengths = re.sub(r"\d+", lambda m: f"9{min(len(m.group()), 20)}", re.sub(r"[^\W\d_]+", "a", c))
    out = ["s:" + shape(c)[:24], "l:" + lengths[:32], f"n:{min(len(c), 48) // 4}", f"d:{min(digits, 24)}"]
    if len(c) >= 8:  # how it begins, character by character
        out.append("h:" + re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", c[:4])))
    if re.fullmatch(r"[^\s@]+@[\w-]+(\.[\w-]+)+", c):
        out.append("mail")
    if ":" in c and c.count(":") >= 2 and re.fullmatch(r"[0-9a-fA-F:]+(?:%\w+)?", c):
        out.append("ip6" if "::" in c or c.count(":") == 7 else "mac" if c.count(":") == 5 else "ip6?")
    if re.fullmatch(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{4}){2,7}[A-Z0-9]{0,3}", c):
        out.append("iban")
    elif re.fullmatch(r"[A-Z0-9]{16,}", c) and not c.isdigit():
        out.append("upper")
    elif re.fullmatch(r"[A-Z]{2}\d{2}", c):
        out.append("iban?")
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", c):
        out.append("ssn")
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", c):
        out.append("ip" if all(int(x) < 256 for x in c.split(".")) else "ip?")
    if re.fullmatch(r"[0-9a-fA-F]{16,}", c) and not c.isdigit():
        out.append("hex")
    if re.fullmatch(r"[\w+/=-]{20,}", c) and digits and any(x.isalpha() for x in c):
        out.append("opaque")
    if c.isdigit() and 13 <= len(c) <= 19:
        out.append("long number")
    if "=" in c or ":" in c and c.count(":") < 2:
        key, _, value = re.sub(r"[\"']", "", c).replace(":", "=").partition("=")
        if value:
            out += ["key:" + key.lower(), f"value:{min(len(value), 40) // 6}:{bool(digits)}"]
    if "(" in token or token.startswith("+"):
        out.append("opens:" + re.sub(r"\w", "", token)[:4])
    return out


def _features(words: list[str], traits: list[list[str]]) -> list[int]:
    """Of a token: its own traits, and those of its neighbours, which are open tokens or closed words."""
    before, _, after = words
    f = ["b"] + traits[1]
    f += ["<" + x for x in traits[0][:2]] if traits[0] else ["<" + before.lower().strip("\"'.,;:")] + ["<key"] * bool(_KEY.search(before)) if before else ["<"]
    f += [">" + x for x in traits[2][:2]] if traits[2] else [">"]
    f += [f"{traits[1][0]}|{x}" for x in f[len(traits[1]) + 1 :] if x[0] == "<"]
    return [bucket(x) for x in f]


@dataclass
class Graph:
    """Open tokens of some documents, joined to one graph: neighbours in the text, each repeated token to its first in the
    document, and each new token to the one before that is like it."""

    doc: list[int] = field(default_factory=list)
    number: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    token: list[str] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    #: (kind, one end, other end); kinds: 0 neighbours, 1 repeated, 2 similar
    edges: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, doc: int, text: str) -> None:
        found = open_tokens(text)
        if not found:
            return
        base = len(self.doc)
        traits = [_traits(x[2]) for x in found]
        at = {x[0]: k for k, x in enumerate(found)}
        repeated: dict[str, int] = {}
        alike: dict[str, int] = {}
        for k, (n, place, token, before) in enumerate(found):
            i = base + k
            p, q = at.get(n - 1), at.get(n + 1)
            if p is not None:
                before = found[p][2]
                if before == "=":  # "key = value"
                    before, p = found[p][3] + "=", None
            elif text[:place].rstrip().endswith((":", "=")) and not before.endswith((":", "=")):
                before += ":"
            self.doc.append(doc)
            self.number.append(n)
            self.place.append(place)
            self.token.append(token)
            self.features.append(_features([before, token, ""], [[] if p is None else traits[p], traits[k], [] if q is None else traits[q]]))
            if at.get(n - 1) is not None:
                self.edges.append((0, i - 1, i))
            c = core(token)[1].lower()
            if len(c) > 2:
                if c in repeated:
                    self.edges.append((1, repeated[c], i))
                else:
                    s = shape(c) + str(min(len(c), 16))
                    if s in alike:
                        self.edges.append((2, alike[s], i))
                    alike[s] = i
                    repeated[c] = i  # the first: all that repeat it are two edges apart at most


# --- the model ------------------------------------------------------------------------------------------------------------------


class Model:
    """Log potentials: of features and labels, and for each kind of edge of the labels at its ends."""

    def __init__(self):
        self.unary = np.zeros((BUCKETS, L), np.float32)
        self.edge = np.zeros((3, L, L))
        self.edge_seen = np.full((3, L, L), 1e-3)
        self.seen = np.full((BUCKETS, 1), 1e-3, np.float32)

    def marginals(self, g: Graph):
        """Beliefs of nodes and of edges, by loopy sum-product with all messages sent at once; last, the nodes whose messages still move."""
        n = len(g.doc)
        flat = np.concatenate([np.asarray(f) for f in g.features])
        counts = np.array([len(f) for f in g.features])
        score = np.add.reduceat(self.unary[flat], np.cumsum(counts) - counts).astype(float)
        if not g.edges:
            e = np.exp(score - score.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True), np.zeros((0, L, L)), flat, counts, np.zeros(n, bool)
        kind, a, b = np.array(g.edges).T
        psi = self.edge[kind]
        m = len(kind)
        # messages 0..m-1 go from a to b, the others back
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([psi, psi.transpose(0, 2, 1)])
        msg = np.zeros((2 * m, L))
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        damping = DAMPING
        for k in range(ROUNDS * DAMPED):
            if k and k % ROUNDS == 0:
                damping = (1 + damping) / 2
            total = score.copy()
            np.add.at(total, target, msg)
            out = total[source] - msg[back]
            x = out[:, :, None] + pot
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - msg).max(axis=1)
            if change.max() < TOLERANCE:
                msg = new
                break
            msg = damping * msg + (1 - damping) * new
        moving = np.zeros(n, bool)
        np.logical_or.at(moving, target, change >= TOLERANCE)
        total = score.copy()
        np.add.at(total, target, msg)
        node = np.exp(total - total.max(axis=1, keepdims=True))
        node /= node.sum(axis=1, keepdims=True)
        pair = (total[a] - msg[m:])[:, :, None] + (total[b] - msg[:m])[:, None, :] + psi
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        return node, pair / pair.sum(axis=(1, 2), keepdims=True), flat, counts, moving

    def step(self, g: Graph, gold: np.ndarray, rate: float) -> None:
        """A step up the likelihood: labels as given less labels as expected, each parameter with its own step size."""
        node, pair, flat, counts, _ = self.marginals(g)
        diff = (np.eye(L)[gold] - node).astype(np.float32)
        rows = np.repeat(diff, counts, axis=0)
        grad = np.zeros((len(u := np.unique(flat)), L), np.float32)
        np.add.at(grad, np.searchsorted(u, flat), rows)
        self.seen[u] += (grad * grad).mean(axis=1, keepdims=True)
        self.unary[u] += rate * (grad / np.sqrt(self.seen[u]) - 1e-3 * self.unary[u])
        if len(pair):
            kind, a, b = np.array(g.edges).T
            want = np.zeros_like(pair)
            want[np.arange(len(kind)), gold[a], gold[b]] = 1
            total = np.zeros_like(self.edge)
            np.add.at(total, kind, want - pair)
            self.edge_seen += total * total
            self.edge += rate * (total / np.sqrt(self.edge_seen) - 1e-3 * self.edge)

    def labels(self, g: Graph) -> np.ndarray:
        return self.judged(g)[0]

    def judged(self, g: Graph) -> tuple[np.ndarray, set[int]]:
        """The most probable label of each token, and the documents in which messages still move."""
        if not g.doc:
            return np.zeros(0, np.int64), set()
        node, *_, moving = self.marginals(g)
        return node.argmax(axis=1), {g.doc[i] for i in np.flatnonzero(moving)}


# --- training documents ---------------------------------------------------------------------------------------------------------


def _word(r) -> str:
    return "".join(r.choice(list("aeiounrtslhdmécgüñ"), r.integers(2, 10)))


def _digits(r, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _hex(r, n: int) -> str:
    return "".join(r.choice(list("0123456789abcdef"), n))


def _of(r, *makers):
    return makers[r.integers(len(makers))]()


def _entity(r, label: str) -> str:
    w = lambda: re.sub(r"[^a-z]", "x", _word(r))
    if label == "EMAIL":
        host = _of(r, lambda: f"mail{r.integers(10)}.example", w, lambda: w() + "." + w(), lambda: w() + "-" + w(), lambda: f"{w()}{r.integers(100)}")
        return _of(r, w, lambda: f"{w()}.{w()}", lambda: f"{w()}{r.integers(100)}", lambda: f"{w()}.{r.integers(100)}", lambda: f"{w()}_{r.integers(2000)}+{w()}").capitalize() + f"@{host}.{r.choice(['com', 'org', 'net', 'de', 'io', 'fr', 'edu', 'co.uk', 'info'])}"
    if label == "PHONE":
        return _of(r, lambda: f"+1 ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", lambda: f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", lambda: f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", lambda: f"+{r.integers(20, 99)} {_digits(r, 3)} {_digits(r, 7)}", lambda: f"+{r.integers(1, 99)}{_digits(r, 10)}", lambda: f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 4)}", lambda: f"0{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", lambda: f"0{_digits(r, 4)} {_digits(r, 6)}", lambda: f"+{r.integers(20, 99)} {_digits(r, int(r.integers(1, 4)))} {_digits(r, int(r.integers(5, 9)))}", lambda: f"+{r.integers(20, 99)} {r.integers(1, 9)} " + " ".join(_digits(r, 2) for _ in range(4)), lambda: f"0{_digits(r, 2)}/{_digits(r, 7)}")
    if label == "IBAN":
        n = "".join(r.choice(list("ABDEFGHILNOPRST"), 2)) + _digits(r, 2) + (_digits(r, int(r.integers(11, 21))) if r.random() < 0.7 else "".join(r.choice(list("ABCDEFGHKLMNOPQRSTUVWXYZ"), 4)) + _digits(r, int(r.integers(8, 15))))
        return n if r.random() < 0.6 else " ".join(n[i : i + 4] for i in range(0, len(n), 4))
    if label == "ID":
        return _of(r, lambda: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", lambda: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", lambda: f"SSN {_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", lambda: f"SSN: {_digits(r, 9)}", lambda: f"passport {r.choice(list('ABCDEFGHKLMNPRSTUVWXYZ'))}{_digits(r, 8)}")
    if label == "IP" and r.random() < 0.3:
        parts = [_hex(r, int(r.integers(1, 5))) for _ in range(8)]
        return _of(r, lambda: ":".join(parts), lambda: "::".join([":".join(parts[: r.integers(1, 4)]), ":".join(parts[: r.integers(1, 4)])]))
    if label == "IP":
        return ".".join(str(x) for x in r.integers(0, 256, 4))
    if label == "CARD":
        n = _digits(r, int(r.choice([13, 15, 16, 16, 16, 16, 19])))
        return _of(r, lambda: n, lambda: n, lambda: " ".join(n[i : i + 4] for i in range(0, 16, 4)) if len(n) >= 16 else n, lambda: "-".join(n[i : i + 4] for i in range(0, 16, 4)) if len(n) >= 16 else n)
    key = str(r.choice(["token", "secret", "api_key", "password", "passwd", "access_token", "auth_token", "passphrase", "pwd", "secret_key", "Password"]))
    up = lambda k: "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), k))
    mixed = lambda k: "".join(r.choice(list("abcdefghijklmnopABCDEFGHIJKLMNOP0123456789"), k))
    letters = lambda k: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), k))
    plain = lambda: w() + w() + _of(r, str, w)
    value = _of(r, lambda: _hex(r, int(r.choice([18, 24, 32, 40, 64]))), lambda: mixed(int(r.integers(16, 41))), lambda: mixed(int(r.integers(6, 16))), plain, plain, lambda: w() + str(r.choice(list("!#$%&-_"))) + _digits(r, int(r.integers(0, 5))) + w())
    named = (lambda: f'{key} = "{value}"', lambda: f"{key}={value}", lambda: f"{key}: {value}", lambda: f'{key}: "{value}"')
    return _of(r, *named, *named, lambda: "AKIA" + up(16), lambda: "AKIA" + up(16), lambda: "ghp_" + mixed(36), lambda: "Bearer " + (mixed, letters)[r.integers(2)](int(r.integers(20, 60))), lambda: f"ey{mixed(20)}.{mixed(40)}.{mixed(30)}", lambda: str(r.choice(["sk", "pk", "xoxb"])) + "-" + mixed(int(r.integers(20, 40))), lambda: _hex(r, int(r.choice([32, 40, 64]))), lambda: letters(int(r.integers(28, 44))))


def _distractor(r) -> str:
    i = lambda a, b: str(r.integers(a, b))
    return _of(
        r, lambda: i(0, 2100), lambda: i(1, 30) + ".", lambda: f"{i(0, 9)}.{i(0, 99)}", lambda: f"v{i(0, 9)}.{i(0, 20)}.{i(0, 30)}", lambda: f"{i(0, 9)}.{i(0, 20)}.{i(0, 30)}",
        lambda: f"{i(1990, 2030)}-{i(10, 13)}-{i(10, 29)}", lambda: f"{i(10, 24)}:{i(10, 60)}:{i(10, 60)}", lambda: f"${i(1, 2000)}.{i(10, 99)}", lambda: f"#{i(100, 99999)}", lambda: f"{i(1, 99)}-{i(1, 99)}",
        lambda: f"{i(1, 99)},{_digits(r, 3)}", lambda: f"{i(1, 9)}x{i(1, 9)}", lambda: f"{i(1, 30)}th", lambda: f"{_word(r)}={_word(r)}", lambda: f"n={i(0, 100)}", lambda: f"@{_word(r)}", lambda: f"{_word(r)}{i(0, 99)}", lambda: f"({i(1990, 2030)})",
        lambda: f"+{i(1, 30)}", lambda: f"{i(0, 100)}%", lambda: "=" * int(r.integers(1, 9)), lambda: "".join(r.choice(list("ABCDEFGHIKLMNORSTU"), int(r.integers(8, 14)))), lambda: f"({i(100, 999)})", lambda: _digits(r, int(r.integers(5, 9))), lambda: f"a = {i(0, 50)}", lambda: f"key: {_word(r)}", lambda: f"key: {_word(r)}", lambda: f"pin: {_word(r)}", lambda: f"{_word(r)}: {_word(r)}", lambda: f"login: {i(1, 31)}", lambda: f"{i(1, 13)}/{i(1, 29)}/{i(1980, 2030)}", lambda: f"{i(1, 24)}:{i(10, 60)}", lambda: "".join(_word(r).capitalize() for _ in range(4)), lambda: f"{i(1, 9)},{_digits(r, 3)},{_digits(r, 3)}", lambda: f"978-{i(0, 9)}-{_digits(r, 4)}-{_digits(r, 4)}-{i(0, 9)}", lambda: f"{str(r.choice(list('ABCDEFG')))}{i(1, 99)}", lambda: f"{i(1, 99)}:{i(1, 99)}", lambda: f"{i(1, 30)}.{i(1, 30)}.",
    )


def generate(seed: int, docs: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts and their (start, end, label): invented prose with numbers that mean nothing, and entities, some of which come again later."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(docs):
        noise = ["", "###", "&&&", "***", "$$$", "%%%"] if r.random() < 0.2 else ["", "", "", "", ".", ","]
        pool = [(e := str(r.choice(LABELS[1:])), _entity(r, e)) for _ in range(r.integers(0, 6))]
        items = [(label, text) for label, text in pool for _ in range(1 + int(r.integers(0, 3)) * int(r.random() < 0.4))]
        items += [("O", _distractor(r)) for _ in range(r.integers(0, 14))]
        r.shuffle(items)
        text, spans = "", []
        for label, item in items:
            text += "".join(_word(r) + str(r.choice(noise)) + " " for _ in range(r.integers(0, 6)))
            if label != "O":
                spans.append((len(text), len(text) + len(item), str(label)))
            text += str(item) + str(r.choice(noise)) + str(r.choice([" ", " ", " ", "\n"]))
        out.append((text + _word(r), spans))
    return out


def gold_labels(g: Graph, spans_of: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Labels of a graph's tokens: that of the span a token overlaps. Of secrets named by a key, it is the value that counts: a lone
    sign between key and value is none."""
    out = np.zeros(len(g.doc), np.int64)
    for i, (d, place, token) in enumerate(zip(g.doc, g.place, g.token)):
        for a, b, label in spans_of[d]:
            if a < place + len(token) and place < b and token != "=":
                out[i] = LABELS.index(label)
    return out


def train(docs: int = TRAINING_DOCS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model fitted to ``docs`` generated documents; their number doesn't depend on the corpus."""
    made = generate(seed, docs)
    batches = []
    for lo in range(0, docs, 30):
        g = Graph()
        for d, (text, _) in enumerate(made[lo : lo + 30]):
            g.add(d, text)
        if g.doc:
            batches.append((g, gold_labels(g, [s for _, s in made[lo : lo + 30]])))
    model, rng = Model(), np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            model.step(*batches[k], rate=0.25 * (1 - 0.8 * epoch / epochs))
    model.unary = model.unary.astype(np.float16)  # what the tasks are sent
    model.seen = model.edge_seen = None
    return model


# --- documents ------------------------------------------------------------------------------------------------------------------


def entities(model: Model, texts: list[str]) -> list[tuple[int, str, int, int, bool]]:
    """(text number, label, start, end, whether the messages of the text came to rest); neighbours of the same label are one entity where the label may spread over tokens."""
    g = Graph()
    for d, text in enumerate(texts):
        g.add(d, text)
    out: list[tuple[int, str, int, int, bool]] = []
    last = None
    labels, moving = model.judged(g)
    for i, y in enumerate(labels):
        if y == 0:
            continue
        skip, c = core(g.token[i])
        start = g.place[i] + skip
        row = (g.doc[i], LABELS[y], start, start + len(c), g.doc[i] not in moving)
        if last == (g.doc[i], g.number[i] - 1, y) and LABELS[y] in ("PHONE", "CARD", "IBAN"):
            out[-1] = (*out[-1][:3], *row[3:])
        else:
            out.append(row)
        last = (g.doc[i], g.number[i], y)
    return out


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, start, end, converged): entities of each document, in characters from 0, end exclusive; documents without any have no row.

    Labels are those of LABELS: mail addresses, telephone numbers, IP addresses of both kinds, card numbers, secrets, bank account numbers (IBAN) and
    numbers of persons and passports. Names and postal addresses have no label. A token is a run without white space; entities leave out punctuation at its ends.
    Which tokens can bear a label at all is said at ``open_tokens``: a secret of letters only is found after a key word, not elsewhere.

    Null and empty texts have no entity. Texts are read whole; a document's tokens make one graph, in which those of a repeated token are
    joined to its first, so evidence at one is two edges from any other. ``converged`` is false for documents in which
    messages didn't come to rest (see ROUNDS); their labels are those of the last messages. Each row of docs is judged by itself: repeated rows
    repeat their entities; a null doc_id is carried along. Other columns are not read; an empty table has no entities. ``model``: by default one trained on the
    driver (see ``train``), a few MB whatever the corpus. Documents are not shuffled."""
    model = model or train()

    def run(batches):
        for b in batches:
            ids, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for lo, hi in chunks(texts):
                rows += [(ids[lo + d], *rest) for d, *rest in entities(model, texts[lo:hi])]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "label", "start", "end", "converged"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, OUT)
