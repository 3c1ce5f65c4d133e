"""Personal data: fixed rules, and a skip-chain conditional random field that makes labels consistent across a document.

Base spans come from the rules (email, ip, card, phone), leftmost and non-overlapping for each kind. The field's
nodes are the base spans and whatever could be another mention of one: numbers of 7 to 19 digits with signs between them, words
around an @, (at) or [at], and words that are the part before the @ of an address in the document. Its potentials are
  node:    weights of the shape of the mention,
  chain:   the next node, at most GAP bytes on,
  same:    the next node with the same digits or the same part before the @, and a base span with them, however far,
  similar: likewise nodes whose digits differ in one place (one put in, left out or changed) or end in the same seven.
Nodes of base spans keep their label; loopy sum-product messages give the marginals of the others, and one
that reaches the threshold becomes an added span. All weights, those of the edges too, are fitted by pseudo-likelihood on
labelled samples: words of a bounded sample of documents with entities planted among them, later mentions of these in
forms that the rules miss, and numbers and words that mean nothing.

Defined cases: null and empty texts have no spans; very long texts are scanned whole, in linear time; offsets are code
points; repeated rows are scanned each; of labels that tie the first by kind is taken; other columns are ignored, whatever
their names; empty tables give empty tables.
"""

from __future__ import annotations

import bisect
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import spans as S
from quadloom.llm import text as X

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(rb"[^\x20\t-\r]+")
NUMBER = re.compile(rb"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])+")
MARKS = re.compile(rb"@|\(at\)|\[at\]")
TRIM = b".,;:!?()[]{}<>\"'|"
THRESHOLD, ROUNDS, GAP = 0.9, 12, 40
#: Documents whose words surround the planted entities, planted texts, and steps of the fit.
SAMPLE_DOCS, PLANTED, STEPS, RATE = 200, 600, 2000, 1.0
N_FEATURES, EDGES = 15, 3
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = d - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(raw: bytes) -> list[tuple[int, int]]:
    """Each match holds the first @ after its start, so the search goes from @ to @."""
    out, done, at = [], 0, raw.find(b"@")
    while at >= 0:
        a = at
        while a > done and raw[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(raw, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        at = raw.find(b"@", max(at + 1, done))
    return out


def _digits(raw: bytes, a: int, b: int) -> bytes:
    return bytes(c for c in raw[a:b] if 48 <= c < 58)


def base_spans(raw: bytes, digits: bool = True) -> list[tuple[str, int, int]]:
    """All base spans of one text in bytes, by kind and start. digits: whether it holds any digit."""
    out = [("email", a, b) for a, b in _emails(raw)] if b"@" in raw else []
    if digits:
        if raw.count(b".") >= 3:
            out += [("ip", *m.span()) for m in IP.finditer(raw) if all(len(p := g.lstrip(b"0")) < 3 or len(p) == 3 and p <= b"255" for g in m.groups())]
        out += [("card", a, b) for a, b in (m.span() for m in CARD.finditer(raw)) if b - a >= 13 and 13 <= len(d := _digits(raw, a, b)) <= 19 and luhn(d)]
        if b"+" in raw:
            out += [("phone", a, b) for a, b in (m.span() for m in PHONE.finditer(raw)) if 9 <= len(_digits(raw, a, b)) <= 15]
    return out


def _features(t: bytes) -> list[float]:
    n, d = len(t), sum(48 <= c < 58 for c in t)
    m = MARKS.search(t)
    letters = any(65 <= c < 91 or 97 <= c < 123 for c in t)
    return [1.0, m is not None, m is not None and b"." in t[m.end() :], m is not None and m[0] == b"@", 7 <= d <= 8, 9 <= d <= 12, 13 <= d <= 19, d / n, t.count(b".") == 3, t.count(b"-") == 3, t[:1] == b"+", b"(" in t, b" " in t, d == n, letters and m is None]


def _keys(t: bytes) -> tuple[list[bytes], list[bytes]]:
    """What mentions of the same thing share, and what those of a similar one do."""
    m = MARKS.search(t)
    if m or not any(48 <= c < 58 for c in t[-1:]):
        return [b"w" + (t[: m.start()].strip() if m else t).lower()], []
    d = _digits(t, 0, len(t))
    one = {d[:i] + d[i + 1 :] for i in range(len(d))} | {d} if len(d) >= 9 else set()
    return [b"d" + d], [b"x" + k for k in sorted(one)] + [b"e" + d[-7:]]


def _mentions(raw: bytes, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Where base spans and possible other mentions stand: disjoint, by start."""
    out = [(a, b) for _, a, b in base]
    out += [m.span() for m in NUMBER.finditer(raw) if m.end() - m.start() >= 7 and 7 <= len(_digits(raw, *m.span())) <= 19]
    done = 0
    for m in MARKS.finditer(raw):
        a, b = m.span()
        a -= raw[a - 1 : a] == b" "
        end = a
        while a > done and raw[a - 1] in LOCAL:
            a -= 1
        b += raw[b : b + 1] == b" "
        host = DOMAIN.match(raw, b)
        if host and a < end:
            out.append((a, host.end()))
            done = host.end()
    names = {raw[a:b].partition(b"@")[0].lower() for k, a, b in base if k == "email"}
    names = {n for n in names if len(n) >= 5}
    if names:
        for m in TOKEN.finditer(raw):
            core = m[0].strip(TRIM)
            if core.lower() in names:
                a = m.start() + len(m[0]) - len(m[0].lstrip(TRIM))
                out.append((a, a + len(core)))
    held = {(a, b) for _, a, b in base}
    out.sort(key=lambda s: (s not in held, s[0], -s[1]))  # base spans first: nothing that touches one is a node beside it
    starts: list[int] = []
    kept: list[tuple[int, int]] = []
    for part in (out[: sum(s in held for s in out)], out[sum(s in held for s in out) :]):
        for a, b in part:
            i = bisect.bisect(starts, a)
            if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
                if i == len(kept):
                    starts.append(a)
                    kept.append((a, b))
                else:
                    starts.insert(i, a)
                    kept.insert(i, (a, b))
    return kept


class Graph:
    """Nodes and edges of the texts of one slice."""

    def __init__(self):
        self.features, self.label, self.held = [], [], []
        self.edges: list[tuple[int, int, int]] = []  # kind, two nodes
        self.at: list[tuple[int, int, int]] = []  # row, start, end

    def add(self, row: int, raw: bytes, base: list[tuple[str, int, int]], gold: list[tuple[str, int, int]] = ()) -> None:
        told = {(a, b): LABELS.index(k) for k, a, b in [*gold, *base]}
        fixed = {(a, b) for _, a, b in base}
        last: dict[bytes, int] = {}
        before = None
        places, first = _mentions(raw, base), len(self.at)
        keys_of = [_keys(raw[a:b]) for a, b in places]
        anchor = {key: first + i for i, span in enumerate(places) if span in fixed for keys in keys_of[i] for key in keys}
        for (a, b), kinds in zip(places, keys_of, strict=True):
            node, core = len(self.at), raw[a:b]
            self.at.append((row, a, b))
            self.features.append(_features(core))
            self.label.append(told.get((a, b), 0))
            self.held.append((a, b) in fixed)
            if before is not None and a - before <= GAP:
                self.edges.append((0, node - 1, node))
            before = b
            linked = {node}
            for kind, keys in enumerate(kinds, 1):
                for key in keys:
                    for other in (last.get(key), anchor.get(key)) if (a, b) not in fixed else ():
                        if other is not None and other not in linked:
                            linked.add(other)
                            self.edges.append((kind, other, node))
                    last[key] = node

    def arrays(self):
        edges = np.array(self.edges, np.int64).reshape(-1, 3)
        return np.array(self.features, float).reshape(-1, N_FEATURES), np.array(self.label, np.int64), np.array(self.held, bool), edges[:, 1:], edges[:, 0]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _card(r: random.Random) -> str:
    d = [str(r.randint(0, 9)) for _ in range(15)]
    return next("".join(d) + str(c) for c in range(10) if luhn(("".join(d) + str(c)).encode()))


def _entity(r: random.Random, words: list[str]) -> tuple[str, str, list[str]]:
    """A kind, an entity that its rule finds, and mentions of it that no rule finds."""
    kind = r.choice(KINDS)
    if kind == "email":
        local, host = f"{r.choice(words)}.{r.choice(words)}".lower(), f"{r.choice(words)}.{r.choice(('com', 'org', 'net'))}".lower()
        return kind, f"{local}@{host}", [f"{local}(at){host}", f"{local} [at] {host}", local]
    if kind == "ip":
        parts = [str(r.randint(10, 255)) for _ in range(4)]
        return kind, ".".join(parts), ["-".join(parts)]
    if kind == "card":
        d = _card(r)
        i = r.randint(0, 15)
        typo = d[:i] + str((int(d[i]) + r.randint(1, 9)) % 10) + d[i + 1 :]
        cut = lambda x, s: s.join(x[k : k + 4] for k in range(0, 16, 4))
        return kind, cut(d, r.choice((" ", "-", ""))), [cut(typo, r.choice((" ", "-", "")))]
    a, b, c = (str(r.randint(10 ** (n - 1), 10**n - 1)) for n in (3, 3, 4))
    return kind, f"+{r.randint(1, 99)} {r.choice((f'({a})', a))} {b}{r.choice('- ')}{c}", [f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}{b}{c}", f"{b}-{c}"]


def planted(words: list[str], n: int = PLANTED, seed: int = 23) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of words with entities, other mentions of them and meaningless numbers; and the spans of the mentions."""
    r = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha() and len(w) > 2] or ["some", "plain", "words"]
    nothing = (
        lambda: str(r.randint(10**6, 10 ** r.randint(7, 12))),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}",
        lambda: "-".join(str(r.randint(1000, 9999)) for _ in range(4)),
        lambda: f"{r.choice(words)} (at) {r.choice(words)}.{r.choice(words)}".lower(),
        lambda: "-".join(str(r.randint(10, 255)) for _ in range(4)),
        lambda: _entity(r, words)[2][0],
    )
    out = []
    for _ in range(n):
        parts: list[tuple[str, str]] = []
        for _ in range(r.randint(0, 3)):
            kind, entity, mentions = _entity(r, words)
            parts += [("", entity)] + [(kind, r.choice(mentions)) for _ in range(r.randint(0, 2))]
        parts += [("", r.choice(nothing)()) for _ in range(r.randint(0, 4))]
        r.shuffle(parts)
        text, gold = "", []
        for kind, p in parts:
            text += " ".join(r.choice(words) for _ in range(r.randint(1, 15))) + " "
            if kind:
                gold.append((kind, len(text), len(text) + len(p)))
            text += p + r.choice((" ", ", ", ". "))
        out.append((text, gold))
    return out


def fitted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Node weights (features x labels) and the edge weights, by pseudo-likelihood on entities planted among words of texts."""
    words = sorted({w for t in texts for w in re.findall(r"[A-Za-z]{3,12}", t)})
    g = Graph()
    for i, (text, gold) in enumerate(planted(words)):
        raw = text.encode()
        g.add(i, raw, base_spans(raw), gold)
    x, y, held, edges, kind = g.arrays()
    w, pair = np.zeros((N_FEATURES, len(LABELS))), np.zeros(EDGES)
    truth = np.eye(len(LABELS))[y]
    near = np.zeros((EDGES, len(y), len(LABELS)))
    for k in range(EDGES):
        for a, b in ((0, 1), (1, 0)):
            e = edges[kind == k]
            np.add.at(near[k], e[:, a], truth[e[:, b]])
    free = ~held  # nodes of base spans are given, the others are to be told
    x, near, truth = x[free], near[:, free], truth[free]
    for _ in range(STEPS):
        err = truth - _softmax(x @ w + np.tensordot(pair, near, 1))
        w += RATE * (x.T @ err / len(x) - 1e-4 * w)
        pair += RATE * (np.array([(near[k] * err).sum() / len(x) for k in range(EDGES)]) - 1e-4 * pair)
    return w, np.maximum(pair, 0.0)


def marginals(x: np.ndarray, y: np.ndarray, held: np.ndarray, edges: np.ndarray, kind: np.ndarray, w: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Loopy sum-product over all nodes at once; held nodes keep their label y."""
    n, k = len(y), len(LABELS)
    node = x @ w
    node[held] = -30.0
    node[held, y[held]] = 30.0
    if not len(edges):
        return _softmax(node)
    src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    potts = np.exp(np.r_[pair[kind], pair[kind]])[:, None]
    message = np.zeros((len(src), k))
    for _ in range(ROUNDS):
        belief = node.copy()
        np.add.at(belief, dst, message)
        out = _softmax(belief[src] - message[back])
        fresh = np.log((out * (potts - 1) + 1) / (potts + k - 1))
        message = 0.5 * message + 0.5 * fresh
    belief = node.copy()
    np.add.at(belief, dst, message)
    return _softmax(belief)


def found(data: np.ndarray, offsets: np.ndarray, model, threshold: float = THRESHOLD):
    """For each row its bytes, its base spans and the added spans, in bytes."""
    raw = data.tobytes()
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(DIGIT[data] | (data == 64), out=counts[1:])
    some = counts[offsets[1:]] > counts[offsets[:-1]]
    g, texts, bases = Graph(), [], []
    for r in range(len(offsets) - 1):
        own = raw[offsets[r] : offsets[r + 1]]
        base = base_spans(own) if some[r] else []
        if some[r]:
            g.add(r, own, base)
        texts.append(own)
        bases.append(base)
    x, y, held, edges, kind = g.arrays()
    added: dict[int, list[tuple[str, int, int]]] = {}
    if len(y):
        p = marginals(x, y, held, edges, kind, *model)
        best = p[:, 1:].argmax(1) + 1
        for i in np.flatnonzero(~held & (p[np.arange(len(y)), best] >= threshold)).tolist():
            r, a, b = g.at[i]
            added.setdefault(r, []).append((LABELS[best[i]], a, b))
    return [(t, b, added.get(r, [])) for r, (t, b) in enumerate(zip(texts, bases, strict=True))]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _scan(model):
    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                rows = []
                for own, base, more in found(*X.utf8(batch.column(1)), model):
                    kinds = [s[0] for s in base]
                    every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                    rows.append((*(kinds.count(k) for k in KINDS), S.digest(S.to_points(own, base)), S.written(S.to_points(own, every)), len(more)))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def model_of(docs: DataFrame, most_docs: int = SAMPLE_DOCS):
    """Weights fitted on entities planted among the words of at most most_docs documents, picked by a hash."""
    return fitted(X.hash_sample(docs.where("text is not null"), most_docs))


def scan(docs: DataFrame, model=None) -> DataFrame:
    """Personal data of each row of docs(doc_id, text)."""
    model = model_of(docs) if model is None else model
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(model), FOUND)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return scan(X.read(spark, sf_dir, "documents"))
