"""Secret scans: fixed rules, and character Markov models of random strings and ordinary identifiers.

The rules (assign, access, hex) are searched leftmost and non-overlapping, each kind by itself, and
failing matches are dropped. Beside them every token of LEAST or more characters of [A-Za-z0-9+/_=-] that
touches no rule's span is scored: the log-likelihood of its characters, each given the one before, under
a model of random strings less that under a model of ordinary identifiers. A token becomes a span of kind `markov` where its
sum passes SUM and its mean a character passes MEAN: the sum weighs the evidence, so a short token has to be odder at each
character than a long one. Both models are trained from labelled samples.

Defined cases: null and empty texts have no spans; very long texts are scanned whole in linear time; offsets are
code points; repeated rows are scanned each; of spans that start together the kinds come as listed; other columns are ignored
(scan) or kept (redacted), whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import spans as S
from quadloom.llm import text as X

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CUES = (b"passw", b"secret", b"token", b"api")
HEX = S.members("0123456789abcdef")
TOKEN = string.ascii_letters + string.digits + "+/_=-"
TOKEN_MEMBERS = S.members(TOKEN)
LEAST, SUM, MEAN = 8, 16.0, 0.6
#: Documents whose words are the ordinary samples, and random strings beside them.
SAMPLE_DOCS, SAMPLE_RANDOM = 200, 4000
_CODE = np.zeros(256, np.int64)
_CODE[list(TOKEN.encode())] = np.arange(1, len(TOKEN) + 1)


def trained(samples: list[tuple[str, int]], smoothing: float = 1.5) -> np.ndarray:
    """Log-likelihood ratio of each character given the one before, from (string, 1 if random else 0)."""
    n = len(TOKEN) + 1
    counts = np.full((2, n, n), smoothing)
    for label in (0, 1):
        joined = " ".join(s for s, k in samples if k == label)
        codes = _CODE[np.frombuffer((" " + joined).encode("ascii", "replace"), np.uint8)]
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    counts = counts[:, :, 1:]
    p = np.log(counts / counts.sum(2, keepdims=True))
    out = np.zeros((n, n))
    out[:, 1:] = p[1] - p[0]
    return out


def random_strings(n: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    kinds = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef", TOKEN)
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(LEAST, 64))) for i in range(n)]


def labelled_samples(docs: DataFrame, most_docs: int = SAMPLE_DOCS, n_random: int = SAMPLE_RANDOM) -> list[tuple[str, int]]:
    """Ordinary identifiers (all words, and words joined by signs or capitals) of at most most_docs documents, picked by a hash, and seeded random strings."""
    texts = X.hash_sample(docs.where("text is not null"), most_docs)
    seen = {w for t in texts for w in re.findall(r"[A-Za-z]{2,}", t) if len(w) < 25}
    seen = sorted(seen) or list(string.ascii_lowercase)
    r = random.Random(11)
    joined = [r.choice("_-/").join(r.choices(seen, k=3)) + r.choice(("", "", "1", "_2", "2024")) for _ in range(len(seen) // 2)]
    camel = ["".join(w.title() for w in r.choices(seen, k=3)) for _ in range(len(seen) // 2)]
    lower = [w.lower() for w in seen] + [w.upper() for w in seen[::4]]
    numbers = ["".join(r.choices(string.digits, k=r.randint(4, 19))) for _ in range(1000)] + ["-".join("".join(r.choices(string.digits, k=r.randint(2, 4))) for _ in range(r.randint(2, 4))) for _ in range(1000)]
    versions = [f"{r.choice(seen)}{r.choice('-_')}{r.randint(1, 99)}{r.choice(('', '-rc1', 'b', '-x86', '_v2'))}" for _ in range(1000)]
    dates = [f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" for _ in range(200)] + [c * r.randint(20, 40) for c in "-=_/+*0123456789" for _ in range(20)]
    return [(s, 0) for s in seen + lower + joined + camel + numbers + versions + dates] + [(s, 1) for s in random_strings(n_random)]


def base_spans(raw: bytes) -> dict[str, list[tuple[int, int]]]:
    """The assign and access matches of one text, as bytes."""
    out: dict[str, list[tuple[int, int]]] = {"assign": [], "access": []}
    low = raw.lower()
    if any(c in low for c in CUES):
        out["assign"] = [m.span() for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in raw:
        out["access"] = [m.span() for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    return out


def scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of data[start:end]."""
    n = ends - starts
    at = X.ragged(starts, n)
    now = _CODE[data[at]]
    before = np.empty_like(now)
    if len(now):
        before[1:] = now[:-1]
        before[np.cumsum(n) - n] = 0
    return np.add.reduceat(model[before, now], np.cumsum(n) - n) if len(n) else np.zeros(0)


def found(data: np.ndarray, offsets: np.ndarray, model: np.ndarray):
    """For each row its bytes and its spans (kind, start, end) in bytes, by start and kind."""
    raw, n = data.tobytes(), len(offsets) - 1
    hexes: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(*(x.tolist() for x in S.runs(data, offsets, HEX, 32)), strict=True):
        hexes.setdefault(r, []).append((a - int(offsets[r]), b - int(offsets[r])))
    rows, starts, ends = S.runs(data, offsets, TOKEN_MEMBERS, LEAST)
    score = scores(data, starts, ends, model)
    random_like = (score > SUM) & (score > MEAN * (ends - starts))
    likely: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(rows[random_like].tolist(), starts[random_like].tolist(), ends[random_like].tolist(), strict=True):
        likely.setdefault(r, []).append((a - int(offsets[r]), b - int(offsets[r])))
    for r in range(n):
        own = raw[offsets[r] : offsets[r + 1]]
        spans = [(k, a, b) for k, xs in (base_spans(own) | {"hex": hexes.get(r, [])}).items() for a, b in xs]
        more = likely.get(r, [])
        if more and spans:  # both sides sorted by start; rules' spans merged into disjoint ones
            taken: list[list[int]] = []
            for _, a, b in sorted(spans, key=lambda s: s[1]):
                if taken and a <= taken[-1][1]:
                    taken[-1][1] = max(taken[-1][1], b)
                else:
                    taken.append([a, b])
            at = np.searchsorted([t[1] for t in taken], [a for a, _ in more], "right")
            more = [(a, b) for (a, b), i in zip(more, at.tolist(), strict=True) if i == len(taken) or taken[i][0] >= b]
        spans += [("markov", a, b) for a, b in more]
        yield own, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def _scan(model: np.ndarray):
    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                rows = []
                for own, spans in found(*X.utf8(batch.column(1)), model):
                    at = S.to_points(own, spans)
                    base = [s for s in at if s[0] != "markov"]
                    kinds = [s[0] for s in at]
                    rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), S.digest(base), S.written(at), kinds.count("markov")))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[c.split()[0] for c in SCANNED.split(", ")])

    return run


def scan(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """Spans and counts for each row of docs(doc_id, text); trains on docs where no model is given."""
    model = trained(labelled_samples(docs)) if model is None else model
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(model), SCANNED)


MASK = b"[SECRET]"


def _redact(model: np.ndarray):
    def run(batches):
        for whole in batches:
            for batch in X.slices(whole, "text"):
                i = batch.schema.get_field_index("text")
                texts = []
                for own, spans in found(*X.utf8(batch.column(i)), model):
                    parts, at = [], 0
                    for _, a, b in spans:
                        if a >= at:
                            parts += [own[at:a], MASK]
                        at = max(at, b)
                    texts.append(b"".join([*parts, own[at:]]) if parts else own)
                fresh = pa.array(texts, pa.binary(), mask=np.asarray(batch.column(i).is_null())).cast(pa.string())
                yield batch.set_column(i, batch.schema.field(i), fresh)

    return run


def redacted(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """docs with every found span of text replaced by a mask; all other columns unchanged."""
    model = trained(labelled_samples(docs)) if model is None else model
    return docs.mapInArrow(_redact(model), docs.schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(X.read(spark, sf_dir, "documents"))
