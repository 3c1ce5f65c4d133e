"""Language ID: segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary; the probability of a word is the
sum, over all its segmentations into pieces, of the products of theirs, got by a forward pass over the lattice, and that
of a text is the product over its words. The pieces' probabilities are fitted by expectation and maximisation
(forward and backward passes) on a bounded sample of labelled documents of each language. The score is the
posterior under equal priors.

Words are maximal runs of letters, lower-cased, whole however long: forward passes are rescaled on the way, so no word
underflows. They run on numpy matrices of equal-length words, once for each new word of a worker; texts are sums over a kept table.
The model is fitted on words of at most FIT_LETTERS letters of the sampled documents.

Defined cases: a text that is null or has no letter is `und` with score 0; characters outside the vocabulary cost every
language the same; very long texts and words are scored whole; no labelled training rows: every text is `und`; repeated rows are scored each; other columns are
ignored (predicted) or kept (accepted); ties go to the first language by name; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import pieces as P
from quadloom.llm import text as X

#: Letters of a word that the model is fitted on at most, and positions between two rescalings.
FIT_LETTERS, RESCALE = 32, 16
#: Labelled documents of each language that the model is fitted on at most, and passes over them.
SAMPLE_DOCS, PASSES = 500, 4
SMOOTHING, UNKNOWN = 0.01, 1e-7
MOST_CHUNKS, MOST_CHARACTERS = 250_000, 10_000_000
UND = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    out = []
    for w in _LETTERS.findall(text.lower()):
        if not w.isalpha():
            w = "".join(filter(str.isalpha, w))
        out += [P.MARK + w] if w else []
    return out


def vocabulary(path: str | None = None) -> list[str]:
    import public_tokenizers

    kept = (p for p, _, k in P.load(path or public_tokenizers.path("piece_bpe_32k.model")) if k == P.NORMAL)
    return [p for p in kept if (b := p.removeprefix(P.MARK)) == b.lower() and (b.isalpha() or not b)]


class Model:
    """languages, and piece probabilities (pieces x languages)."""

    def __init__(self, languages: list[str], table: P.Table, p: np.ndarray):
        self.languages, self.table, self.p = languages, table, p

    def _lattice(self, words: list[str]):
        points = P.matrix(words)
        return points.shape[1], self.table.prefixes(points)

    def forward(self, words: list[str]) -> np.ndarray:
        """Log-probability (words x languages) of words of one length."""
        n, hashes = self._lattice(words)
        alpha = np.zeros((n + 1, len(words), self.p.shape[1]))
        alpha[0], taken = 1, 0.0
        for end in range(1, n + 1):
            first = max(0, end - self.table.longest)
            for start in range(first, end):
                k = self.table.probe(hashes, start, end)
                hit = np.flatnonzero(k >= 0)
                if len(hit):
                    alpha[end, hit] += alpha[start, hit] * self.p[k[hit]]
            alpha[end] += alpha[end - 1] * UNKNOWN
            if end % RESCALE == 0:
                scale = alpha[end].copy()
                alpha[first : end + 1] /= scale
                taken = taken + np.log(scale)
        return taken + np.log(alpha[n])

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words of one length, each weighted by its times. One language."""
        n, hashes = self._lattice(words)
        p = self.p[:, 0]
        edges = []
        alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        alpha[0] = beta[n] = 1
        for end in range(1, n + 1):
            for start in range(max(0, end - self.table.longest), end):
                k = self.table.probe(hashes, start, end)
                hit = np.flatnonzero(k >= 0)
                if len(hit):
                    alpha[end, hit] += alpha[start, hit] * p[k[hit]]
                    edges.append((start, end, hit, k[hit]))
            alpha[end] += alpha[end - 1] * UNKNOWN
        edges.sort(key=lambda e: -e[1])
        at = 0
        for end in range(n, 0, -1):
            beta[end - 1] += beta[end] * UNKNOWN
            while at < len(edges) and edges[at][1] == end:
                start, _, hit, k = edges[at]
                beta[start, hit] += beta[end, hit] * p[k]
                at += 1
        out = np.zeros(len(p))
        for start, end, hit, k in edges:
            out += np.bincount(k, alpha[start, hit] * p[k] * beta[end, hit] / alpha[n, hit] * times[hit], len(p))
        return out


def fitted(texts: dict[str, list[str]], path: str | None = None, passes: int = PASSES) -> Model:
    """A model from labelled texts by language."""
    kept = vocabulary(path)
    table = P.Table(kept)
    columns = []
    for lang in sorted(texts):
        counts = Counter(w for t in texts[lang] for w in letter_words(t) if len(w) <= FIT_LETTERS + 1)
        words = sorted(counts)
        times = np.array([counts[w] for w in words], float)
        p = np.array([[10.0 ** -len(k)] for k in kept])
        for _ in range(passes):
            one = Model([lang], table, p / p.sum())
            uses = np.zeros(len(kept))
            for _, part in P.by_length(words):
                uses += one.expected([words[i] for i in part.tolist()], times[part])
            p = (uses + SMOOTHING)[:, None]
        columns.append(p / p.sum())
    return Model(sorted(texts), table, np.hstack(columns) if columns else np.zeros((len(kept), 0)))


def model_of(docs: DataFrame, most_docs: int = SAMPLE_DOCS, path: str | None = None) -> Model:
    """Fitted on labelled documents whose crc32(doc_id) mod 4 is not 2, at most most_docs of each language, picked by a hash."""
    X.bounded(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(X.crc_text("doc_id") % 4, F.lit(0)) != 2))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    share = {r.lang: min(1.0, 1.3 * most_docs / r.c) for r in counts.collect()}  # one number for each language
    if not share:
        return fitted({}, path)
    limit = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))[F.col("lang")]
    rows = known.select("lang", "text", X.chance("doc_id", "text").alias("h")).where(F.col("h") < limit).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.text)):
        own = texts.setdefault(r.lang, [])
        if len(own) < most_docs:
            own.append(r.text)
    return fitted(texts, path)


class Scorer:
    """Sums of word scores by chunk between white space, kept in a bounded table."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(self.model.languages) + 1))
        self.characters = 0

    def _learn(self, chunks: list[str]) -> None:
        parts = [letter_words(c) for c in chunks]
        words = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(words)}
        score = np.zeros((len(words), self.table.shape[1]))
        for _, part in P.by_length(words):
            own = [words[i] for i in part.tolist()]
            score[part, :-1] = self.model.forward(own)
            score[part, -1] = 1
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        fresh = np.zeros((len(parts), self.table.shape[1]))
        np.add.at(fresh, np.repeat(np.arange(len(parts)), n), score[[number[w] for p in parts for w in p]])
        for i, c in enumerate(chunks):
            self.index[c] = len(self.table) + i
            self.characters += len(c)
        self.table = np.vstack([self.table, fresh])

    def score(self, texts: list[str]) -> np.ndarray:
        """Summed log-probabilities (texts x languages), and how many words in the last column."""
        if len(self.index) > MOST_CHUNKS or self.characters > MOST_CHARACTERS:
            self.clear()
        chunks, ends = [], [0]
        for t in texts:
            chunks += t.split()
            ends.append(len(chunks))
        number = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(number < 0)
        if len(miss):
            self._learn(sorted({chunks[i] for i in miss.tolist()}))
            number[miss] = [self.index[chunks[i]] for i in miss.tolist()]
        n = np.diff(ends)
        out = np.zeros((len(texts), self.table.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.table[number], np.array(ends)[some], axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        s = self.score(texts)
        logs = s[:, :-1]
        if not logs.shape[1]:
            return [UND] * len(texts), np.zeros(len(texts))
        best = logs.argmax(1)
        top = logs[np.arange(len(texts)), best]
        score = 1 / np.exp(logs - top[:, None]).sum(1)
        some = s[:, -1] > 0
        return [self.model.languages[b] if k else UND for b, k in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)


def _predict(model: Model):
    def run(batches):
        own = Scorer(model)
        for whole in batches:
            for batch in X.slices(whole):
                lang, score = own.predict([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text); fitted on docs where no model is given."""
    model = model_of(docs) if model is None else model
    held = F.coalesce(X.crc_text("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _accept(model: Model, least: float):
    def run(batches):
        own = Scorer(model)
        for whole in batches:
            for batch in X.slices(whole):
                lang, score = own.predict([t or "" for t in batch.column("text").to_pylist()])
                yield batch.filter(pa.array([k != UND and s >= least for k, s in zip(lang, score.tolist(), strict=True)]))

    return run


def accepted(docs: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with a score of at least `least`, all columns kept."""
    model = model_of(docs) if model is None else model
    return docs.mapInArrow(_accept(model, least), docs.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return predicted(X.read(spark, sf_dir, "documents"))
