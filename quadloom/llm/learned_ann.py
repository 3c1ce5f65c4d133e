"""Approximate nearest neighbours by learned partitions.

The index is fitted on a bounded sample: its nearest-neighbour graph is cut into balanced parts that keep
neighbours together (balanced seeding, then moves to the neighbours' part while there is room), and a small network learns to tell
the parts of a vector and of its neighbours. The number of parts grows with the root of the number of vectors; past FANOUT
of them each part is cut again by an index of its own, fitted on executors from a bounded sample of that part. Every vector of the
table goes to its most probable part; a query goes to its several most probable ones, as many as reach the target share
of true neighbours on the sample, and is reranked there by exact distances on the original vectors. Parts are dealt out in
blocks of bounded size by row, so a vector or an id that fills a third of the table is no task of its own.

Distances are compared after centring and scaling, candidates within the rounding error of the k-th are kept, and those are
computed anew from the differences of the original components, so far-away or huge vectors lose no neighbour to rounding.

Defined cases: vectors that are null, zero, of another length than the most common one, or hold null or non-finite
components take no part; fewer candidates than asked for give fewer rows; ties go to the smaller vec_id; other
columns are ignored; repeated rows of a vec_id are candidates each, equal query rows are asked once; empty tables give empty tables.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm import text as X
from quadloom.llm.ngram_join import _cuts, _grouped

#: Vectors that an index is fitted on at most, parts of one index, and sample vectors of a part.
SAMPLE, FANOUT, SHARE = 6000, 128, 40
NEIGHBOURS, HIDDEN, EPOCHS, TARGET, SLACK = 10, 128, 40, 0.97, 1.15
BLOCK = 8192
FOUND = "query_id long, vec_id long, score double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 1000):
        d = _distances(x[a : a + 1000], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 1000] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Cuts the neighbour graph into parts of nearly equal size, few edges between them."""
    r = np.random.RandomState(seed)
    room = int(np.ceil(len(x) / parts * SLACK))
    centre = x[r.choice(len(x), parts, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(8):
        d = _distances(x, centre)
        size, label[:] = np.zeros(parts, np.int64), -1
        for i in np.argsort(d.min(1), kind="stable").tolist():
            for p in np.argsort(d[i], kind="stable").tolist():
                if size[p] < room:
                    label[i] = p
                    size[p] += 1
                    break
        centre = np.stack([x[label == p].mean(0) if (label == p).any() else centre[p] for p in range(parts)])
    for _ in range(6):
        moved = 0
        for i in r.permutation(len(x)).tolist():
            votes = np.bincount(label[near[i]], minlength=parts)
            p = int(votes.argmax())
            if votes[p] > votes[label[i]] and size[p] < room:
                size[label[i]] -= 1
                size[p] += 1
                label[i] = p
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A network of one hidden layer over standardised vectors; probabilities of the parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 9):
        r = np.random.RandomState(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.w = [r.randn(x.shape[1], HIDDEN) * np.sqrt(2 / x.shape[1]), r.randn(HIDDEN, target.shape[1]) * np.sqrt(2 / HIDDEN)]
        self.b = [np.zeros(HIDDEN), np.zeros(target.shape[1])]
        z = (x - self.mean) / self.scale
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(z))
            for a in range(0, len(z), 256):
                own = order[a : a + 256]
                hidden = np.maximum(z[own] @ self.w[0] + self.b[0], 0)
                err = (self._soft(hidden @ self.w[1] + self.b[1]) - target[own]) / len(own)
                back = (err @ self.w[1].T) * (hidden > 0)
                step += 1
                for p, g, s in zip((*self.w, *self.b), (z[own].T @ back, hidden.T @ err, back.sum(0), err.sum(0)), state, strict=True):
                    s[0] = 0.9 * s[0] + 0.1 * g
                    s[1] = 0.999 * s[1] + 0.001 * g * g
                    p -= 0.003 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` most probable parts of each row."""
        z = (x - self.mean) / self.scale
        return np.argsort(-(np.maximum(z @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1]), axis=1, kind="stable")[:, :most]


def _unit(x: np.ndarray) -> float:
    """A power of two near the largest component: dividing by it is exact and keeps squares finite."""
    most = float(np.abs(x).max(initial=0.0))
    return float(np.ldexp(1.0, int(np.frexp(most)[1]))) if 0 < most < 2.0**1022 else (2.0**1023 if most else 1.0)


class Index:
    """Cuts space into `parts` parts, fitted on sample vectors."""

    def __init__(self, x: np.ndarray, parts: int):
        self.parts = max(1, min(parts, len(x) // SHARE))
        self.probes, self.router = 1, None
        if self.parts == 1:
            return
        self.unit = _unit(x)
        self.centre = (x / self.unit).mean(0)
        x = self._plain(x)
        near = _graph(x, NEIGHBOURS)
        label = balanced_parts(x, near, self.parts)
        target = np.zeros((len(x), self.parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), NEIGHBOURS + 1), np.c_[label[:, None], label[near]].ravel()), 1 / (NEIGHBOURS + 1))
        fit = np.arange(len(x)) % 5 != 0
        self.router = Router(x[fit], target[fit])
        ranked = self.router.ranked(x, self.parts)
        place = np.argsort(ranked, axis=1)  # the rank of each part
        rank = place[np.repeat(np.flatnonzero(~fit), NEIGHBOURS), ranked[near[~fit].ravel(), 0]]
        share = np.cumsum(np.bincount(rank, minlength=self.parts)) / len(rank)
        self.probes = int(np.searchsorted(share, TARGET) + 1)

    def _plain(self, x: np.ndarray) -> np.ndarray:
        return x / self.unit - self.centre

    def route(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` most probable parts of each row."""
        return self.router.ranked(self._plain(x), most) if self.router else np.zeros((len(x), 1), np.int64)


class Tree:
    """An index and, where its parts are cut again, the indexes of its parts."""

    def __init__(self, root: Index, below: dict[int, Index] | None = None):
        self.root, self.below = root, below or {}
        self.width = max((i.parts for i in self.below.values()), default=1)

    def route(self, x: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): the part of each row, or those that its search probes."""
        top = self.root.route(x, self.root.probes if probing else 1)
        row, part = np.repeat(np.arange(len(x)), top.shape[1]), top.ravel()
        if not self.below:
            return row, part
        rows, parts = [], []
        for p in np.unique(part).tolist():
            own, index = row[part == p], self.below.get(p)
            low = index.route(x[own], index.probes if probing else 1) if index else np.zeros((len(own), 1), np.int64)
            rows.append(np.repeat(own, low.shape[1]))
            parts.append(low.ravel() + p * self.width)
        return np.concatenate(rows), np.concatenate(parts)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _routed(tree: Tree, dim: int, probing: bool):
    def run(batches):
        for b in batches:
            if b.num_rows:
                row, part = tree.route(_matrix(b.column(1), dim), probing)
                yield b.take(pa.array(row)).append_column("part", pa.array(part))

    return run


def _below(dim: int, parts: int):
    """The pickled index of each part, from its sample: rows come sorted by part."""

    def run(batches):
        for table in _grouped(batches, 1):
            part, cuts = np.asarray(table.column("part")), _cuts(table, 1).tolist()
            x = _matrix(table.column("embedding").combine_chunks(), dim)
            made = [pickle.dumps(Index(x[a:b], parts)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(made, pa.binary())], names=["part", "made"])

    return run


def nearest(query: np.ndarray, query_id: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(row of query, vec_id, distance) of the k nearest of each query, its own id left out; exact."""
    out = []
    by_id = np.argsort(ids, kind="stable")
    x, ids = x[by_id], ids[by_id]
    unit = max(_unit(x), _unit(query))
    x, query = x / unit, query / unit
    centre = x.mean(0)
    plain, norm = x - centre, ((x - centre) ** 2).sum(1).max(initial=0.0)
    for a in range(0, len(query), 64):
        own = query[a : a + 64] - centre
        d = _distances(own, plain)
        d[query_id[a : a + 64, None] == ids[None, :]] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
        error = 8 * (x.shape[1] + 4) * np.finfo(float).eps * ((own**2).sum(1) + norm)  # of d, twice over
        for q in range(len(d)):
            near = np.flatnonzero((d[q] <= kth[q] + error[q]) & np.isfinite(d[q]))
            with np.errstate(over="ignore"):
                exact = np.sqrt(((x[near] - query[a + q]) ** 2).sum(1)) * unit
            best = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(best), a + q), ids[near][best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))


def _search(dim: int, k: int):
    def run(batches):
        for table in _grouped(batches, 2):
            cuts = _cuts(table, 2).tolist()
            asks, ids = np.asarray(table.column("ask")), np.asarray(table.column("vec_id"))
            x = _matrix(table.column("embedding").combine_chunks(), dim)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                q = a + np.flatnonzero(asks[a:b])
                c = a + np.flatnonzero(~asks[a:b])
                if len(q) and len(c):
                    row, found, d = nearest(x[q], ids[q], x[c], ids[c], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q][row]), pa.array(found), pa.array(d)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding array<double> of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return v.where(~F.exists("embedding", bad) & F.exists("embedding", lambda e: e != 0))


def fitted(own: DataFrame, dim: int, n: int, sample: int = SAMPLE, fanout: int = FANOUT) -> Tree:
    """The tree of indexes for the n vectors own(vec_id, embedding) of dim components."""
    parts = max(1, math.isqrt(n) // 2)
    picked = own.select("vec_id", "embedding", F.rand(7).alias("r"))
    rows = picked.where(F.col("r") < min(1.0, 1.2 * sample / max(n, 1))).orderBy("r").limit(sample).collect()
    root = Tree(Index(np.array([r.embedding for r in rows]).reshape(-1, dim), min(parts, fanout)))
    if parts <= fanout:
        return root
    share = sample * root.root.parts / n  # of each part, about: at most twice as many are taken
    schema = "vec_id long, embedding array<double>, r double, part long"
    below = picked.where(F.col("r") < min(1.0, share)).mapInArrow(_routed(root, dim, False), schema)
    below = X.written(below, "samples")
    order = Window.partitionBy("part").orderBy("r", "vec_id")
    below = below.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * sample).select("part", "embedding")
    below = below.repartition("part").sortWithinPartitions("part")
    made = below.mapInArrow(_below(dim, -(-parts // root.root.parts)), "part long, made binary").collect()  # at most fanout small networks
    return Tree(root.root, {r.part: pickle.loads(r.made) for r in made})


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, fanout: int = FANOUT) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each of queries(vec_id, embedding) among vectors."""
    sizes = usable(vectors).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (sizes.dim, sizes.n) if sizes else (1, 0)
    own = usable(vectors).where(F.size("embedding") == dim)
    asked = usable(queries).where(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"])
    tree = fitted(own, dim, n, sample, fanout)
    schema = "vec_id long, embedding array<double>, part long"
    held = X.written(own.mapInArrow(_routed(tree, dim, False), schema).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    salts = held.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("salts"))  # at most fanout * fanout rows
    blocks = held.join(F.broadcast(salts), "part").select("part", F.pmod("deal", "salts").cast("int").alias("salt"), F.lit(False).alias("ask"), "vec_id", "embedding")
    asks = asked.mapInArrow(_routed(tree, dim, True), schema).join(F.broadcast(salts), "part")
    asks = asks.select("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("ask"), "vec_id", "embedding")
    both = blocks.union(asks).repartition("part", "salt").sortWithinPartitions("part", "salt")
    found = both.mapInArrow(_search(dim, k), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_learned_ann(spark, sf_dir: str) -> DataFrame:
    vectors = X.read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
