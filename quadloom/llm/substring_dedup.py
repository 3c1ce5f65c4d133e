"""Substring dedup by de Bruijn compaction.

The edges of the de Bruijn graph are windows of `window` consecutive words, its nodes their overlaps
of one word less. As in minimiser-partitioned compaction, every edge is assigned to the least hash
among its inner k-mers; consecutive edges of one document with the same least k-mer (at the same
place) form a short path. Only paths are shuffled, about one for every nine words:

* a k-mer that one path holds: nothing there repeats;
* all paths of a k-mer equal: all their edges repeat;
* different paths of a k-mer: branching. Equal paths are counted together, and of each different one
  the edges are rebuilt from its source coordinates in the text and counted one by one.

Repeated paths are then compacted through joins: each kind of path knows the kind before it in its documents, and
where all places of a kind follow the same kind, which has as many places, the node between them does not branch and
they are one longer path. What remains are maximal nonbranching repeated spans with source coordinates (row, word). Every
place of every span is verified there: a cryptographic digest of the words read from the text has to be the same for all
places of the span, and edges counted one by one carry such a digest too. Should two texts share a rolling hash, the
verification finds it and the operator starts again with hashes of another base.

Inside one path no two edges can be equal (the leftmost least k-mer stands at another distance in
each), so counts are exact; rows are counted before they are shuffled. Joins on k-mers are dealt
so that a passage that fills a third of the table is no task of its own. Every word of a repeated window is removed, in each
place where it occurs.

Defined cases: null, empty and short texts (under `window` words) have no window and keep all words; very long texts are
processed whole; rows are told apart by written row keys, so rows with a null doc_id or one that others share are places of
their own and each loses its own passages; of equal passages none is preferred, all go; other columns are ignored
(deduplicated()) or carried unchanged (cleaned()), whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm import text as X

WINDOW, KMER = 35, 8
#: Bases of the word hashes; the next one is taken where the verification finds two texts with one hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)
_PATHS = "m long, s long, before long, row long, at int, n int"
_CHECKED = "w long, digest long, row long, at int, weight int"


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the leftmost least of values[i : i + width]."""
    v, p, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = v[: len(v) - step], v[step:]
        take = b < a
        v, p, have = np.where(take, b, a), np.where(take, p[step:], p[: len(p) - step]), have + step
    return p


def _parsed(column: pa.Array, base: int):
    data, offsets = X.utf8(column)
    starts, ends, first = X.words(data, offsets)
    return data, starts, ends, first, X.word_hashes(data, starts, ends, base)


def _paths(window: int, kmer: int, base: int):
    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                _, _, _, first, hashes = _parsed(batch.column(1), base)
                at = X.windows(first, window)
                if not len(at):
                    continue
                roll = X.Rolling(hashes)
                k = np.arange(len(hashes) - kmer + 1)
                low = roll.runs(k, k + kmer)
                place = _leftmost_least(low, window - kmer + 1)[at]
                gap = np.diff(at) != 1
                head = np.flatnonzero(np.r_[True, gap | (np.diff(place) != 0)])
                n = np.diff(np.r_[head, len(at)])
                start = at[head]
                row = np.searchsorted(first, start, "right") - 1
                path = roll.runs(start, start + n + window - 1)
                before = np.where(np.r_[True, gap][head], X.U64(0), np.r_[X.U64(0), path[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(low[place[head]].view(np.int64)),
                        pa.array(path.view(np.int64)),
                        pa.array(before.view(np.int64)),
                        batch.column(0).take(pa.array(row)),
                        pa.array((start - first[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["m", "s", "before", "row", "at", "n"],
                )

    return run


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digests of the words a..b - 1, joined by one space, as they stand in the text."""
    size = ends - starts + 1
    plain = np.r_[data, np.uint8(32)][X.ragged(starts, size)]
    stop = np.cumsum(size) - 1
    plain[stop] = 32
    view = memoryview(plain.tobytes())
    spans = zip((stop[a] - size[a] + 1).tolist(), stop[b - 1].tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.blake2b(view[i:j], digest_size=8).digest() for i, j in spans]), np.int64)


def _check(window: int, base: int):
    """Reads the text at source coordinates. A span with weight 0 gives its digest, others those of each of their windows."""

    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                data, starts, ends, first, hashes = _parsed(batch.column(1), base)
                spans = batch.column(2)
                rows = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths()))
                m, s, at, n, weight = (np.asarray(spans.flatten().field(k)) for k in ("m", "s", "at", "n", "weight"))
                times = np.where(weight > 0, n, 1)
                back = np.repeat(np.arange(len(n)), times)
                start = X.ragged(first[rows] + at, times)
                single = weight[back] > 0
                stop = start + np.where(single, 1, n[back]) + window - 1
                wide = np.zeros(len(start), np.int64)
                wide[single] = X.Rolling(hashes).runs(start[single], stop[single]).view(np.int64)
                wide[~single] = (X.mix(m.view(X.U64)) ^ s.view(X.U64)).view(np.int64)[back[~single]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(wide),
                        pa.array(_digests(data, starts, ends, start, stop)),
                        batch.column(0).take(pa.array(rows[back])),
                        pa.array((start - first[rows[back]]).astype(np.int32)),
                        pa.array(weight[back].astype(np.int32)),
                    ],
                    names=[c.split()[0] for c in _CHECKED.split(", ")],
                )

    return run


def _compacted(paths: DataFrame, kinds: DataFrame) -> DataFrame:
    """m, s, row, at, n: the places of the maximal nonbranching spans of repeated paths; m and s are those of the first path."""
    # A node between two kinds does not branch where all places of one follow the other and both have as many places.
    earlier = kinds.groupBy(F.col("s").alias("before")).agg(F.max("c").alias("earlier"))
    one = kinds.where("low = high").select("m", "s", "c", F.col("low").alias("before")).join(earlier, "before").where("c = earlier").select("m", "s", F.lit(True).alias("inner"))
    told = X.written(kinds.select("m", "s", "c").join(one, ["m", "s"], "left"), "told")
    places = X.join_counted(paths.select("m", "s", "row", "at", "n"), told, ["m", "s"], paths.count())
    order = Window.partitionBy("row").orderBy("at")
    first = F.col("inner").isNull() | (F.col("at") != F.coalesce(F.lag(F.col("at") + F.col("n")).over(order), F.lit(-1)))
    places = places.withColumn("first", first).withColumn("span", F.sum(F.col("first").cast("int")).over(order))
    places = places.groupBy("row", "span").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min_by(F.struct("m", "s"), "at").alias("k"))
    places = X.written(places.select("k.*", "row", "at", "n"), "spans")
    X.drop(told)
    return places


def duplicates(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """row and spans array<struct<at, n>> of docs(row, text), row unlike in all rows: runs of n repeated windows from word `at`, one row for each text with any."""
    for base in BASES:
        paths = X.written(docs.select("row", "text").mapInArrow(_paths(window, kmer, base), _PATHS), "paths")
        nodes = X.written(paths.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "nodes")
        found = X.written(X.join_counted(paths, nodes, ["m"], paths.count()).drop("c"), "found")
        X.drop(paths, nodes)
        kinds = found.groupBy("m", "s").agg(F.count(F.lit(1)).alias("c"), F.min("before").alias("low"), F.max("before").alias("high"), F.min(F.struct("row", "at", "n")).alias("first"))
        kinds = X.written(kinds, "kinds")
        branching = X.written(kinds.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "nodes")
        spans = _compacted(found, kinds.where("c > 1"))
        X.drop(found)
        known = spans.select("row", F.struct("m", "s", "at", "n", F.lit(0).alias("weight")).alias("p"))
        rebuilt = X.join_counted(kinds.withColumn("weight", F.least("c", F.lit(2)).cast("int")).drop("c"), branching, ["m"], kinds.count())
        rebuilt = rebuilt.select("first.row", F.struct("m", "s", "first.at", "first.n", "weight").alias("p"))
        read = docs.select("row", "text").join(known.union(rebuilt).groupBy("row").agg(F.collect_list("p").alias("p")), "row")
        checked = X.written(read.mapInArrow(_check(window, base), _CHECKED), "checked")
        unlike = checked.where("weight = 0").groupBy("w").agg((F.min("digest") != F.max("digest")).alias("unlike"))
        fine = not unlike.where("unlike").limit(1).count()
        X.drop(kinds, branching)  # after the next job, which lets go of the shuffled texts of the one before
        if fine:
            break
    else:
        raise RuntimeError("texts share hashes of every base")
    edges = checked.where("weight > 0")
    keys = ["w", "digest"]
    hits = edges.groupBy(*keys).agg(F.sum("weight").alias("t"), F.count(F.lit(1)).alias("c")).where("t > 1")
    single = X.join_counted(edges.where("weight = 1"), X.written(hits.select(*keys, "c"), "hits"), keys, edges.count()).select("row", "at", F.lit(1).alias("n"))
    return spans.select("row", "at", "n").union(single).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def _covered(spans: pa.Array, first: np.ndarray, window: int) -> np.ndarray:
    """Which words the repeated windows cover."""
    rows = np.repeat(np.arange(len(spans)), np.nan_to_num(np.asarray(spans.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int))
    at, n = (np.asarray(spans.flatten().field(k)) for k in ("at", "n"))
    delta = np.zeros(int(first[-1]) + 1, np.int64)
    start = first[rows] + at
    np.add.at(delta, start, 1)
    np.add.at(delta, np.minimum(start + n + window - 1, first[rows + 1]), -1)
    return np.cumsum(delta[:-1]) > 0


def _kept(window: int):
    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                data, offsets = X.utf8(batch.column(1))
                starts, ends, first = X.words(data, offsets)
                spans = batch.column(2)
                gone = _covered(spans, first, window)
                raw, texts, removed = data.tobytes(), [], []
                for r in range(batch.num_rows):
                    a, b = int(first[r]), int(first[r + 1])
                    out = gone[a:b]
                    removed.append(int(out.sum()))
                    own = raw[offsets[r] : offsets[r + 1]].split()
                    texts.append(b" ".join([w for w, g in zip(own, out.tolist(), strict=True) if not g] if removed[-1] else own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the kept words joined by one space, for every row of docs."""
    docs, _ = X.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    joined = docs.join(duplicates(docs, window, kmer), "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")


def _clean(window: int, text_at: int):
    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                data, offsets = X.utf8(batch.column(text_at))
                _, _, first = X.words(data, offsets)
                gone = _covered(batch.column(batch.num_columns - 1), first, window)
                raw, texts, keep = data.tobytes(), [], []
                for r in range(batch.num_rows):
                    own, out = raw[offsets[r] : offsets[r + 1]], gone[first[r] : first[r + 1]]
                    if out.any():
                        own = b" ".join([w for w, g in zip(own.split(), out.tolist(), strict=True) if not g])
                    texts.append(own)
                    keep.append(not (len(out) and out.all()))
                fresh = pa.array(texts, pa.binary(), mask=np.asarray(batch.column(text_at).is_null())).cast(pa.string())
                rest = batch.select(range(batch.num_columns - 1))
                yield rest.set_column(text_at, rest.schema.field(text_at), fresh).filter(pa.array(keep, pa.bool_()))

    return run


def cleaned(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """docs without the repeated passages; rows of which nothing is left go, texts without any stay as they are."""
    columns, schema = docs.columns, docs.schema
    docs, row = X.keyed(docs)
    own = X.unused(docs, "spans")
    spans = duplicates(docs.select(F.col(row).alias("row"), "text"), window, kmer).select(F.col("row").alias(row), F.col("spans").alias(own))
    joined = docs.join(spans, row, "left").select(*columns, own)
    return joined.mapInArrow(_clean(window, columns.index("text")), schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(X.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
