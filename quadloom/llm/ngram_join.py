"""N-gram Jaccard join by a MinHash LSH forest, then exact verification.

Documents are sets of word shingles. Equal sets are one node. Each node has TREES signatures of DEPTH minima; in each
tree a signature is a path of a prefix trie, and nodes that agree on a prefix are candidates. A pair of similarity s agrees
on d minima in some tree with probability 1 - (1 - s**d)**TREES, so the longest prefix that reaches the target recall
RECALL at the threshold is known (5 minima at 0.8). Paths are cut there; the leaves of the trie, each with its number of
nodes, roll up level by level, and a prefix is shortened on, by SHORTER minima at most, while no more than CROWDED nodes
share it: crowded places of the trie keep the target recall, all others exceed it.

Groups larger than a block are compared block by block, so no task holds a whole crowded group. Estimated
similarity from the signatures joins nodes into candidate clusters, and inside each cluster every pair of blocks is
verified exactly on the shingle sets by a matrix product. What leaves a task is, for each node, its number of links and
one edge towards the root of its component there: links are counted, never listed.

Each row gets a key of its own, written with it, so rows are told apart whatever their doc_id.

Defined cases: null and empty texts have no shingle, no link and a class of their own; texts of fewer words than a
shingle are one shingle; repeated rows and equal sets share a node and link to each other; columns other than doc_id and
text are ignored (classes) or kept (representatives); the class id is the least doc_id of the component, null if it has
none; the representative of a class is its row with the least doc_id (null after all others), of these the one with the
least row key, so rows with a null doc_id or a doc_id that other rows share stay where their texts differ; very long texts are
shingled whole; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import text as X

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, SHORTER, CROWDED = 16, 5, 2, 64
#: The chance that a pair at the threshold is found, at least.
RECALL = 0.998
#: Estimates this many standard deviations under the threshold still join a cluster.
DEVIATIONS, BLOCK = 4.5, 256
#: Bytes of a path: the number of its tree, then its minima.
_K, WIDTH = TREES * DEPTH, 1 + 2 * DEPTH
_RANDOM = np.random.RandomState(20240229)
_MULTIPLY = _RANDOM.randint(0, 1 << 62, _K).astype(X.U64) * X.U64(2) + X.U64(1)
_ADD = _RANDOM.randint(0, 1 << 62, _K).astype(X.U64)


def depth(threshold: float) -> int:
    """The longest prefix that finds a pair at the threshold with probability RECALL."""
    fits = [d for d in range(1, DEPTH + 1) if 1 - (1 - threshold**d) ** TREES >= RECALL]
    if not fits:
        raise ValueError(f"no prefix reaches a recall of {RECALL} at similarity {threshold}")
    return fits[-1]


def _shingles(column: pa.Array, size: int):
    """Distinct shingle hashes of each row, rising within rows, and the n + 1 offsets of the rows."""
    data, offsets = X.utf8(column)
    starts, ends, first = X.words(data, offsets)
    hashes = X.word_hashes(data, starts, ends)
    n = np.diff(first)
    start = X.windows(first, size)
    length = np.full(len(start), size)
    short = np.flatnonzero((n > 0) & (n < size))
    start, length = np.r_[start, first[short]], np.r_[length, n[short]]
    h = X.Rolling(hashes).runs(start, start + length) if len(start) else np.zeros(0, X.U64)
    row = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def _identity(h: np.ndarray, offsets: np.ndarray, some: np.ndarray) -> np.ndarray:
    """A hash of each non-empty set."""
    return X.mix(np.add.reduceat(X.mix(h ^ X.U64(0x5851F42D4C957F2D)), offsets[:-1][some]) ^ np.diff(offsets)[some].astype(X.U64))


def _sketch(size: int):
    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                h, offsets = _shingles(batch.column(1), size)
                some = np.flatnonzero(np.diff(offsets))
                key = np.zeros(batch.num_rows, np.int64)
                signature = np.zeros((batch.num_rows, _K), np.uint16)
                if len(some):
                    at = offsets[:-1][some]
                    key[some] = _identity(h, offsets, some).view(np.int64)
                    for k in range(_K):
                        low = np.minimum.reduceat((h * _MULTIPLY[k] + _ADD[k]) >> X.U64(32), at)
                        signature[some, k] = X.mix(low) & X.U64(0xFFFF)
                path = np.zeros((batch.num_rows, TREES, WIDTH), np.uint8)
                path[:, :, 0] = np.arange(TREES)
                path[:, :, 1:] = signature.astype(">u2").view(np.uint8).reshape(batch.num_rows, TREES, WIDTH - 1)
                ends = pa.py_buffer(np.arange(0, path.size + 1, WIDTH, dtype=np.int32))
                paths = pa.Array.from_buffers(pa.binary(), batch.num_rows * TREES, [None, ends, pa.py_buffer(path.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array(key, mask=np.diff(offsets) == 0),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, TREES * batch.num_rows + 1, TREES, dtype=np.int32)), paths),
                    ],
                    names=["doc_id", "row", "k", "signature", "paths"],
                )

    return run


def _grouped(batches, n_keys: int):
    """Tables of whole groups: rows come sorted by their first n_keys columns, groups may pass over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(n_keys)]
        last = [k[-1] for k in keys]
        inside = np.all([k == x for k, x in zip(keys, last, strict=True)], axis=0)
        cut = int(np.argmax(inside))  # the last group starts here
        if held and cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        elif held and any(np.asarray(held[-1].column(i))[-1] != x for i, x in enumerate(last)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(table: pa.Table, n_keys: int) -> np.ndarray:
    keys = [np.asarray(table.column(i)) for i in range(n_keys)]
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.r_[0, np.flatnonzero(new) + 1, table.num_rows]


class _Forest:
    """Disjoint sets over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _alike(least: float):
    """Edges of a spanning forest of each group's nodes with an estimated similarity of at least `least`."""
    need = int(np.ceil(least * _K))

    def run(batches):
        for table in _grouped(batches, 3):
            k = np.asarray(table.column("k"))
            cuts = _cuts(table, 3)
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            data = b"".join(table.column("signature").to_pylist())
            signature = np.frombuffer(data, np.uint16).reshape(-1, _K)
            forest, root, edges = _Forest(len(k)), np.arange(len(k)), []
            for d in range(1, int(np.diff(cuts).max())):
                i = np.flatnonzero((group[:-d] == group[d:]) & (root[:-d] != root[d:]))
                if not len(i):
                    continue
                i = i[(signature[i] == signature[i + d]).sum(1) >= need]
                changed = False
                for a in i.tolist():
                    if forest.join(a, a + d):
                        edges.append((a, a + d))
                        changed = True
                if changed:
                    root = np.array(forest.up)
                    while (fresh := root[root]).tolist() != root.tolist():
                        root = fresh
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(k[e[:, 0]]), pa.array(k[e[:, 1]])], names=["a", "b"])

    return run


def _sets(size: int):
    """The shingle set of each node of a cluster, from its representative's text."""

    def run(batches):
        for whole in batches:
            for batch in X.slices(whole):
                h, offsets = _shingles(batch.column(0), size)
                some = np.flatnonzero(np.diff(offsets))
                key = np.zeros(batch.num_rows, np.int64)
                if len(some):
                    key[some] = _identity(h, offsets, some).view(np.int64)
                same = pa.array((key == np.asarray(batch.column(1))) & (np.diff(offsets) > 0))
                sets = pa.array([h[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], sets], names=[*batch.schema.names[1:], "shingles"]).filter(same)

    return run


def shared(sets: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """How many elements each two sets have in common. Sets rise."""
    m = len(sets)
    if m == 2:
        small, large = sorted(sets, key=len)
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        n = int((large[at] == small).sum())
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.r_[True, every[1:] != every[:-1]]
    element = np.cumsum(new) - 1
    common = np.bincount(element) > 1
    keep = common[element]
    number = (np.cumsum(common) - 1)[element[keep]]
    owner = owner[keep]
    out = np.zeros((m, m))
    for a in range(0, int(common.sum()), columns):
        lo, hi = np.searchsorted(number, [a, a + columns])
        part = np.zeros((m, min(columns, int(common.sum()) - a)), np.float32)
        part[owner[lo:hi], number[lo:hi] - a] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verified(threshold: float):
    """For each node of each pair of blocks its links there (copies counted), and the root of its component."""

    def run(batches):
        for table in _grouped(batches, 3):
            k, block, copies = (np.asarray(table.column(c)) for c in ("k", "block", "copies"))
            i, j = np.asarray(table.column("i")), np.asarray(table.column("j"))
            sets = [np.frombuffer(s, X.U64) for s in table.column("shingles").to_pylist()]
            cuts = _cuts(table, 3).tolist()
            links, root = np.zeros(len(k), np.int64), k.copy()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                n = shared(sets[a:b])
                size = np.diag(n)
                linked = n >= threshold * (size[:, None] + size[None, :] - n) - 1e-9
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:
                    linked &= block[a:b, None] != block[None, a:b]
                links[a:b] = linked @ copies[a:b]
                forest = _Forest(b - a)
                low = np.where(linked.any(1), linked.argmax(1), np.arange(b - a))
                for x, y in enumerate(low.tolist()):
                    forest.join(x, y)
                tops = np.array([forest.root(x) for x in range(b - a)])
                for x, y in zip(*np.nonzero(linked & (tops[:, None] != tops[None, :])), strict=True):
                    forest.join(int(x), int(y))
                root[a:b] = k[a:b][[forest.root(x) for x in range(b - a)]]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(links[some]), pa.array(root[some])], names=["k", "links", "root"])

    return run


def _dealt(rows: DataFrame, size: str) -> DataFrame:
    """rows with i, j, block: each row of a group of more than BLOCK goes to every pair of blocks that holds its own."""
    blocks = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("k"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    wide = own.select("*", other)
    return wide.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", size)


def _spread(dealt: DataFrame) -> DataFrame:
    """dealt rows sorted by g, i, j, each pair of blocks in one task. The pairs of a group are counted through, so they go to tasks in
    turn, and no two of a group share a task before every task has one."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.xxhash64("g") % F.lit(1 << 40) + (F.col("j").cast("long") * (F.col("j") + 1)) / F.lit(2) + F.col("i")
    return dealt.repartitionById(n, F.pmod(turn.cast("long"), F.lit(n)).cast("int")).sortWithinPartitions("g", "i", "j")


def _prefix(d: int | Column) -> Column:
    """The first d minima of a path, with its tree."""
    return F.substring("path", 1, 1 + 2 * d) if isinstance(d, int) else F.col("path").substr(F.lit(1), 1 + 2 * d)


def _buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """Of rows(k, path): g, k and m, the nodes of each shared prefix g with their number."""
    top = depth(threshold)
    low = max(1, top - SHORTER)
    shared_ = rows.groupBy(_prefix(low).alias("p")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = rows.withColumn("p", _prefix(low)).join(shared_, "p")
    found = rows.where(F.col("m") <= CROWDED).select(F.xxhash64("p").alias("g"), "k", "m")
    if low == top:
        return found.unionByName(rows.where(F.col("m") > CROWDED).select(F.xxhash64("p").alias("g"), "k", "m"))
    rows = rows.where(F.col("m") > CROWDED).select("k", _prefix(top).alias("path"))
    leaves = level = rows.groupBy("path").agg(F.count(F.lit(1)).alias(f"c{top}"))
    for d in range(top - 1, low, -1):
        level = level.groupBy(_prefix(d).alias("path")).agg(F.sum(f"c{d + 1}").alias(f"c{d}"))
        leaves = leaves.withColumn("p", _prefix(d)).join(level.withColumnRenamed("path", "p"), "p").drop("p")
    deep, size = F.lit(top), F.col(f"c{top}")
    for d in range(top - 1, low, -1):
        roomy = F.col(f"c{d}") <= CROWDED
        deep, size = F.when(roomy, F.lit(d)).otherwise(deep), F.when(roomy, F.col(f"c{d}")).otherwise(size)
    leaves = leaves.select("path", deep.alias("d"), size.alias("m")).where("m > 1")
    return found.unionByName(rows.join(leaves, "path").select(F.xxhash64(_prefix(F.col("d"))).alias("g"), "k", "m"))


def _joined(docs: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text, row): doc_id, row and node k of each row; and for each node k its class_id, the row
    that represents its class, n_links and copies c."""
    sketch = X.written(docs.select("doc_id", "text", "row").mapInArrow(_sketch(size), "doc_id long, row long, k long, signature binary, paths array<binary>"), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = X.written(sketch.where("k is not null").groupBy("k").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("paths").alias("paths")), "nodes")
    keys = X.written(sketch.select("doc_id", "row", "k"), "keys")
    X.drop(sketch)

    buckets = _buckets(nodes.select("k", F.explode("paths").alias("path")), threshold)
    members = buckets.join(nodes.select("k", "signature"), "k")
    dealt = _spread(_dealt(members, "m").select("g", "i", "j", "k", "signature"))
    near = X.components(dealt.mapInArrow(_alike(threshold - DEVIATIONS * (threshold * (1 - threshold) / _K) ** 0.5), "a long, b long"))

    clusters = X.written(near.select(F.col("node").alias("k"), F.col("root").alias("g")), "clusters")
    sizes = clusters.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    members = clusters.join(sizes, "g").join(nodes.select("k", "first.row", "copies"), "k")
    sets = members.join(docs.select("row", "text"), "row").select("text", "k", "g", "m", "copies")
    sets = sets.mapInArrow(_sets(size), "k long, g long, m long, copies long, shingles binary").dropDuplicates(["k"])
    dealt = _spread(_dealt(sets, "m").select("g", "i", "j", "k", "block", "copies", "shingles"))
    verified = X.written(dealt.mapInArrow(_verified(threshold), "k long, links long, root long"), "verified")

    joined = X.components(verified.select(F.col("k").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("k").agg(F.sum("links").alias("links"))
    own = nodes.select("k", "first", "copies").join(joined.select(F.col("node").alias("k"), "root"), "k", "left").join(links, "k", "left")
    own = own.withColumn("root", F.coalesce("root", "k"))
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    own = own.join(least, "root").select("k", F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("row"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("c"))
    own = X.written(own, "classes")
    X.drop(nodes, clusters, verified)
    return keys, own


def classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row for each row of docs(doc_id, text)."""
    docs, _ = X.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows, own = _joined(docs, size, threshold)
    rows = rows.drop("row")
    known = X.join_counted(rows.where("k is not null"), own.drop("row"), ["k"], rows.count()).select("doc_id", "class_id", "n_links", F.col("c").alias("n_copies"))
    one = rows.where("k is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return known.unionByName(one)


def representatives(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, the one with the least doc_id, then row key; all columns kept."""
    docs, row = X.keyed(docs)
    rows, own = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row).alias("row")), size, threshold)
    kept = own.select("row").distinct().unionByName(rows.where("k is null").select("row"))
    return docs.join(kept.withColumnRenamed("row", row), row, "left_semi").drop(row)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(X.read(spark, sf_dir, "documents"))
