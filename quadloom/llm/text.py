"""Vectorised text primitives and Spark helpers shared by the operators of this subpackage.

A text column arrives as an Arrow string array; the functions here work on its UTF-8 buffer with
numpy, a bounded slice of rows at a time, so no Python object is made for a word. Nulls are empty.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
SLICE_BYTES = 2_000_000
BATCH_ROWS = 2000
#: Characters of one document that a model is fitted on at most; a random passage where it has more.
LONGEST_SAMPLE = 100_000
U64 = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: The white space of a word split: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only a session in one process (master local) that names none gets one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault("dir", "file://" + os.path.join(tempfile.gettempdir(), f"quadloom-{uuid.uuid4().hex}"))
    return found.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Python workers get batches of at most BATCH_ROWS rows, so that long texts don't add up (a setting of the session)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read again. It survives lost executors and goes with the application."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.table = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written() tables that all of what reads them is written too, and lets Spark clean the shuffles behind them."""
    for t in tables:
        place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.table)
        place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """name, with signs added until no column of df is called so."""
    while name in map(str.lower, df.columns):
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, written so that it stays, and the name of that column."""
    row = unused(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Parts of a batch whose texts have at most `most` bytes, or a single row."""
    i = batch.schema.get_field_index(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (made[0], made[1])
        if size > 1 << 24:
            del _POWERS[base]  # one very long text should not keep its table alive
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i and the inverse powers: a rolling polynomial hash."""
    p, inverse = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[:-1], out=sums[1:])
    return sums, inverse


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each row's first word (n + 1 numbers)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each word's bytes. base: odd."""
    sums, inverse = prefix(data.astype(U64) + U64(1), base)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


class Rolling:
    """Hashes of runs of words."""

    def __init__(self, hashes: np.ndarray, base: int = _WORD_BASE):
        self.sums, self.inverse = prefix(hashes, base)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64) * U64(0x9FB21C651E98DF25))


def windows(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of all runs of k words inside one row. first: as of words()."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for back in range(1, k):  # the last k - 1 words of a row start no window
        at = first[1:] - back
        ok[at[at >= first[:-1]]] = False
    return np.flatnonzero(ok)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] numbers), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def chance(*columns: str) -> Column:
    """A number in [0, 1) by hash. With an id among the columns equal texts have numbers of their own."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def hash_sample(docs: DataFrame, most: int, longest: int = LONGEST_SAMPLE) -> list[str]:
    """About `most` texts at most of docs(doc_id, text), picked by hash, a random passage of at most `longest` characters of
    each: the driver gets no more, whatever the input. For fitting models only."""
    bounded(docs.sparkSession)
    n = docs.count()
    start = (F.greatest(F.length("text") - longest, F.lit(0)) * F.pmod(F.xxhash64("text"), F.lit(1000)) / 1000).cast("int") + 1
    rows = docs.select(F.substring(F.col("text"), start, F.lit(longest)).alias("text"), chance("doc_id", "text").alias("h")).where(F.col("h") < min(1.0, 1.2 * most / max(n, 1))).orderBy("h", "text").limit(most).collect()
    return [r.text for r in rows]


def crc_text(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, share: int = 10_000) -> DataFrame:
    """rows joined with keyed on keys, where keyed holds each key once with its number of rows `c`, `total` in all.

    Keys with more than a `share`-th of all rows, so fewer than `share` of them, are broadcast and their rows stay where they
    are; only the others, none of which can crowd a task, are shuffled.
    """
    limit = max(1000, total // share)
    hot = F.broadcast(keyed.where(F.col("c") > limit))
    cold = keyed.where(F.col("c") <= limit)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges(a, b): node and its component's least node, for every node with an edge.

    Alternating large-star and small-star steps of joins and aggregates; the edge list stays a table
    of at most as many rows as given, written to the shared folder each round.
    """
    least, most = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = written(edges.where("a <> b").select(most, least).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, now = now, written(small, "edges")
        drop(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("root"))
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(root.join(now.select(F.col("a").alias("node")), "node", "left_anti"))
