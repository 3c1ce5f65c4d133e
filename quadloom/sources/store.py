"""A quad store: folders of parquet files, partitioned by predicate, and the list of those that make the current version.

A commit writes a folder beside the others and then renames a small file, the list of folders, onto `_current`; readers see one
whole version or the other. An append writes only the quads that are new and adds their folder to the list; a commit, or
an append past MOST_FOLDERS, writes all quads as one folder. A constant predicate reads its own files alone. Any file
system that Spark writes to will do.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.engine import Engine
from quadloom.sources import rdf


MOST_FOLDERS = 32
_ALL = ["g", "s", "p", "o"]


class Store:
    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        """The folders of the current version, one on a line."""
        fs, p = self._fs(f"{self.path}/_current")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def quads(self) -> DataFrame:
        """The current version."""
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], R.QUADS)
        parts = [self.spark.read.schema(R.QUADS).option("basePath", f"{self.path}/{x}").parquet(f"{self.path}/{x}").select(*_ALL) for x in v.split("\n")]
        return reduce(DataFrame.unionAll, parts)

    def _write(self, quads: DataFrame) -> str:
        """A folder of quads, clustered by predicate and sorted by subject and object. A predicate that many triples share is
        dealt over tasks as adaptive execution sees fit, small ones share a task."""
        v = f"v-{uuid.uuid4().hex}"
        out = quads.dropDuplicates(_ALL).hint("rebalance", "p").sortWithinPartitions("p", "s.lex", "o.lex")
        out.write.partitionBy("p").parquet(f"{self.path}/{v}")
        return v

    def commit(self, quads: DataFrame) -> str:
        """Makes quads the current version."""
        return self._switch(self._write(quads))

    def append(self, quads: DataFrame) -> str:
        """Adds quads to the current version; only those that it lacks are written."""
        now = self.version()
        if now is None:
            return self.commit(quads)
        if now.count("\n") + 2 > MOST_FOLDERS:
            return self.commit(self.quads().unionByName(quads.select(*_ALL)))
        key = F.xxhash64(*_ALL)
        fresh = quads.select(*_ALL).dropDuplicates(_ALL).withColumn("h", key)
        known = self.quads().join(fresh.select("p").distinct(), "p", "left_semi").select(*(F.col(c).alias("_" + c) for c in _ALL), key.alias("_h"))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col("_" + c)) for c in _ALL), F.col("h") == F.col("_h"))
        return self._switch(f"{now}\n{self._write(fresh.join(known, same, 'left_anti').select(*_ALL))}")

    def _switch(self, v: str) -> str:
        fs, p = self._fs(f"{self.path}/_next-{uuid.uuid4().hex}")
        stream = fs.create(p, True)
        stream.write(bytearray(v.encode()))
        stream.close()
        _, current = self._fs(f"{self.path}/_current")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        choice = self.spark.sparkContext._gateway.new_array(rename, 1)
        choice[0] = rename.OVERWRITE
        context.rename(p, current, choice)
        return v

    def vacuum(self) -> int:
        """Deletes folders that the current version does not name."""
        fs, p = self._fs(self.path)
        now, n = (self.version() or "").split("\n"), 0
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith(("v-", "_next-")) and name not in now:
                fs.delete(s.getPath(), True)
                n += 1
        return n

    def engine(self) -> Engine:
        return Engine(self.spark, {}, self.quads(), **self.options)

    def load(self, path: str, form: str = "auto", graph: str = R.DEFAULT_GRAPH, replace: bool = False, dry_run: bool = False, index_text: bool = True) -> int | str:
        """Imports a file or folder. Returns the version; with dry_run the number of quads, and nothing is written."""
        from quadloom.functions.fulltext import derived
        from quadloom.operators.update import put_graph

        fresh = rdf.read(self.spark, path, form, graph)
        if dry_run:
            return fresh.count()
        now = self.quads()
        if index_text:
            fresh = fresh.unionByName(derived(fresh, now.unionByName(fresh)))
        return self.commit(put_graph(now, graph, fresh)) if replace else self.append(fresh)

    def update(self, text: str, **options) -> str:
        """Runs an update and commits its outcome once."""
        return self.commit(self.engine().update(text, **options).quads)

    def query(self, text: str):
        return self.engine().query(text)
