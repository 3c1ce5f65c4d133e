"""Continuous ingestion: files of N-Triples or N-Quads lines that arrive in a folder become quads of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quadloom import terms as R
from quadloom.sources.rdf import parsed_lines
from quadloom.sources.store import Store


def quad_stream(spark: SparkSession, folder: str, graph: str = R.DEFAULT_GRAPH, files_per_batch: int = 100) -> DataFrame:
    """A streaming DataFrame of the quads of new files in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parsed_lines(lines, graph)


def ingest(store: Store, quads: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Commits each micro-batch to the store; a batch that is replayed adds nothing, as quads are a set."""

    def commit(batch: DataFrame, _: int) -> None:
        store.append(batch)

    writer = quads.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
