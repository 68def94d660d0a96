"""Structured Streaming into an index: each micro-batch is one upsert, told apart by its number so that a repeat changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import parse_lines
from ..sources.index import Index


def documents(spark: SparkSession, folder: str, index: Index) -> DataFrame:
    """A stream of JSON-lines files as they arrive, read with the declared schema."""
    return parse_lines(spark.readStream.text(folder), index.schema)


def upsert_batch(index: Index):
    """For foreachBatch: a batch is committed as a whole, or not at all if one of its documents breaks the schema."""

    def run(batch: DataFrame, number: int) -> None:
        done = index.folder.read("stream.txt") if index.folder.exists("stream.txt") else "-1"
        if number <= int(done):
            return
        try:
            index.add_frame(batch)
            index.commit()
        except Exception:
            index.rollback()
            raise
        index.folder.write("stream.txt", str(number))

    return run


def ingest(spark: SparkSession, folder: str, index: Index, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = documents(spark, folder, index).writeStream.foreachBatch(upsert_batch(index)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
