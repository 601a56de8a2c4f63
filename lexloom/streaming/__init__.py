"""Streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.summarize import summarize
from ..sources.formats import PROCESSED


def read_documents(spark: SparkSession, folder: str, schema: str = PROCESSED, files: int = 100) -> DataFrame:
    """A stream of JSON-lines documents from a folder, at most ``files`` files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def summarize_stream(stream: DataFrame, cfg, path: str, checkpoint: str, available_now: bool = True):
    """Append the summaries of a stream to parquet.

    Every operator is local to a document, so the stream keeps no state and needs no watermark; the
    sink's log makes it exactly once.
    """
    writer = summarize(stream, cfg).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
