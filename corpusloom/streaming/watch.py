"""Watching a folder: each new file is handled once, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def files_as_they_come(spark: SparkSession, folder: str, pattern: str = "*.pt") -> DataFrame:
    """(path, modificationTime, length) of the folder's files, as a stream; contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return stream.select("path", "modificationTime", "length")


def watch(files: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Hand each batch of new files to `handle`; all there is and then stop, or every so often.

    The checkpoint's log of seen files outlives a restart. A file's batch is handled again if
    it failed, so `handle` should be idempotent by path.
    """
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
