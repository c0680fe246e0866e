"""Files brought to a folder as a stream, each once, by a ledger of what has been brought.

A stream of (path, name) says what to bring and what to call it. Each micro-batch is copied by
tasks, piece by piece, under a name of the task's own, and renamed when it is whole; then its
entries are added to the ledger, under the batch's number. A batch that is run again, after a
failure or without its checkpoint, copies only what no entry tells of with that path, name, size
and time of change, so what has been entered is never brought twice; what a failure kept from
being entered is brought anew, under the same name and with the same bytes.

A path that is not there is entered as missing and skipped; it is tried again when it is asked
for again. A batch that asks for a name more than once takes the last path in order; null paths or
names are skipped. The target is a folder URI that the executors can reach by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The ledger's folder in the target, one folder in it for each batch.
LEDGER = "_ledger"
ENTRY = "path string, name string, status string, bytes long, changed string"
#: Bytes that are held while a file is copied.
PIECE = 4 << 20


def _copied(target: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = fs.FileSystem.from_uri(target)
        for batch in batches:
            entries = []
            for path, name, size, changed in zip(batch["path"], batch["name"], batch["bytes"], batch["changed"], strict=True):
                source, at = fs.FileSystem.from_uri(path)
                info = source.get_file_info(at)
                if info.type != fs.FileType.File:
                    entries.append((path, name, "missing", 0, None))
                    continue
                time = str(info.mtime_ns)
                if info.size == size and time == changed:
                    continue
                place = f"{folder}/{name}"
                part = f"{place}.part-{TaskContext.get().taskAttemptId()}"
                files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with source.open_input_stream(at) as reader, files.open_output_stream(part) as writer:
                    while piece := reader.read(PIECE):
                        writer.write(piece)
                files.move(part, place)
                entries.append((path, name, "uploaded", info.size, time))
            yield pd.DataFrame(entries, columns=["path", "name", "status", "bytes", "changed"])

    return run


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """(batch, path, name, status, bytes, changed): all that has been brought, and what was missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{LEDGER}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"batch long, {ENTRY}")
    return spark.read.schema(f"{ENTRY}, batch long").option("basePath", f"{target}/{LEDGER}").parquet(f"{target}/{LEDGER}").select("batch", *[c.split()[0] for c in ENTRY.split(", ")])


def bring(files: DataFrame, batch: int, target: str) -> None:
    """One batch of files(path, name): what the ledger lacks is copied, then entered."""
    spark = files.sparkSession
    # By name, so that two tasks never write the same one.
    asked = files.where("path is not null and name is not null").groupBy("name").agg(F.max("path").alias("path"))
    held = ledger(spark, target).where("status = 'uploaded'").groupBy("name", "path").agg(F.max_by(F.struct("bytes", "changed"), "batch").alias("last"))
    open_ = asked.join(held, ["name", "path"], "left").select("path", "name", F.col("last.bytes").alias("bytes"), F.col("last.changed").alias("changed"))
    entries = open_.mapInPandas(_copied(target), ENTRY)
    entries.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").partitionBy("batch").parquet(f"{target}/{LEDGER}")


def upload(files: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Brings the files of streaming files(path, name) to target: all there are, and then stops, or every so often."""
    writer = files.select("path", "name").writeStream.foreachBatch(lambda batch, number: bring(batch, number, target)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
