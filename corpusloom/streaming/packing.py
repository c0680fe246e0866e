"""Packing a stream of documents that goes on: state keeps the position from batch to batch.

What passes through the state is (stream, order, n), some bytes a document: each stream's
documents of a micro-batch are placed behind those before, in their order, and the next free
position is kept. Placements are appended to a table by a file sink, exactly once, also across
restarts; texts never pass the state and meet their place in a join when shards are made. So a
shard that one batch leaves half full is rows of the table, and the next batch adds the rest.

A stream's documents of one batch are one task's work, as each place depends on all before; the
streams are spread. Batches have to come in the stream's order: a document that belongs before
one that is already placed is an error. Needs a state store of the RocksDB kind, which `place`
asks for while the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PLACEMENT = "stream string, doc_id long, n long, start long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Placer(StatefulProcessor):
    """Gives each document the tokens before it in its stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("position", "position long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("doc_id", kind="stable")
        position, last = self.kept.get() if self.kept.exists() else (0, None)
        if last is not None and len(batch) and batch["doc_id"].iloc[0] <= last:
            raise ValueError(f"document {batch['doc_id'].iloc[0]} of stream {key[0]} comes after {last} was placed")
        if len(batch):
            ends = position + batch["n"].cumsum()
            self.kept.update((int(ends.iloc[-1]), int(batch["doc_id"].iloc[-1])))
            yield pd.DataFrame({"stream": key[0], "doc_id": batch["doc_id"], "n": batch["n"], "start": ends - batch["n"]})

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """A query keeps the settings that it starts with; the caller's are put back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def place(documents: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends the placements of streaming documents(stream, doc_id, n) to target: of all there is,
    and then stops, or every so often."""
    keyed = documents.select("stream", "doc_id", "n").groupBy("stream")
    placed = keyed.transformWithStateInPandas(statefulProcessor=Placer(), outputStructType=PLACEMENT, outputMode="Append", timeMode="None")
    writer = placed.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    with _rocks(documents.sparkSession):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def placements(spark: SparkSession, target: str) -> tuple[DataFrame, dict[str, int]]:
    """What has been placed so far, and each stream's tokens."""
    held = spark.read.schema(PLACEMENT).parquet(target)
    from pyspark.sql import functions as F

    return held, {r["stream"]: r["total"] for r in held.groupBy("stream").agg(F.max(F.col("start") + F.col("n")).alias("total")).collect()}
