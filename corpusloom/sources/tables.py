"""Reading documents, shards and results."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import mixture


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_stream(docs: DataFrame, preferred: str | None = None, order_column: str = "doc_id") -> DataFrame:
    """(order, text): the first text column that is not empty; rows without one go."""
    return docs.select(order_column, mixture.text_of(docs.columns, preferred).alias("text")).where("text is not null")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written shard folder; one without shards is an error."""
    # A listing task for each folder would cost more than all listing: four tasks a core share them.
    tasks, name = 4 * spark.sparkContext.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), tasks))
    try:
        out = spark.read.parquet(path)
    finally:
        spark.conf.set(name, before)
    # One row of the first files that have one; isEmpty has a task look into each file.
    if not out.select(F.lit(1)).take(1):
        raise FileNotFoundError(f"no shards in {path}")
    return out


def npy_shards(spark: SparkSession, path: str, pattern: str = "shard_*.npy") -> DataFrame:
    """(shard_id, tokens) of flat unsigned 16-bit .npy files, numbered by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                tokens = np.load(io.BytesIO(raw)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(name.rpartition("_")[2])], pa.int32()), pa.array([tokens], pa.list_(pa.int64()))], ["shard_id", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name"), "content")
    return named.mapInArrow(run, "shard_id int, tokens array<long>")


def token_count(stored: DataFrame) -> DataFrame:
    """(shard_id, n_tokens) from the shard table's span lengths alone."""
    return stored.groupBy("shard_id").agg(F.sum("length").alias("n_tokens"))


def latest_results(spark: SparkSession, path: str) -> str:
    """The last results_*.json under path by name, else the last *.json."""
    for pattern in ("results_*.json", "*.json"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        found = files.agg(F.max("path")).first()[0]
        if found:
            return found
    raise FileNotFoundError(f"no results in {path}")


def eval_json(spark: SparkSession, path: str) -> DataFrame:
    """(run, json) of result files, named by their file names."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("run"), F.col("value").alias("json"))
