"""Writing shards, manifests, results and logs."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import encode
from corpusloom.operators import shards
from corpusloom.sources import tables
from corpusloom.sources.scratch import new_path as scratch

__all__ = ["append_metrics", "check_writable", "copy_results", "read_manifest", "require_output", "scratch", "write_manifest", "write_npy_shards", "write_results", "write_shards"]


def write_shards(cut: DataFrame, path: str, ids=None) -> None:
    """One folder per shard with its spans (doc_id, offset, length, ids), in order.

    A shard is one task's work, its spans are rows: no shard is ever one value. Code points, the
    default, are made of the spans' texts behind the shuffle, which moves no ids.
    """
    made = shards.span_text() if ids is None else shards.span_ids(ids)
    rows = cut.select("shard_id", "offset", "length", "doc_id", made.alias("ids")).repartition("shard_id")
    rows = rows.withColumn("ids", encode.code_points(F.col("ids"))) if ids is None else rows
    rows.sortWithinPartitions("shard_id", "offset").write.partitionBy("shard_id").parquet(path)


def write_npy_shards(cut: DataFrame, path: str, size: int, ids=None) -> None:
    """Full shards as flat unsigned 16-bit `shard_0000.npy` files, for readers of that layout.

    path is a URI that executors can reach by themselves. A shard is one task's work and is
    written span by span, so it is never one value; it gets its name when it is whole. A
    token that does not fit, or a shard of another size, is an error.
    """
    rows = cut.select("shard_id", "offset", shards.span_ids(ids).alias("ids"))
    dealt = rows.repartition("shard_id").sortWithinPartitions("shard_id", "offset")
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<u2", "fortran_order": False, "shape": (size,)})
    header = head.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        shard, out, at = None, None, 0
        part = f"{folder}/.part-{TaskContext.get().taskAttemptId()}"

        def close() -> None:
            if out is not None:
                out.close()
                if at != size:
                    raise ValueError(f"shard {shard} has {at} tokens and not {size}")
                files.move(part, f"{folder}/shard_{shard:04d}.npy")

        done = []
        for batch in batches:
            for number, tokens in zip(batch.column("shard_id").to_pylist(), batch.column("ids"), strict=True):
                if number != shard:
                    close()
                    shard, out, at = number, files.open_output_stream(part), 0
                    out.write(header)
                    done.append(number)
                values = tokens.values.to_numpy()
                if len(values) and not 0 <= values.min() <= values.max() < 1 << 16:
                    raise ValueError(f"shard {shard} has a token beyond 16 bits")
                out.write(values.astype("<u2").tobytes())
                at += len(values)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["shard_id"])

    dealt.mapInArrow(run, "shard_id long").write.format("noop").mode("overwrite").save()


def copy_results(spark: SparkSession, folder: str, target: str) -> str:
    """The latest result file under a harness's output folder, copied to target; its path."""
    found = tables.latest_results(spark, folder)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, place = hadoop.Path(found), hadoop.Path(target)
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, place.getFileSystem(conf), place, False, True, conf)
    return found


def write_manifest(spark: SparkSession, path: str, **fields) -> None:
    """A JSON object with the fields and the time, UTC."""
    value = json.dumps({**fields, "written_at": datetime.now(UTC).isoformat()}, sort_keys=True)
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def check_writable(spark: SparkSession, path: str) -> None:
    """Fails before the long work if path's folder cannot be written; leaves nothing behind."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}.probe-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.create(target).close()
    files.delete(target, False)


def require_output(shards_written: int) -> None:
    if shards_written <= 0:
        raise RuntimeError("no shard was written: the stream is shorter than one shard")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def append_metrics(log: DataFrame, path: str, every: int = 1) -> None:
    """Appends log(step, metric, value) at every so many steps."""
    log.where(F.col("step") % every == 0).select("step", "metric", "value").write.mode("append").parquet(path)
