"""Operator 1, training-order materialisation: fixed-stride token shards in a keyed order.

Each task tokenises its rows, ends each document with an id and cuts the stream into
sequences, the task's last one padded, which are stored with their number in the task. Sequences
are numbered through all tasks: the stored ones of each task are counted, and the driver sums
one figure per task. A Feistel network
over the smallest even-bit domain that holds all numbers, walked until it lands below their
count, is a keyed bijection; it gives each sequence its slot. Slots are dealt out by range,
each range sorted by slot and written as shards of equal-sized records, so that record i
of the training order lies at a known offset of a known shard, and reading can start or
resume anywhere. The inverse walk recovers a slot's sequence.

Spark's own text writer writes the shards (any store, committed per task): a record's bytes
are the line, and the line end is its trailer. `read` takes them back record by record by
Hadoop's fixed-length input, which splits a shard at record boundaries, so no task ever
holds a shard; `stream` is a trainer's reader without Spark, which seeks to its first record
and reads on. Texts are read and tokenised once: slots are given to what was stored then, so docs
may be anything, even if its tasks don't repeat exactly. The stored sequences are deleted at the end.

A record: slot, sequence number and doc_id of the first token's document (int64; the least one if
null), that token's place in it, number of ids (uint32), all of these big-endian; then the ids
(uint16, little-endian, padded) and the trailer. Vocabularies of more than 65,536 ids are refused.

Defined results: a null or empty text is its closing id alone; rows that repeat are written
each for itself; an empty table has no records; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import storage, textvec, wordbpe, workers

SEQUENCE = 2048
END_ID = 1
PAD_ID = 0
RECORDS = 8192
ROUNDS = 6
KEY = 20_240_229

#: How sequences are stored until their slots are known: beside them, shuffle and shards take
#: two and a quarter times the table, so they are packed closer than by default.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": 6, "parquet.page.size": 8 << 20, "parquet.enable.dictionary": "false"}

#: Bytes of records that a writing task sorts, in as many whole shards as that takes.
TASK_BYTES = 1 << 28

HEAD = np.dtype([("slot", ">i8"), ("sequence_id", ">i8"), ("doc_id", ">i8"), ("start", ">u4"), ("n_ids", ">u4")])
TRAILER = "\r\n"
NO_DOC = -(1 << 63)


class Feistel:
    """Keyed bijection of [0, count)."""

    def __init__(self, count: int, key: int, rounds: int = ROUNDS):
        self.count = count
        self.half = max(1, -(-max(1, (count - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = textvec.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _pass(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (textvec.mix(right + k) & self.mask)
        # The halves change places once more, so that reversed keys undo it.
        return right << np.uint64(self.half) | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._pass(x.astype(np.uint64), keys)
        while (far := np.flatnonzero(out >= self.count)).size:
            out[far] = self._pass(out[far], keys)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


@dataclass
class Layout:
    """What a reader needs to know; stored beside the shards."""

    path: str
    count: int
    key: int
    sequence: int
    records: int

    @property
    def stride(self) -> int:
        return HEAD.itemsize + 2 * self.sequence + len(TRAILER)

    @property
    def shards(self) -> int:
        return -(-self.count // self.records)

    def save(self, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(f"{self.path}/layout")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Layout:
        return cls(**json.loads(spark.read.text(f"{path}/layout").first()[0]))


def _raw(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of equally long binary values, one row each."""
    return textvec.buffer_of(column)[0].reshape(len(column), width)


def _binary(raw: np.ndarray) -> pa.Array:
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))])
    return flat.cast(pa.binary())


def _sequences(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, pad_id: int) -> DataFrame:
    """Each task's sequences, numbered from zero: records without slot and sequence number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, number = wordbpe.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        rest, rest_docs, rest_starts, rest_begins = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def table(stream: np.ndarray, docs_: np.ndarray, starts: np.ndarray, begins: np.ndarray, n: int, number: int) -> pa.RecordBatch:
            """n records from the stream's begin; begins: where in it each document begins."""
            size = np.minimum(length, len(stream) - length * np.arange(n))
            ids = np.full((n, length), pad_id, "<u2")
            ids.reshape(-1)[: int(size.sum())] = stream[: int(size.sum())]
            owner = np.searchsorted(begins, length * np.arange(n), side="right") - 1
            head = np.zeros(n, HEAD)
            head["doc_id"], head["start"], head["n_ids"] = docs_[owner], starts[owner] + length * np.arange(n) - begins[owner], size
            raw = np.concatenate([head.view(np.uint8).reshape(n, -1), ids.view(np.uint8).reshape(n, -1)], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), pa.array(np.arange(number, number + n)), _binary(raw)], ["task", "number", "record"])

        for batch in batches:
            for part in textvec.chunks(batch):
                ids, at = encoder.encode(part.column("text"))
                size = np.diff(at) + 1
                stop = np.cumsum(size)
                new = np.empty(int(stop[-1]) if len(stop) else 0, np.uint16)
                new[stop - 1] = end_id
                new[textvec.ranges(stop - size, size - 1)] = ids
                doc = part.column("doc_id").fill_null(NO_DOC).to_numpy()
                begins = np.concatenate([rest_begins, len(rest) + stop - size])
                docs_, starts = np.concatenate([rest_docs, doc]), np.concatenate([rest_starts, np.zeros(len(doc), np.int64)])
                stream = np.concatenate([rest, new])
                n = len(stream) // length
                if n:
                    yield table(stream[: n * length], docs_, starts, begins, n, number)
                    number += n
                    last = max(0, int(np.searchsorted(begins, n * length, side="right")) - 1)
                    begins, docs_, starts = begins[last:] - n * length, docs_[last:], starts[last:].copy()
                    if begins[0] < 0:
                        starts[0] -= begins[0]
                        begins[0] = 0
                rest, rest_docs, rest_starts, rest_begins = stream[n * length :], docs_, starts, begins
        if len(rest):
            yield table(rest, rest_docs, rest_starts, rest_begins, 1, number)

    return docs.select("doc_id", "text").mapInArrow(workers.tidy(run), "task int, number long, record binary")


def _slotted(stored: DataFrame, layout: Layout, before: np.ndarray) -> DataFrame:
    """The stored sequences with their slots; before: sequences of the tasks in front of each."""
    # Eight bytes a task, fetched once by an executor and not by each task.
    shared = stored.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Feistel(layout.count, layout.key)
        for batch in batches:
            numbers = shared.value[batch.column("task").to_numpy()] + batch.column("number").to_numpy()
            slot = order.slot(numbers)
            raw = _raw(batch.column("record"), layout.stride - len(TRAILER)).copy()
            for name, value in (("slot", slot), ("sequence_id", numbers)):
                kind, at = HEAD.fields[name][:2]
                raw[:, at : at + kind.itemsize] = value.astype(kind)[:, None].view(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(slot), _binary(raw)], ["slot", "record"])

    return stored.mapInArrow(workers.tidy(run), "slot long, record binary")


def materialise(docs: DataFrame, tokenizer_path: str, path: str | None = None, key: int = KEY, sequence: int = SEQUENCE, records: int = RECORDS, end_id: int = END_ID, pad_id: int = PAD_ID) -> Layout:
    """Write the shards under path (by default in the shared folder)."""
    spark = docs.sparkSession
    path = path or storage.new_path(spark, "training-order")
    sequences = f"{path}/sequences"
    try:
        made = _sequences(docs, tokenizer_path, sequence, end_id, pad_id)
        made.write.options(**STORED).parquet(sequences)
        stored = spark.read.schema(made.schema).parquet(sequences)
        found = stored.groupBy("task").count().collect()
        counts = np.zeros(max((r["task"] for r in found), default=-1) + 1, np.int64)
        for r in found:
            counts[r["task"]] = r["count"]
        layout = Layout(path, int(counts.sum()), key, sequence, records)
        if layout.count:
            _write(_slotted(stored, layout, np.cumsum(counts) - counts), layout)
    finally:
        storage.delete(spark, sequences)
    layout.save(spark)
    return layout


def _write(slotted: DataFrame, layout: Layout) -> None:
    # A task writes as many neighbouring shards as keep all of the session's tasks busy, up to TASK_BYTES.
    wanted = int(slotted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(-(-layout.count * layout.stride // TASK_BYTES), min(layout.shards, wanted))
    together = -(-layout.shards // tasks)
    made = slotted.withColumn("shard", F.floor(F.col("slot") / layout.records).cast("int")).withColumn("task", F.floor(F.col("shard") / together).cast("int"))
    dealt = made.repartitionById(-(-layout.shards // together), "task").sortWithinPartitions("shard", "slot")
    dealt.select(F.col("record").cast("string"), "shard").write.partitionBy("shard").option("lineSep", TRAILER).text(f"{layout.path}/shards")


def _records(spark: SparkSession, layout: Layout, low: int, high: int) -> DataFrame:
    """The stored records of the shards from low to high, each a binary value."""
    shards = ["shard=*"] if high - low + 1 == layout.shards else [f"shard={k}" for k in range(low, high + 1)]
    paths = ",".join(f"{layout.path}/shards/{s}/part-*" for s in shards)
    stored = spark._jsc.binaryRecords(paths, layout.stride).rdd()
    return DataFrame(spark._jsparkSession.createDataset(stored, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)


def read(spark: SparkSession, layout: Layout, begin: int = 0, end: int | None = None) -> DataFrame:
    """slot, sequence_id, shard, byte_offset, doc_id, start, n_ids, ids of the slots [begin, end).

    Only the shards that hold them are read; all of it are expressions on one record at a time.
    """
    end = layout.count if end is None else min(end, layout.count)
    schema = "slot long, sequence_id long, shard int, byte_offset long, doc_id long, start long, n_ids int, ids binary"
    if begin >= end:
        return spark.createDataFrame([], schema)
    value = F.col("value")
    number = lambda name: F.conv(F.hex(F.substring(value, HEAD.fields[name][1] + 1, HEAD.fields[name][0].itemsize)), 16, -10).cast("long")
    whole = F.substring(value, layout.stride - len(TRAILER) + 1, len(TRAILER)) == F.lit(TRAILER.encode())
    slot = F.when(whole, number("slot")).otherwise(F.raise_error(F.lit(f"a record is not of stride {layout.stride}")).cast("long"))
    stored = _records(spark, layout, begin // layout.records, (end - 1) // layout.records)
    found = stored.select("value", slot.alias("slot")).where(F.col("slot").between(begin, end - 1))
    n_ids = number("n_ids").cast("int")
    return found.select(
        "slot", number("sequence_id").alias("sequence_id"), F.floor(F.col("slot") / layout.records).cast("int").alias("shard"), (F.col("slot") % layout.records * layout.stride).alias("byte_offset"),
        F.nullif(number("doc_id"), F.lit(NO_DOC)).alias("doc_id"), number("start").alias("start"), n_ids.alias("n_ids"), F.substr(value, F.lit(HEAD.itemsize + 1), 2 * n_ids).alias("ids"),
    )


def stream(layout: Layout, open_shard: Callable[[int], BinaryIO], begin: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) of the slots [begin, end) in order, for a trainer: no Spark, one record in memory.

    open_shard gives a shard's file by its number. Nothing before the first record is read.
    """
    end = layout.count if end is None else min(end, layout.count)
    at = begin
    while at < end:
        shard, place = divmod(at, layout.records)
        with open_shard(shard) as f:
            f.seek(place * layout.stride)
            for at in range(at, min(end, (shard + 1) * layout.records)):  # noqa: B020
                raw = f.read(layout.stride)
                head = np.frombuffer(raw, HEAD, 1)[0]
                if head["slot"] != at or not raw.endswith(TRAILER.encode()):
                    raise ValueError(f"no record of slot {at} where it should be")
                yield at, np.frombuffer(raw, "<u2", int(head["n_ids"]), HEAD.itemsize)
        at += 1


def local_shards(layout: Layout) -> Callable[[int], BinaryIO]:
    """For `stream`, where the shards lie in a local folder."""
    top = Path(layout.path.removeprefix("file://"))
    return lambda shard: next((top / f"shards/shard={shard}").glob("part-*")).open("rb")
