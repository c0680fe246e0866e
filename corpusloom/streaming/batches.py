"""Training batches as a stream: a data source whose offset is the token position.

The checkpoint of a query that reads it is therefore the loader's state: a query that is started
again goes on with the batch behind the last one it has committed, without gap or repeat, and
what had been read ahead and not committed is read again, alike. Spark's own tasks read ahead.

Batches are cut from flat `shard_*.npy` files (unsigned 16-bit tokens) in the order of the
numbers in their names, so that shard_10000 follows shard_9999: `batch` rows of length + 1
tokens, running on from shard to shard; after the last token the stream starts over until
`epochs` are through, and an incomplete batch at the very end is not made.
Shards that appear while the query runs lengthen its last epoch, so they are for epochs=1.
With `until`, the stream ends at that token position: whoever starts it again may set another.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "batch_id long, row int, epoch long, tokens array<int>"
#: Batches that one task makes at least, and tasks of a micro-batch at most, if it has more than that.
AT_ONCE, TASKS = 64, 1_000


def _header(files: fs.FileSystem, path: str) -> tuple[int, int]:
    """(where the tokens begin, how many there are) of a .npy file; its tokens are not read."""
    with files.open_input_file(path) as f:
        start = f.read(10)
        if start[:6] != b"\x93NUMPY" or start[6] != 1:
            raise ValueError(f"{path} is no .npy file of version 1")
        size = int.from_bytes(start[8:10], "little")
        told = ast.literal_eval(f.read(size).decode("latin-1"))
    if told["descr"] != "<u2" or len(told["shape"]) != 1:
        raise ValueError(f"{path} holds no flat unsigned 16-bit tokens")
    return 10 + size, told["shape"][0]


@dataclass
class Shard:
    path: str
    begin: int
    tokens: int


def _numbered(name: str) -> tuple[list, str]:
    """Sorts names by their text and, where that is alike, by their numbers, however many digits these have."""
    return [int(x) if k % 2 else x for k, x in enumerate(re.split("([0-9]+)", name))], name


def shards_in(uri: str) -> list[Shard]:
    files, folder = fs.FileSystem.from_uri(uri)
    found = [i for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.startswith("shard_") and i.base_name.endswith(".npy")]
    if not found:
        raise FileNotFoundError(f"no shards in {uri}")
    return [Shard(i.path, *_header(files, i.path)) for i in sorted(found, key=lambda i: _numbered(i.base_name))]


@dataclass
class Span(InputPartition):
    """Batches from a global token position on, and the files that hold them, in order."""

    first: int
    batches: int
    shards: list[Shard]
    #: Where the first of the files begins in the stream, and the tokens of an epoch.
    before: int = 0
    total: int = 0


class BatchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.batch, self.length = options["path"], int(options["batch"]), int(options["length"])
        self.epochs, self.until = int(options.get("epochs", 1)), int(options["until"]) if options.get("until") else None
        self.begin = int(options.get("begin", 0))
        self.size = self.batch * (self.length + 1)

    def initialOffset(self) -> dict:
        return {"token": self.begin}

    def latestOffset(self) -> dict:
        total = sum(s.tokens for s in shards_in(self.uri)) * self.epochs
        end = total if self.until is None else min(total, self.until)
        return {"token": self.begin + max(0, end - self.begin) // self.size * self.size}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        held = shards_in(self.uri)
        count = max(0, end["token"] - start["token"]) // self.size
        each = max(AT_ONCE, -(-count // TASKS))
        return [span(held, start["token"] + k * self.size, min(each, count - k), self.size) for k in range(0, count, each)] or [Span(start["token"], 0, [])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        files, row = fs.FileSystem.from_uri(self.uri)[0], self.length + 1
        total = partition.total
        for k in range(partition.batches):
            first = partition.first + k * self.size
            tokens = _tokens(files, partition.shards, first - partition.before, self.size)
            ends = pa.array(np.arange(self.batch + 1, dtype=np.int32) * row)
            number = (first - self.begin) // self.size
            epoch = (first + np.arange(self.batch) * row) // total
            columns = [pa.array([number] * self.batch, pa.int64()), pa.array(np.arange(self.batch, dtype=np.int32)), pa.array(epoch.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(tokens.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["batch_id", "row", "epoch", "tokens"])

    def commit(self, end: dict) -> None:
        pass


def span(held: list[Shard], first: int, batches: int, size: int) -> Span:
    """A task's batches, with those of the files alone that they touch: all of them only if they go through an epoch."""
    ends = np.cumsum([s.tokens for s in held])
    total, n = int(ends[-1]), batches * size
    if n >= total:
        return Span(first, batches, held, first // total * total, total)
    low, high = (int(np.searchsorted(ends, at % total, side="right")) for at in (first, first + n - 1))
    some = held[low : high + 1] if low <= high and first // total == (first + n - 1) // total else held[low:] + held[: high + 1]
    return Span(first, batches, some, first // total * total + int(ends[low]) - held[low].tokens, total)


def _tokens(files: fs.FileSystem, shards: list[Shard], at: int, n: int) -> np.ndarray:
    """n tokens from a position in the files on, which begin again behind the last; the ranges that hold them are read, and no more."""
    out, at = [], at % sum(s.tokens for s in shards)
    while n:
        for shard in shards:
            if at < shard.tokens and n:
                take = min(n, shard.tokens - at)
                with files.open_input_file(shard.path) as f:
                    f.seek(shard.begin + 2 * at)
                    out.append(np.frombuffer(f.read(2 * take), "<u2"))
                n -= take
                at = shard.tokens
            at -= shard.tokens
        at = 0
    return np.concatenate(out)


class BatchSource(DataSource):
    """Options: path (a URI that executors reach), batch, length, epochs, begin and until (token positions)."""

    @classmethod
    def name(cls) -> str:
        return "token_batches"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))


def read(spark: SparkSession, path: str, batch: int, length: int, epochs: int = 1, begin: int = 0, until: int | None = None) -> DataFrame:
    """The batches of a folder of shards, as a stream."""
    spark.dataSource.register(BatchSource)
    out = spark.readStream.format("token_batches").option("path", path).option("batch", batch).option("length", length).option("epochs", epochs).option("begin", begin)
    return (out if until is None else out.option("until", until)).load()
