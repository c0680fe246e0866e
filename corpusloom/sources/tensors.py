"""Checkpoints: named tensors in container files, as a Spark data source.

A row is a slice of a tensor along its first dimension: (name, dtype, shape, first, n, data). A
container file begins with its length-prefixed index, a JSON list of the slices and where their
bytes are, so that a reader fetches the index and then the byte ranges that it wants. A task
writes files of about `part_bytes` into a folder that no reader looks at; the commit checks that
the slices of every tensor fill its shape, names the files in a manifest, and only then renames
the folder to `step_...` and replaces `last.json`. A write that fails or is killed leaves the
earlier checkpoint as it was. With `mirror`, everything is written and committed there, too.

Reading: `names` and a comparison of `name` in the session's pushed filters (where
spark.sql.python.filterPushdown.enabled is set) select tensors, `rows` a range of the first
dimension; other files and bytes are not read. Large tensors are read in slices of `read_bytes`.

Bounds: the driver holds an index entry per slice while it commits or plans; a task holds one
container file. Defined results: a tensor without rows has one slice of none; a null name or
data, an unknown dtype, a slice of the wrong size, overlapping or missing slices are errors.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

MAGIC = b"CORPUSLOOM-TNSR\n"
SCHEMA = "name string, dtype string, shape array<long>, first long, n long, data binary"
#: Bytes of a container file, and of a slice that is read at once.
PART_BYTES = 64 << 20
READ_BYTES = 64 << 20
_ALIGN = 64


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _width(dtype: str, shape: list[int]) -> int:
    """Bytes of one row of a tensor."""
    return np.dtype(dtype).itemsize * math.prod(shape[1:])


def container(slices: list[dict], data: list[bytes]) -> bytes:
    """A container file's bytes; offsets count from the end of the index."""
    at, index = 0, []
    for entry, raw in zip(slices, data, strict=True):
        index.append({**entry, "offset": at, "length": len(raw)})
        at += -(-len(raw) // _ALIGN) * _ALIGN
    head = json.dumps(index).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(raw + b"\0" * (-len(raw) % _ALIGN) for raw in data)])


def read_index(files: fs.FileSystem, path: str) -> list[dict]:
    """A container's slices with their places in the file; nothing but the index is read."""
    with files.open_input_file(path) as f:
        start = f.read(len(MAGIC) + 8)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no tensor container")
        size = int.from_bytes(start[len(MAGIC) :], "little")
        return [{**e, "offset": e["offset"] + len(start) + size} for e in json.loads(f.read(size))]


def _json(files: fs.FileSystem, path: str) -> dict:
    with files.open_input_file(path) as f:
        return json.loads(f.read())


def step_folder(step: int) -> str:
    return f"step_{step:010d}"


def manifest(path: str, step: int | str = "last") -> dict:
    """What a checkpoint holds: its step, its files, and what was saved with it."""
    files, root = _place(path)
    if step == "last":
        step = _json(files, f"{root}/last.json")["step"]
    return _json(files, f"{root}/{step_folder(int(step))}/manifest.json")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]
    slices: list[tuple[str, str, list[int], int, int]]


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.roots = [options["path"], *([options["mirror"]] if options.get("mirror") else [])]
        self.step, self.meta = int(options["step"]), json.loads(options.get("meta", "{}"))
        self.most, self.overwrite = int(options.get("part_bytes", PART_BYTES)), overwrite
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        attempt, out = TaskContext.get().taskAttemptId(), Written([], [])
        slices, data, size = [], [], 0

        def close() -> None:
            nonlocal slices, data, size
            if not slices:
                return
            name = f"part-{attempt}-{len(out.files)}.tensors"
            raw = container(slices, data)
            for root in self.roots:
                files, folder = _place(f"{root}/{self.folder}")
                files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{name}") as f:
                    f.write(raw)
            names = [s["name"] for s in slices]
            out.files.append({"file": name, "slices": len(slices), "least": min(names), "most": max(names)})
            out.slices.extend((s["name"], s["dtype"], s["shape"], s["first"], s["n"]) for s in slices)
            slices, data, size = [], [], 0

        for batch in iterator:
            for row in batch.to_pylist():
                if row["name"] is None or row["data"] is None or len(row["data"]) != row["n"] * _width(row["dtype"], row["shape"]):
                    raise ValueError(f"a slice of {row['name']} has no name, no data, or not the bytes that its shape asks for")
                raw = row.pop("data")
                if slices and size + len(raw) > self.most:
                    close()
                slices.append(row)
                data.append(raw)
                size += len(raw)
        close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        check_whole([s for m in done for s in m.slices])
        parts = sorted((f for m in done for f in m.files), key=lambda f: f["file"])
        held = {"step": self.step, "files": parts, "tensors": len({s[0] for m in done for s in m.slices}), "meta": self.meta}
        for uri in self.roots:
            files, root = _place(uri)
            target, mine = f"{root}/{step_folder(self.step)}", f"{root}/{self.folder}"
            files.create_dir(mine, recursive=True)
            kept = {p["file"] for p in parts}
            for info in files.get_file_info(fs.FileSelector(mine)):  # of attempts that were not the ones that counted
                if info.base_name not in kept:
                    files.delete_file(info.path)
            _write_json(files, f"{mine}/manifest.json", held)
            if files.get_file_info(target).type != fs.FileType.NotFound:
                if not self.overwrite:
                    raise FileExistsError(f"{target} is there; write with mode overwrite to replace it")
                files.move(target, f"{root}/_old-{self.folder}")
            files.move(mine, target)
            _write_json(files, f"{root}/{self.folder}.json", {"step": self.step})
            files.move(f"{root}/{self.folder}.json", f"{root}/last.json")
            if files.get_file_info(f"{root}/_old-{self.folder}").type != fs.FileType.NotFound:
                files.delete_dir(f"{root}/_old-{self.folder}")

    def abort(self, messages: list[Written | None]) -> None:
        for uri in self.roots:
            files, root = _place(uri)
            if files.get_file_info(f"{root}/{self.folder}").type != fs.FileType.NotFound:
                files.delete_dir(f"{root}/{self.folder}")


def _write_json(files: fs.FileSystem, path: str, value: dict) -> None:
    with files.open_output_stream(path) as f:
        f.write(json.dumps(value, sort_keys=True).encode())


def check_whole(slices: list[tuple[str, str, list[int], int, int]]) -> None:
    """Fails unless the slices of each tensor fill its first dimension, once, under one dtype and shape."""
    at: dict[str, tuple[str, list[int], int]] = {}
    for name, dtype, shape, first, n in sorted(slices, key=lambda s: (s[0], s[3], s[4])):
        known = at.setdefault(name, (dtype, shape, 0))
        if known[:2] != (dtype, shape) or first != known[2]:
            raise ValueError(f"slices of {name} differ in shape or dtype, overlap, or leave a gap at row {known[2]}")
        at[name] = (dtype, shape, first + n)
    for name, (_, shape, end) in at.items():
        if end != shape[0]:
            raise ValueError(f"{name} has {end} rows and not the {shape[0]} of its shape")


@dataclass
class Piece(InputPartition):
    file: str
    entry: dict
    first: int
    n: int


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], options.get("step", "last")
        self.names = set(json.loads(options["names"])) if "names" in options else None
        begin, _, end = options.get("rows", ":").partition(":")
        self.rows = int(begin or 0), int(end) if end else None
        self.most = int(options.get("read_bytes", READ_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        held, (files, root) = manifest(self.path, self.step), _place(self.path)
        out: list[InputPartition] = []
        for part in held["files"]:
            if self.names is not None and not any(part["least"] <= n <= part["most"] for n in self.names):
                continue
            path = f"{root}/{step_folder(held['step'])}/{part['file']}"
            for entry in read_index(files, path):
                if self.names is not None and entry["name"] not in self.names:
                    continue
                begin = max(entry["first"], self.rows[0])
                end = min(entry["first"] + entry["n"], entry["first"] + entry["n"] if self.rows[1] is None else self.rows[1])
                if begin >= end and (entry["shape"][0] or self.rows != (0, None)):
                    continue
                step = max(1, self.most // max(1, _width(entry["dtype"], entry["shape"])))
                out += [Piece(path, entry, a, min(step, end - a)) for a in range(begin, max(end, begin + 1), step)]
        return out or [Piece("", {}, 0, 0)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if not partition.file:
            return
        entry, files = partition.entry, _place(self.path)[0]
        width = _width(entry["dtype"], entry["shape"])
        with files.open_input_file(partition.file) as f:
            f.seek(entry["offset"] + (partition.first - entry["first"]) * width)
            data = f.read(partition.n * width)
        if len(data) != partition.n * width:
            raise EOFError(f"{partition.file} ends inside of {entry['name']}")
        yield entry["name"], entry["dtype"], entry["shape"], partition.first, partition.n, data


class FilteredReader(TensorReader):
    """Takes what a query says of the name into the choice of files and bytes."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("name",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f


class TensorSource(DataSource):
    """Options: path (a URI that executors reach), step (a number or `last`), names (a JSON list), rows (`a:b`), mirror, meta."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilteredReader(dict(self.options)) if self.options.get("pushdown") == "true" else TensorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(dict(self.options), overwrite)


def save(slices: DataFrame, path: str, step: int, mirror: str | None = None, overwrite: bool = False, part_bytes: int = PART_BYTES, **meta) -> None:
    """Writes slices(name, dtype, shape, first, n, data) as checkpoint `step`, which becomes the last."""
    slices.sparkSession.dataSource.register(TensorSource)
    out = slices.select("name", "dtype", "shape", "first", "n", "data").write.format("tensors").option("path", path).option("step", step).option("meta", json.dumps(meta)).option("part_bytes", part_bytes)
    (out.option("mirror", mirror) if mirror else out).mode("overwrite" if overwrite else "append").save()


def load(spark: SparkSession, path: str, step: int | str = "last", names: list[str] | None = None, rows: tuple[int, int] | None = None, read_bytes: int = READ_BYTES) -> DataFrame:
    """Slices of a checkpoint's tensors."""
    spark.dataSource.register(TensorSource)
    out = spark.read.format("tensors").option("path", path).option("step", step).option("read_bytes", read_bytes)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        out = out.option("pushdown", "true")
    if names is not None:
        out = out.option("names", json.dumps(names))
    if rows is not None:
        out = out.option("rows", f"{rows[0]}:{rows[1]}")
    return out.load()


def steps(path: str) -> list[int]:
    """Numbers of the checkpoints that are there."""
    files, root = _place(path)
    found = [i.base_name for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory]
    return sorted(int(name[5:]) for name in found if name.startswith("step_"))


def prune(path: str, keep: int) -> list[int]:
    """Deletes all but the newest `keep` checkpoints, never the last one that was written; keep <= 0 deletes none."""
    files, root = _place(path)
    last = _json(files, f"{root}/last.json")["step"]
    gone = [s for s in steps(path)[:-keep] if s != last] if keep > 0 else []
    for step in gone:
        files.delete_dir(f"{root}/{step_folder(step)}")
    return gone


def packed(vectors: DataFrame, name: str, total: str, at: str, value: str, dtype: str = "<f4", rows: int = 1024) -> DataFrame:
    """Slices, of `rows` rows at most, of the tensors that vectors(name, total rows, row number, array) make up."""
    from pyspark.sql import functions as F

    row = F.struct(F.col(at).alias("at"), F.col(value).cast("array<double>").alias("row"))
    keyed = vectors.select(F.col(name).alias("name"), F.col(total).cast("long").alias("total"), F.expr(f"`{at}` div {rows}").alias("slice"), row.alias("row"))
    gathered = keyed.groupBy("name", "total", "slice").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.array([v["row"] for v in r["rows"]]).astype(dtype)
                out.append({"name": r["name"], "dtype": dtype, "shape": [r["total"], x.shape[1]], "first": r["rows"][0]["at"], "n": len(x), "data": x.tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("first", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))

    return gathered.mapInArrow(run, SCHEMA)


def rows_of(slices: DataFrame) -> DataFrame:
    """(name, at, row): each row of two-dimensional tensors, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], r["dtype"]).reshape(r["n"], -1).astype(np.float64)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]] * len(x), pa.string()), pa.array(r["first"] + np.arange(len(x))), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["name", "at", "row"])

    return slices.mapInArrow(run, "name string, at long, row array<double>")
