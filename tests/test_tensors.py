"""Checkpoints: byte ranges, commits, aborts, mirrors."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import tensors


def slices(spark, arrays, rows=3):
    out = []
    for name, x in arrays.items():
        for a in range(0, max(1, len(x)), rows):
            part = x[a : a + rows]
            out.append((name, x.dtype.str, list(x.shape), a, len(part), bytearray(part.tobytes())))
    return spark.createDataFrame(out, tensors.SCHEMA).repartition(3)


ARRAYS = {"w/a": np.arange(40, dtype="<f4").reshape(10, 4), "w/b": np.arange(7, dtype="<i8"), "none": np.zeros((0, 5), "<f8"), "é": np.ones((2, 2, 2), "<u2")}


def loaded(df):
    got: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.name, r.first)):
        got.setdefault(r.name, []).append(np.frombuffer(bytes(r.data), r.dtype).reshape(r.n, *r.shape[1:]))
    return {k: np.concatenate(v) for k, v in got.items()}


def test_round_trip_in_small_files_and_reads(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    tensors.save(slices(spark, ARRAYS), path, 7, mirror=f"file://{tmp_path}/m", part_bytes=40, run="x")
    for place in (path, f"file://{tmp_path}/m"):
        got = loaded(tensors.load(spark, place, read_bytes=10))
        assert got.keys() == ARRAYS.keys() and all(np.array_equal(got[k], ARRAYS[k]) and got[k].shape == ARRAYS[k].shape for k in got)
        assert tensors.manifest(place)["step"] == 7 and tensors.manifest(place)["meta"] == {"run": "x"} and tensors.manifest(place)["tensors"] == 4
    assert not [n for n in os.listdir(f"{tmp_path}/c") if n.startswith("_")]


def test_a_slice_by_name_reads_its_bytes_alone(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    tensors.save(slices(spark, ARRAYS, 100).coalesce(1), path, 1)
    (file,) = [f"{tmp_path}/c/{tensors.step_folder(1)}/{f['file']}" for f in tensors.manifest(path)["files"]]
    entry = {e["name"]: e for e in tensors.read_index(tensors._place(path)[0], file)}["w/a"]
    begin, end = entry["offset"] + 4 * 16, entry["offset"] + 6 * 16
    raw = bytearray(open(file, "rb").read())
    first = min(e["offset"] for e in tensors.read_index(tensors._place(path)[0], file))
    raw[first:begin] = b"\xff" * (begin - first)
    open(file, "wb").write(raw[:end])  # nothing but the index and the slice is left
    assert np.array_equal(loaded(tensors.load(spark, path, names=["w/a"], rows=(4, 6)))["w/a"], ARRAYS["w/a"][4:6])
    with pytest.raises(Exception, match="ends inside of w/a"):
        tensors.load(spark, path, names=["w/a"], rows=(4, 7)).collect()


def test_names_are_pushed_down(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    tensors.save(slices(spark, ARRAYS), path, 1)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = tensors.load(spark, path)
        for wanted in (df.where("name = 'w/b'"), df.where("name in ('w/b', 'other')").where("n > 0")):
            assert list(loaded(wanted)) == ["w/b"] and wanted.rdd.getNumPartitions() == 3  # one for each slice of it
        assert loaded(df.where("name = 'other'")) == {}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_failed_or_killed_write_leaves_the_last(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    tensors.save(slices(spark, ARRAYS), path, 1)
    bad = slices(spark, ARRAYS).withColumn("data", F.when(F.col("name") == "w/b", F.raise_error(F.lit("lost"))).otherwise(F.col("data")))
    for df in (bad, slices(spark, ARRAYS).where("name <> 'w/a' or first <> 3"), slices(spark, ARRAYS).unionByName(slices(spark, {"w/b": ARRAYS["w/b"]})), slices(spark, ARRAYS).withColumn("n", F.col("n") + 1)):
        with pytest.raises(Exception, match="lost|gap|rows and not|overlap|bytes"):
            tensors.save(df, path, 2, mirror=f"file://{tmp_path}/m")
    os.makedirs(f"{tmp_path}/c/_writing-killed")  # as a driver that dies before the commit leaves it
    assert tensors.steps(path) == [1] and tensors.manifest(path)["step"] == 1
    assert np.array_equal(loaded(tensors.load(spark, path))["w/a"], ARRAYS["w/a"])
    # A task that outlives the abort may still write, where no reader looks.
    assert all(n.startswith(("_writing-", "step_", "last")) for n in os.listdir(f"{tmp_path}/c"))


def test_replacing_and_rotation(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    for step in (5, 6, 7):
        tensors.save(slices(spark, {"x": np.full((2, 2), step, "<f4")}), path, step)
    with pytest.raises(Exception, match="is there"):
        tensors.save(slices(spark, {"x": np.zeros((1, 2), "<f4")}), path, 5)
    tensors.save(slices(spark, {"x": np.zeros((1, 2), "<f4")}), path, 5, overwrite=True)
    assert loaded(tensors.load(spark, path))["x"].tolist() == [[0, 0]] and loaded(tensors.load(spark, path, 6))["x"].tolist() == [[6, 6], [6, 6]]
    assert tensors.prune(path, 0) == [] and tensors.prune(path, 1) == [6] and tensors.steps(path) == [5, 7]
