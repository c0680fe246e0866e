"""Streams that stop and go on, few-shot draws, generation."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import encode
from corpusloom.operators import fewshot, generate, shards
from corpusloom.streaming import batches, packing


def write_npy(folder, sizes, seed=7):
    rng, out = np.random.default_rng(seed), []
    folder.mkdir()
    for k, n in enumerate(sizes):
        out.append(rng.integers(0, 60_000, n, dtype=np.uint16))
        np.save(folder / f"shard_{k:04d}.npy", out[-1])
    return np.concatenate(out).astype(int)


def run(df, tmp_path, name="a"):
    df.writeStream.format("parquet").option("path", f"{tmp_path}/out-{name}").option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True).start().awaitTermination()
    rows = df.sparkSession.read.parquet(f"{tmp_path}/out-{name}").collect()
    return sorted((r.batch_id, r.row, r.epoch, r.tokens) for r in rows)


def expected(tokens, batch, length, epochs=1, begin=0):
    stream, size, out = np.tile(tokens, epochs), batch * (length + 1), []
    for b in range((len(stream) - begin) // size):
        for r in range(batch):
            at = begin + b * size + r * (length + 1)
            out.append((b, r, at // len(tokens), stream[at : at + length + 1].tolist()))
    return out


def test_batches_go_on_behind_the_last_committed_one(spark, tmp_path):
    tokens = write_npy(tmp_path / "shards", [500, 470, 3, 600])
    uri, want = f"file://{tmp_path}/shards", expected(tokens, 2, 16)
    for until in (0, 34, 34 * 7 + 5, None):
        got = run(batches.read(spark, uri, 2, 16, until=until), tmp_path)
        assert got == want[: len(want) if until is None else until // 34 * 2]
    np.save(tmp_path / "shards" / "shard_0009.npy", np.arange(400, dtype=np.uint16))
    assert run(batches.read(spark, uri, 2, 16), tmp_path) == expected(np.concatenate([tokens, np.arange(400)]), 2, 16)


def test_batches_start_over_and_begin_anywhere(spark, tmp_path):
    tokens = write_npy(tmp_path / "shards", [90])
    assert run(batches.read(spark, f"file://{tmp_path}/shards", 2, 8, epochs=3), tmp_path) == expected(tokens, 2, 8, 3)
    assert run(batches.read(spark, f"file://{tmp_path}/shards", 2, 8, epochs=2, begin=23), tmp_path, "b") == expected(tokens, 2, 8, 2, 23)


def test_shards_follow_by_number_where_names_get_longer(spark, tmp_path):
    """By name alone, shard_10000 would come before shard_1001 and shard_9998."""
    tokens = write_npy(tmp_path / "shards", [50, 47, 60, 33, 41])
    for k, number in enumerate((1_001, 9_998, 9_999, 10_000, 10_001)):
        (tmp_path / "shards" / f"shard_{k:04d}.npy").rename(tmp_path / "shards" / f"shard_{number:04d}.npy")
    uri, want = f"file://{tmp_path}/shards", expected(tokens, 2, 8)
    assert [s.tokens for s in batches.shards_in(uri)] == [50, 47, 60, 33, 41]
    for until in (18 * 4 + 5, None):
        assert run(batches.read(spark, uri, 2, 8, until=until), tmp_path) == want[: len(want) if until is None else until // 18 * 2]


def test_folders_without_shards_and_other_files_are_refused(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError, match="no shards"):
        batches.shards_in(f"file://{tmp_path}/none")
    np.save(tmp_path / "none" / "shard_0000.npy", np.zeros(3))
    with pytest.raises(ValueError, match="no flat unsigned 16-bit"):
        batches.shards_in(f"file://{tmp_path}/none")


def test_a_growing_corpus_is_packed_bit_for_bit(spark, tmp_path):
    rows = [(k, "ab"[k % 2], "x" * (3 + k % 9)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, stream string, text string")
    lengths = shards.measured(docs).select("stream", "doc_id", "n")
    folder, target, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    for low, high in ((0, 25), (25, 26), (26, 60)):
        lengths.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).repartition(3).write.mode("append").parquet(folder)
        packing.place(spark.readStream.schema(lengths.schema).parquet(folder), target, check).awaitTermination()
        placed, totals = packing.placements(spark, target)
        assert totals == {s: sum(3 + k % 9 + 1 for k, t, _ in rows if k < high and t == s) for s in "ab" if high > 1}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    for stream in "ab":
        whole, _ = shards.pack(docs.where(F.col("stream") == stream), 50)
        mine = shards.spans(placed.where(F.col("stream") == stream), 50, "shard_id").where(F.col("shard_id") < totals[stream] // 50).drop("stream").join(docs, "doc_id")
        assert sorted(map(tuple, shards.shard_summary(mine).collect())) == sorted(map(tuple, shards.shard_summary(whole).collect()))
    lengths.where("doc_id = 3").write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="comes after"):
        packing.place(spark.readStream.schema(lengths.schema).parquet(folder), target, check).awaitTermination()
    assert spark.read.parquet(target).count() == 60


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 8), st.integers(0, 5))
def test_examples_are_others_and_differ(total, k, seed):
    strides = [p for p in fewshot.STRIDES if (total - 1) % p] or [1] if total > 1 else [1]
    for number in range(total):
        rest, count = total - 1, min(k, total - 1)
        start = (number + 1) * 2_654_435_761 % 2_147_483_647 + seed
        picks = [(number + 1 + (start % rest + j * strides[number % len(strides)]) % rest) % total for j in range(count)]
        assert number not in picks and len(set(picks)) == count


def test_contexts_are_drawn_by_that_rule(spark):
    rows = [(10 * k, f"q{k}", f"a{k}") for k in range(7)]
    items = spark.createDataFrame(rows, "item_id long, question string, answer string")
    found, total = fewshot.contexts(items, 3, seed=2)
    assert total == 7
    for r in found.collect():
        k = r.item_id // 10
        assert len(r.shots) == len(set(r.shots)) == 3 and k not in r.shots and r.number == k
        assert r.context == "\n\n".join([*(f"q{j} a{j}" for j in r.shots), f"q{k}"])
    cut = {r.item_id: r for r in fewshot.requests(found, 10).collect()}
    assert all(encode.code_points is not None and len(r.context) + len(r.continuation) == 10 and bytes(r.continuation) == f" a{k // 10}".encode() for k, r in cut.items())
    one, total = fewshot.contexts(items.limit(1), 3)
    assert [(r.context, r.shots) for r in one.collect()] == [("q0", [])]
    assert {len(r.shots) for r in fewshot.contexts(items.limit(3), 9)[0].collect()} == {2}


def test_the_table_counts_every_context(spark):
    texts = ["abab", "ba", "", None, "é"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter()
    for t in texts:
        for i, c in enumerate([*(t or ""), ""]):
            for k in range(min(2, i) + 1):
                want[(t or "")[i - k : i], c] += 1
    assert {(r.context, r.next): r.n for r in generate.counted(docs, 2).collect()} == want


def test_generation_stops_before_the_end_and_at_the_limit(spark):
    docs = spark.createDataFrame([("the end",)] * 3 + [("aaaaaaaaaaaaaaaaaaaaaaaa",)], "text string")
    choices = generate.table(generate.counted(docs), top_k=5)
    prompts = spark.createDataFrame([(1, "the"), (2, "aaa"), (3, "zzz en"), (4, None), (5, "the end")], "key long, prompt string")
    got = {r.key: r for r in generate.generate(prompts, choices, 6, temperature=0).collect()}
    assert (got[1].new, got[1].n, got[1].ended) == (" end", 4, True) and (got[3].new, got[3].ended) == ("d", True) and (got[5].new, got[5].n, got[5].ended) == ("", 0, True)
    assert (got[2].new, got[2].n, got[2].ended) == ("aaaaaa", 6, False)
    again = [sorted(tuple(r) for r in generate.generate(prompts, choices, 6, seed=3).collect()) for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == 5 and all(len(r[2]) == r[3] <= 6 for r in again[0])
    assert generate.generate(prompts.limit(0), choices, 6).count() == 0


def test_draws_are_even(spark):
    whole = 10**13 + 7
    got = [r[0] for r in spark.range(4000).select(generate.draw(F.col("id"), F.lit(3), F.lit(whole))).collect()]
    assert got == [((k * 1_000_003 + 3 * 7_919) % 2_147_483_647 * 48_271 % 2_147_483_647) * whole // 2_147_483_647 for k in range(4000)]
    assert 0 <= min(got) and max(got) < whole and abs(sum(got) / 4000 / whole - 0.5) < 0.05


def test_the_nucleus_keeps_what_lies_before_its_share(spark):
    counts = spark.createDataFrame([("", c, n) for c, n in zip("abcde", (50, 30, 15, 4, 1), strict=True)], "context string, next string, n long")
    (row,) = generate.table(counts).collect()
    assert [(c.next, c.upto) for c in row.choices] == [("a", 50), ("b", 80), ("c", 95)] and row.whole == 95
    assert [c.next for c in generate.table(counts, top_k=2).first().choices] == ["a", "b"]


def test_a_task_gets_the_files_of_its_batches_alone():
    """So that what the driver sends grows with the files, not with the files times the tasks."""
    held = [batches.Shard(f"shard_{k}", 80, n) for k, n in enumerate([100] * 500 + [30, 7, 1])]
    reader = batches.BatchReader({"path": "", "batch": "1", "length": "9", "epochs": "2"})
    size, total = reader.size, sum(s.tokens for s in held)
    stream = [(s.path, t) for s in held for t in range(s.tokens)] * 2
    for first, n in ((0, 12), (990, 5), (total - 35, 6), (total, 3), (total - 10, 1), (3, total // size + 2)):
        part = batches.span(held, first, n, size)
        tokens = [(s.path, t) for s in part.shards for t in range(s.tokens)]
        at = first - part.before
        assert [tokens[(at + k) % len(tokens)] for k in range(n * size)] == stream[first : first + n * size]
        assert len(part.shards) <= n * size // 100 + 5 or n * size >= total
    import unittest.mock

    with unittest.mock.patch.object(batches, "shards_in", return_value=held):
        spans = reader.partitions({"token": 0}, {"token": total // size * size})
    assert sum(len(p.shards) for p in spans) <= len(held) + 2 * len(spans)
