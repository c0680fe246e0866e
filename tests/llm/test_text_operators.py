"""Packing, training order, substring dedup, decontamination and quality rules against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, packing, queries, rules, substrings, textvec, training_order, wordbpe
from tests.llm.data import SCHEMA, ascii_lower, clashing, docs, results, rows, words


def direct_ids(text):
    return wordbpe.encoder(queries.word_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_batch_encoder_equals_tokenizer(texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, ptr = wordbpe.encoder(queries.word_tokenizer()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == [direct_ids(t) for t in texts]


def test_batch_encoder_on_signs_and_repeats():
    import pyarrow as pa

    texts = ["don't they're <|endoftext|> x", "aaaaaaaa aaaa !!!??-- 12ab½³", "ÀÉß µª º² øÞ × ÷", "q\x85r a b İstanbul ﬁ", None]
    ids, ptr = wordbpe.encoder(queries.word_tokenizer()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True)] == [direct_ids(t) for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=80))
def test_differencing_fits(sizes):
    window = packing.spread(np.array(sizes), 512)
    loads = np.bincount(window, weights=sizes)
    assert loads.max() <= 512 and loads.sum() == sum(sizes)


def test_packing_is_whole(spark):
    path = queries.word_tokenizer()
    got = packing.pack(clashing(docs(spark)), path, capacity=256, group=16).collect()
    by_sequence, pieces = defaultdict(list), Counter()
    for r in got:
        by_sequence[r.sequence_id].append(r)
        pieces[r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32] += 1
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    want = Counter()
    for doc_id, text, *_ in rows():
        ids = np.array([*direct_ids(text), 1], "<u4")
        for start, length, _ in packing.cuts(len(ids), 256):
            want[doc_id, len(ids), start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert pieces == want
    assert len(by_sequence) * 256 < 1.15 * sum(r.length for r in got)


def test_packing_of_nothing(spark):
    assert packing.pack(docs(spark, []), queries.word_tokenizer()).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 64, 1000, 4097])
def test_feistel_is_a_keyed_bijection(count):
    order = training_order.Feistel(count, 5)
    slots = order.slot(np.arange(count))
    assert sorted(slots.tolist()) == list(range(count))
    assert order.number(slots).tolist() == list(range(count))
    if count > 60:
        assert slots.tolist() != training_order.Feistel(count, 6).slot(np.arange(count)).tolist()


def test_training_order_round_trip(spark, tmp_path):
    source = str(tmp_path / "docs")
    clashing(docs(spark)).write.parquet(source)
    scan = spark.read.parquet(source)
    layout = training_order.materialise(scan, queries.word_tokenizer(), f"file://{tmp_path}/out", sequence=64, records=50)
    back = training_order.read(spark, training_order.Layout.load(spark, layout.path)).collect()
    assert sorted(r.slot for r in back) == sorted(r.sequence_id for r in back) == list(range(layout.count))
    stream = [np.frombuffer(r.ids, "<u2").tolist() for r in sorted(back, key=lambda r: r.sequence_id)]
    starts = {r.sequence_id: (r.doc_id, r.start) for r in back}
    # The stream is the tasks' documents in scan order, each task padded at its end.
    parts = scan.select("doc_id", "text", F.spark_partition_id().alias("p")).collect()
    want, heads = [], []
    for p in sorted({r.p for r in parts}):
        ids, owner = [], []
        for r in parts:
            if r.p == p:
                own = [*direct_ids(r.text), 1]
                ids += own
                owner += [(r.doc_id, k) for k in range(len(own))]
        want += [ids[i : i + 64] for i in range(0, len(ids), 64)]
        heads += owner[::64]
    assert stream == want
    assert [starts[k] for k in range(len(want))] == heads
    some = training_order.read(spark, layout, 45, 57).collect()
    assert sorted(r.slot for r in some) == list(range(45, 57))
    assert {(r.slot, r.ids) for r in some} <= {(r.slot, r.ids) for r in back}
    assert all(r.byte_offset == r.slot % 50 * layout.stride and r.shard == r.slot // 50 for r in back)


def test_training_order_is_read_by_seeking(spark, tmp_path):
    """A resumed reader touches the bytes of its own records alone."""
    source = str(tmp_path / "docs")
    docs(spark).write.parquet(source)
    layout = training_order.materialise(spark.read.parquet(source), queries.word_tokenizer(), f"file://{tmp_path}/out", sequence=64, records=50)
    whole = {r.slot: np.frombuffer(r.ids, "<u2").tolist() for r in training_order.read(spark, layout).collect()}
    touched, opened = [], training_order.local_shards(layout)

    class Watched:
        def __init__(self, shard):
            self.shard, self.f = shard, opened(shard)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            touched.append((self.shard, self.f.tell(), n))
            return self.f.read(n)

    got = {slot: ids.tolist() for slot, ids in training_order.stream(layout, Watched, 45, 57)}
    assert got == {k: whole[k] for k in range(45, 57)}
    assert touched == [(k // 50, k % 50 * layout.stride, layout.stride) for k in range(45, 57)]
    assert {s: i.tolist() for s, i in training_order.stream(layout, opened)} == whole
    with pytest.raises(ValueError, match="no record of slot"):
        list(training_order.stream(layout, lambda k: opened(0), 50, 51))


def test_training_order_writes_several_shards_a_task(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "docs")
    docs(spark).write.parquet(source)
    layout = training_order.materialise(spark.read.parquet(source), queries.word_tokenizer(), f"file://{tmp_path}/out", sequence=64, records=7)
    assert layout.shards > 8
    names = {p.name.split("-")[1] for p in (tmp_path / "out/shards").glob("shard=*/part-*")}
    assert len(names) <= 4 and len(list((tmp_path / "out/shards").glob("shard=*/part-*"))) == layout.shards
    assert sorted(r.slot for r in training_order.read(spark, layout).collect()) == list(range(layout.count))


def test_training_order_tokenises_once(spark, tmp_path):
    """Every row is read once, and nothing but the shards and their layout is left."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    given = docs(spark)
    layout = training_order.materialise(given.mapInArrow(watched, given.schema), queries.word_tokenizer(), f"file://{tmp_path}/out", sequence=64, records=50)
    assert seen.value == len(rows())
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"shards", "layout"}
    assert training_order.read(spark, layout).count() == layout.count


def test_training_order_of_nothing(spark):
    layout = training_order.materialise(docs(spark, []), queries.word_tokenizer())
    assert layout.count == 0 and training_order.read(spark, layout).count() == 0


def removed_words(table, length):
    """Brute force: (doc_id, words, kept text) under the operator's rules."""
    first = {}
    for doc_id, text, *_ in table:
        w = words(text)
        if doc_id is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in table:
        w, seen = words(text), set()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen or doc_id is not None and first[key] < doc_id:
                gone[i : i + length] = [True] * length
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, None if text is None else kept, len(w), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [8, 20])
def test_substring_dedup(spark, length):
    found = substrings.dedup(clashing(docs(spark)), length)
    assert results(found.select("doc_id", "text", "n_words", "n_removed")) == removed_words(rows(), length)
    for r in found.collect():
        assert sum(s.end - s.begin for s in r.removed) == r.n_removed


def test_substring_dedup_of_same_ids_and_nothing(spark):
    shared = " ".join(f"q{k}" for k in range(30))
    table = [(1, shared, "en", "a", 1), (1, "x " + shared, "en", "a", 1), (2, shared + " y", "en", "a", 1)]
    assert results(substrings.dedup(docs(spark, table)).select("doc_id", "text", "n_words", "n_removed")) == removed_words(table, 20)
    assert substrings.dedup(docs(spark, [])).count() == 0


def test_substring_dedup_carries_and_keeps_layout(spark):
    found = substrings.dedup(docs(spark), carry=True, verbatim=True).select("doc_id", "text", "n_removed", "carried.source").collect()
    given = {(r[0], r[1]): r[3] for r in rows()}
    assert len(found) == len(rows())
    for r in found:
        if not r.n_removed:
            assert given[r.doc_id, r.text] == r.source


def benchmark_hits(table, items, window=10):
    fold = lambda t: [x for x in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in ascii_lower(t)).split(" ") if x]
    where = defaultdict(set)
    for item_id, text in items:
        w = fold(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            where[tuple(w[i : i + n])].add(str(item_id))
    out = []
    for doc_id, text, *_ in table:
        w = fold(text)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in where}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in where:
                    found |= where[key]
                    hit[i : i + n] = [1] * n
        out.append((doc_id, len(w), sum(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def benchmark_items():
    by_id = {r[0]: r[1] for r in rows()}
    w5, w9 = by_id[5].split(), by_id[9].split()
    return [
        (1, " ".join(w5[25:50])), (2, "A, B; c!"), (10, " ".join(w9[100:112]).upper()), (3, None), (4, ""), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"),
        (6, " ".join(w9[101:106])), (1, " ".join(w9[500:520])), (7, "Überall, Zürich"), (8, "x x x"), (9, " ".join(w5[30:45]) + " tail " + " ".join(w9[100:111])),
    ]


@pytest.mark.parametrize(("block", "most"), [(30, 2_000_000), (200_000, 2_000_000), (30, 60)])
def test_decontamination(spark, block, most):
    items = spark.createDataFrame(benchmark_items(), "item_id long, text string")
    found = decontaminate.scan(clashing(docs(spark)), items, carry=True, block_words=block, pass_words=most)
    got = found.select("doc_id", "n_words", "n_hit", F.array_join("items", ",").alias("items"))
    assert results(got) == benchmark_hits(rows(), benchmark_items())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=5), st.lists(st.sampled_from("abcd"), max_size=30))
def test_automaton_finds_every_window(items, text):
    items = [(str(k), [w.encode() for w in item]) for k, item in enumerate(items)]
    found = decontaminate.Automaton(items, 4)
    import pyarrow as pa

    column = textvec.Words(pa.array([" ".join(text)]), decontaminate._INSIDE, decontaminate.FOLD)
    first, size, which, item = found.hits(column, column.hashes() if len(column) else np.zeros(0, np.uint64))
    got = {}
    for k, name in zip(which.tolist(), item.tolist(), strict=True):
        got.setdefault((int(first[k]), int(size[k])), set()).add(found.names[name])
    want = defaultdict(set)
    for name, item in items:
        n = min(4, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            for j in range(len(text) - n + 1):
                if [w.encode() for w in text[j : j + n]] == item[i : i + n]:
                    want[j, n].add(name)
    assert got == dict(want)


def test_a_word_of_equal_hash_alone_is_not_hit():
    import pyarrow as pa

    found = decontaminate.Automaton([("1", [b"one", b"two", b"six"])], 3)
    words = textvec.Words(pa.array(["one two six", "one ten six"]), decontaminate._INSIDE, decontaminate.FOLD)
    hashes = words.hashes()
    hashes[4] = hashes[1]
    assert found.hits(words, hashes)[0].tolist() == [0]


def test_a_large_benchmark_is_small_in_memory():
    rng = np.random.default_rng(3)
    items = [(str(k), [b"w%d" % x for x in rng.integers(0, 20_000, 100)]) for k in range(200)]
    made = decontaminate.Automaton(items, 10)
    held = sum(x.nbytes for x in vars(made).values() if isinstance(x, np.ndarray))
    assert held < 120 * 20_000  # bytes a word


def test_decontamination_removes_and_keeps(spark):
    items = spark.createDataFrame(benchmark_items(), "item_id long, text string")
    given = clashing(docs(spark))
    left = decontaminate.remove(given, items)
    assert left.columns == given.columns
    again = decontaminate.scan(left, items)
    assert again.agg(F.max("n_hit")).first()[0] == 0
    hits = {(d, n): h for d, n, h, _ in benchmark_hits(rows(), benchmark_items())}
    texts = Counter((r.doc_id, r.text) for r in left.collect())
    for r in rows():
        if not any(d == r[0] and h for (d, _), h in hits.items()):
            assert texts[r[0], r[1]]
    assert decontaminate.remove(given, items.limit(0)).count() == given.count()
    assert decontaminate.remove(docs(spark, []), items).count() == 0


def rule_measures(text):
    w = words(text)
    n = len(w)
    count = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    hit = [0] * n
    for i in range(n - 4):
        if count[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [1] * 5
    lines = [x for x in (text or "").split("\n") if words(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(hit)


def verdict(text):
    """Brute force of the default rules: True if the text is kept."""
    import unicodedata

    n, chars, symbols, dup, repeated = rule_measures(text)
    w = words(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    capitals = sum(unicodedata.category(c) == "Lu" for c in text or "")
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return not (
        n < 10 or repeated * 100 > 20 * n or symbols > 0.1 * n or capitals > 0.4 * chars or dup > 0.5 * lines or same > 0.3 * n or chars < 2 * n or chars > 20 * n
    )


RULED = [*rows(), (20, "SHOUT " * 5 + "loud WORDS all over THE place here NOW", "en", "a", 1), (21, "a|b " * 3 + "one two three four five six seven eight ### x", "en", "a", 1), (22, "ab ab cd cd ef ef gh gh ij ij kl kl", "en", "a", 1)]


def test_quality_rules(spark):
    table = clashing(spark.createDataFrame(RULED, SCHEMA))
    got = results(rules.measure(table))
    want = []
    for doc_id, text, *_ in RULED:
        m = rule_measures(text)
        base = m[0] < 10 or 100 * m[4] > 20 * m[0]
        want.append((doc_id, *m, base, verdict(text)))
    assert got == sorted(((d, n, c, s, dup, rep, b, k) for d, n, c, s, dup, rep, b, k in want), key=repr)
    kept = rules.keep(table)
    assert kept.columns == table.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r[0]) for r in RULED if verdict(r[1]))


def test_quality_rules_do_not_depend_on_their_order(spark):
    table = spark.createDataFrame(RULED, SCHEMA)
    orders = [list(rules.RULES), list(rules.RULES)[::-1]]
    kept = [sorted(repr(r.doc_id) for r in table.where(rules.verdict(F.coalesce("text", F.lit("")), o, rules.RULES).isNull()).collect()) for o in orders]
    assert kept[0] == kept[1]
    assert rules.measure(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_are_estimated_on_what_runs(spark):
    """The sample is drawn from the whole table, and shares come from it."""
    table = spark.createDataFrame([(k, "x " * 20 if k < 3000 else "one two three four five six seven eight nine ten eleven") for k in range(4000)], "doc_id long, text string").repartition(3)
    sample = rules.sampled(table)
    assert 120 < sample.count() < 300 and sample.select("text").distinct().count() == 2
    for measured in (False, True):
        found = rules.estimate(table, rules.RULES, measured)
        assert 0.6 < found["repeated_words"][1] < 0.9 and found["few_words"][1] == 0 and all(cost > 0 for cost, _ in found.values())
    assert set(rules.ordered(table, rules.RULES)[:3]) == {"repeated_words", "stutter", "word_length"}


def test_substring_digest(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op2_substrings"](spark, str(tmp_path)).collect()}
    assert got == {(d, n, g, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n, g in removed_words(rows(), 20)}
