"""Worked cases of the core operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import encode, numeric, schedules
from corpusloom.operators import chat, evaluate, mixture, order, shards
from corpusloom.plans import config
from corpusloom.sources import sinks, tables
from corpusloom.streaming import watch


def id_docs(spark, texts):
    """Documents `ID:N`, encoded as ID, N times, and closed by 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def counted():
    return F.split_part("text", F.lit(":"), F.lit(2)).cast("long")


def ended():
    return encode.with_end(encode.repeated_id(F.col("text")), 0)


def shard_ids(cut):
    out: dict[int, list[int]] = {}
    for r in cut.select("shard_id", "offset", shards.span_ids(ended()).alias("ids")).orderBy("shard_id", "offset").collect():
        have = out.setdefault(r.shard_id, [])
        assert len(have) == r.offset
        have += r.ids
    return out


def test_prefix_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, "ab"[k % 2], rng.randrange(5)) for k in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k long, s string, n long")
    for source in (None, "s"):
        placed, totals = order.place(df, "n", "k", source, ranges=7)
        got = {r.k: r.start for r in placed.collect()}
        for k, s, _ in rows:
            assert got[k] == sum(n for j, t, n in rows if j < k and (source is None or t == s))
        assert sum(totals.values()) == sum(r[2] for r in rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.integers(1, 5), st.sampled_from("ab")), min_size=1, max_size=12), st.booleans())
def test_repeated_order_values_stand_one_behind_the_other(spark, rows, by_source):
    df = spark.createDataFrame(rows, "k long, n long, s string")
    placed, totals = order.place(df, "n", "k", "s" if by_source else None, ranges=3)
    got = [(r.s if by_source else None, -1 if r.k is None else r.k, r.start, r.n) for r in placed.collect()]
    assert sorted((-1 if k is None else k, n) for k, n, _ in rows) == sorted((k, n) for _, k, _, n in got)
    for name in {g[0] for g in got}:
        own = sorted((start, n, k) for s, k, start, n in got if s == name)
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False))
        assert [k for _, _, k in own] == sorted(k for _, _, k in own) and own[-1][0] + own[-1][1] == totals[name]


def test_shards_of_repeated_ids_are_full(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab"), (1, "cd"), (2, "e")], "doc_id long, text string")
    cut, totals = shards.pack(docs, 4)
    summary = {r.shard_id: r.n_tokens for r in shards.shard_summary(cut).collect()}
    assert totals["shards_written"] == 2 and summary == {0: 4, 1: 4}
    monkeypatch.setattr(order, "TIED", 1)
    with pytest.raises(ValueError, match="2 rows share a value of doc_id"):
        shards.pack(docs, 4)


def test_texts_are_read_twice_to_be_packed(spark, tmp_path):
    spark.createDataFrame([(k, "x" * k) for k in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    cut, _ = shards.pack(spark.read.parquet(f"{tmp_path}/docs"), 100, skip=10)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("text") and sum("text" in line for line in plan.splitlines() if "ReadSchema" in line) == 1  # the other read made the lengths


def test_pack_runs_documents_on(spark):
    cut, totals = shards.pack(id_docs(spark, ["1:5", "2:5", "3:5"]), 8, 2, count=counted())
    assert shard_ids(cut) == {0: [1, 1, 1, 1, 1, 0, 2, 2], 1: [2, 2, 2, 0, 3, 3, 3, 3]}
    assert totals == {"shards_written": 2, "tokens_written": 16, "tokens_skipped": 0}


def test_skip_drops_the_crossing_document(spark):
    cut, totals = shards.pack(id_docs(spark, [f"{k}:5" for k in range(1, 6)]), 6, skip=12, count=counted())
    assert {x for ids in shard_ids(cut).values() for x in ids} == {0, 3, 4, 5} and totals["tokens_skipped"] == 12
    cut, totals = shards.pack(id_docs(spark, ["1:5"]), 6, skip=100, count=counted())
    assert totals == {"shards_written": 0, "tokens_written": 0, "tokens_skipped": 6} and not cut.count()
    with pytest.raises(RuntimeError):
        sinks.require_output(0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=20), st.integers(0, 60), st.integers(1, 15), st.one_of(st.none(), st.integers(0, 4)))
def test_closed_forms_equal_the_step_by_step_rules(sizes, skip, size, most):
    buffer = skipped = written = 0
    for n in sizes:
        if most is not None and written >= most:
            break
        if skipped < skip:
            skipped += n
            continue
        buffer += n
        while buffer >= size and (most is None or written < most):
            buffer -= size
            written += 1
    before = np.cumsum([0, *sizes])[:-1]
    kept = before[before >= skip] if len(sizes) else before
    left = sum(sizes) - int(kept[0]) if len(kept) else 0
    assert written == (left // size if most is None else min(left // size, most))


def drawn_sources(lengths, weights, most=None, late=0):
    """Sources in drawing order; with late, documents are offered in small lots, source after source."""
    mixer = mixture.Mixer(weights, [len(x) for x in lengths], most)
    offers = [(k, i, n) for k, x in enumerate(lengths) for i, n in enumerate(x)]
    if late:
        offers.sort(key=lambda o: (o[1] // late, o[0]))
    out = []
    for offer in offers:
        mixer.offer(*offer)
        out += mixer.draws()
    assert [r for _, _, r, _, _ in out] == list(range(len(out)))
    return [k for k, *_ in out]


def test_greedy_mix_takes_the_first_of_equals():
    assert drawn_sources([[10] * 20] * 2, [0.5, 0.5], 100) == [0, 1] * 5
    assert drawn_sources([[10], [10] * 5], [0.9, 0.1]) == [0, 1, 1, 1, 1, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 50), max_size=12), min_size=1, max_size=4), st.integers(1, 4), st.one_of(st.none(), st.integers(1, 200)))
def test_mix_equals_the_greedy_rule_however_documents_arrive(lengths, late, most):
    weights = [(k + 1) / sum(range(1, len(lengths) + 1)) for k in range(len(lengths))]
    want, emitted, total, taken = [], [0] * len(lengths), 0, [0] * len(lengths)
    while any(taken[k] < len(x) for k, x in enumerate(lengths)) and (most is None or total < most):
        live = [k for k, x in enumerate(lengths) if taken[k] < len(x)]
        pick = min(live, key=lambda k: (emitted[k] - weights[k] * total, k))
        want.append(pick)
        emitted[pick] += lengths[pick][taken[pick]]
        total += lengths[pick][taken[pick]]
        taken[pick] += 1
    assert drawn_sources(lengths, weights, most) == drawn_sources(lengths, weights, most, late) == want


def test_few_documents_wait_when_a_source_has_run_out():
    rng = random.Random(4)
    lengths, weights = [[rng.randrange(1, 40) for _ in range(n)] for n in (2_000, 9_000, 10_000)], [0.7, 0.2, 0.1]
    times, offers = mixture.draw_times(weights, [sum(x) for x in lengths]), []
    for k, own in enumerate(lengths):
        before = 0
        for i, n in enumerate(own):
            mine, drawn, rate = [p for p in times[k] if p[0] <= before][-1]
            offers.append((drawn + (before - mine) / rate, k, i, n))
            before += n
    mixer, most, drawn = mixture.Mixer(weights, [len(x) for x in lengths]), 0, 0
    for _, k, i, n in sorted(offers):
        mixer.offer(k, i, n)
        drawn += len(list(mixer.draws()))
        most = max(most, mixer.held)
    assert drawn == 21_000 and most < 210


def test_a_mixed_stream_is_packed(spark):
    rows = [(k, "ab"[k % 2], f"{k % 2 + 1}:9") for k in range(40)]
    docs = shards.measured(spark.createDataFrame(rows, "doc_id long, source string, text string"), counted())
    cut, totals = mixture.packed(mixture.mix(docs, [mixture.Entry("a", 0.5), mixture.Entry("b", 0.5)]), 100)
    assert totals == {"shards_written": 4, "tokens_written": 400, "tokens_drawn": 400}
    assert shard_ids(cut)[0] == ([1] * 9 + [0] + [2] * 9 + [0]) * 5


def test_mix_shares_skip_and_shards(spark):
    rows = [(k, ("a", "b", "c")[k % 3], f"{k % 3 + 1}:{3 + k % 4}") for k in range(300)]
    docs = shards.measured(spark.createDataFrame(rows, "doc_id long, source string, text string"), counted())
    recipe = [mixture.Entry("a", 0.55, 50), mixture.Entry("b", 0.3), mixture.Entry("c", 0.15)]
    drawn = mixture.mix(docs, recipe, max_tokens=500)
    got = sorted((r.rank, r.start, r.n) for r in drawn.collect())
    assert [r[0] for r in got] == list(range(len(got))) and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert got[-1][1] < 500 <= got[-1][1] + got[-1][2]
    for r in mixture.shares(drawn).collect():
        assert abs(r.share - {"a": 0.55, "b": 0.3, "c": 0.15}[r.source]) < 0.03
    first = min(r.doc_id for r in drawn.where("source = 'a'").collect())
    assert sum(n + 1 for n in [3 + k % 4 for k in range(0, first, 3)]) >= 50
    assert mixture.stride_rank(docs, recipe).count() == 300
    assert all(abs(sum(e.weight for e in r) - 1) < 1e-9 for r in mixture.RECIPES.values())
    assert [e.name for r in mixture.RECIPES.values() for e in r if e.skip] == ["fineweb_edu"] * 2


def test_batches_wrap_and_resume(spark):
    docs = id_docs(spark, [f"{k}:{k}" for k in range(1, 8)])
    placed, totals = order.place(shards.measured(docs, counted()), "n", "doc_id")
    total = totals[None]
    stream = [x for k in range(1, 8) for x in [k] * k + [0]]
    for offset in (0, 11, total - 5, 3 * total + 2):
        cut = shards.batch_rows(placed, total, 2, 4, 5, offset)
        rows: dict = {}
        for r in cut.select("batch_id", "row", "offset", "epoch", shards.span_ids(ended()).alias("ids")).orderBy("batch_id", "row", "offset").collect():
            rows.setdefault((r.batch_id, r.row), []).extend(r.ids)
        flat = [x for key in sorted(rows) for x in rows[key]]
        assert flat == [stream[(offset + k) % total] for k in range(50)]
    assert shards.batch_rows(placed, total, 2, 4, shards.full_batches(total, 2, 4), max_epochs=1).count()
    with pytest.raises(ValueError, match="reach epoch 1"):
        shards.batch_rows(placed, total, 2, 4, shards.full_batches(total, 2, 4) + 1, max_epochs=1)
    for offset in (0, 7, 123):
        assert shards.Position.at(offset, 10, 3).offset(10, 3) == offset


def test_windows_stay_in_their_shard(spark):
    cut, _ = shards.pack(id_docs(spark, ["1:40", "2:40", "3:40"]), 50, count=counted())
    windows = shards.score_windows(cut, 50, 16).groupBy("shard_id", "window_id").agg(F.sum("length").alias("n")).collect()
    assert sorted((r.shard_id, r.window_id, r.n) for r in windows) == [(s, w, 16) for s in (0, 1) for w in (0, 1, 2)]


def test_preflight():
    shards.check_sufficiency(2_100_000_000, 2000, 16, 32, 2048, 4)
    with pytest.raises(ValueError, match="are needed"):
        shards.check_sufficiency(1_000_000_000, 20_000, 16, 32, 2048, 4)


def test_chat_ids_and_mask(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "ok"), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    row = chat.render(turns).first()
    assert len(row.input_ids) == len(row.labels) == 29
    assert [x for x in row.labels if x != -100] == [ord("o"), ord("k"), 2] == row.input_ids[-3:]
    assert "".join(map(chr, row.input_ids[:-1])) == "<|user|>\nhi\n<|assistant|>\nok"
    prompt = spark.range(1).select(chat.prompt_ids(F.lit("hi"), system=F.lit("Be terse.")).alias("p")).first().p
    assert "".join(map(chr, prompt)) == "<|system|>\nBe terse.\n<|user|>\nhi\n<|assistant|>\n"
    with pytest.raises(Exception, match="unknown role: tool"):
        chat.render(turns.withColumn("role", F.lit("tool"))).collect()


def test_code_points_of_nothing_and_beyond(spark):
    df = spark.createDataFrame([("",), (None,), ("a😀é",)], "text string")
    got = df.select(encode.code_points(F.col("text")).alias("ids"), encode.decode(encode.code_points(F.col("text"))).alias("back")).collect()
    assert [list(r.ids) for r in got] == [[], [], [97, 128512, 233]] and got[2].back == "a😀é"


def test_spans_of_code_points_equal_slices(spark):
    rows = [(t, b, n) for t in ("a😀éb", "", None, "x") for b in range(len(t or "") + 1) for n in range(1, len(t or "") + 2 - b)]
    df = spark.createDataFrame(rows, "text string, begin long, length long")
    for r in df.select(shards.span_ids().alias("got"), shards.span_ids(encode.with_end(encode.code_points(F.col("text")))).alias("want")).collect():
        assert r.got == r.want


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_uniform_logits_have_perplexity_of_their_number(spark):
    for v in (2, 4, 5):
        rows = spark.createDataFrame([([0.0] * v, 1), ([0.0] * v, -100)], "l array<double>, t int").withColumn("nll", numeric.nll(F.col("l"), F.col("t")))
        got = rows.agg(numeric.perplexity(F.sum("nll"), F.count("nll")).alias("p"), numeric.token_mean(F.col("nll"), F.col("t")).alias("m")).first()
        assert math.isclose(got.p, v) and math.isclose(got.m, math.log(v))
    masked = rows.where("t = -100")
    assert masked.agg(numeric.token_mean(F.col("nll"), F.col("t"))).first()[0] == 0
    with pytest.raises(Exception, match="needs a token"):
        masked.agg(numeric.perplexity(F.sum("nll"), F.count("nll"))).collect()


def test_divergence_sees_the_top_entries_alone(spark):
    student = array(2, 1, 0.5, -1)
    same = numeric.top_k(student, 2)
    assert abs(one(spark, numeric.top_k_divergence(student, same, 2.0).alias("x")).x) < 1e-12
    teacher = numeric.top_k(array(1, 3, 0, 0), 2)
    a = one(spark, numeric.top_k_divergence(student, teacher, 1.0).alias("x")).x
    b = one(spark, numeric.top_k_divergence(array(2, 1, 9, 9), teacher, 1.0).alias("x")).x
    assert a > 0 and math.isclose(a, b)


def test_picks(spark):
    top = one(spark, numeric.top_k(array(1, 5, 5, 2), 3).alias("x"), numeric.greedy(array(1, 5, 5)).alias("g"))
    assert [(e.val, e.idx) for e in top.x] == [(5, 1), (5, 2), (2, 3)] and top.g == 1
    kept = one(spark, numeric.nucleus(F.array(*[F.lit(math.log(p)) for p in (0.5, 0.3, 0.15, 0.05)]), 0.6).alias("x")).x
    assert [e.idx for e in kept] == [0, 1] and math.isclose(sum(e.p for e in kept), 1)
    assert one(spark, numeric.inverse_cdf(array(0.2, 0.3, 0.5), F.lit(0.45)).alias("x")).x == 1
    assert one(spark, numeric.inverse_cdf(array(0.2, 0.3), F.lit(0.99)).alias("x")).x == 1


def test_schedules(spark):
    rate = lambda s: one(spark, schedules.cosine_rate(F.lit(s), F.lit(10), F.lit(100), F.lit(0.5)).alias("x")).x
    assert (rate(0), rate(10)) == (0, 0.5) and math.isclose(rate(100), 0.05)
    floats = schedules.cache_floats(F.lit(1024), F.lit(16), F.lit(512), F.lit(64))
    assert tuple(one(spark, *[schedules.cache_bytes(f, F.lit(18), 2048).alias(f"b{k}") for k, f in enumerate(floats)])) == (150_994_944, 42_467_328)
    assert math.isclose(one(spark, evaluate.standard_error(F.lit(0.3399721171), F.lit(10_042)).alias("x")).x, 0.0047273, abs_tol=1e-7)


def test_closed_configuration(tmp_path):
    assert config.parsed(config.PackConfig, {"shard_size": 5, "max_shards": None}).shard_size == 5
    with pytest.raises(ValueError, match="unknown keys: a, shard_siez"):
        config.parsed(config.PackConfig, {"shard_siez": 5, "a": 1})
    with pytest.raises(ValueError, match="skip_tokens: 'x' is no .*; out: 3 is no"):
        config.parsed(config.PackConfig, {"skip_tokens": "x", "out": 3})
    assert config.problems(config.TrainingConfig, {"peak": 1, "batch": True}) == ["batch: True is no <class 'int'>"]
    assert config.parsed(config.PackConfig, {"note": 1}, ignored=["note"]) == config.PackConfig()
    (tmp_path / "c.yaml").write_text("end_id: 7\nout: here\n")
    assert config.from_file(config.PackConfig, str(tmp_path / "c.yaml")) == config.PackConfig(end_id=7, out="here")
    changed = config.overridden(config.PackConfig(), {"out": "OUT", "end_id": "END"}, {"OUT": "x", "END": "3"})
    assert (changed.out, changed.end_id) == ("x", 3)
    assert config.overridden(config.PackConfig(out="y"), {"out": "OUT"}, {"OUT": ""}).out == "y"
    assert config.eval_command("m", ["a", "b"], "o")[6] == "a,b"


def test_npy_shards_round_trip(spark, tmp_path):
    docs = id_docs(spark, [f"{65_000 + k}:{k + 3}" for k in range(40)])
    cut, totals = shards.pack(docs, 100, count=counted())
    sinks.write_npy_shards(cut, f"file://{tmp_path}/out", 100, ended())
    want = shard_ids(cut)
    got = {r.shard_id: r.tokens for r in tables.npy_shards(spark, f"{tmp_path}/out").collect()}
    assert got == want and len(got) == totals["shards_written"]
    assert sorted(p.name for p in (tmp_path / "out").glob("*.npy")) == [f"shard_{k:04d}.npy" for k in sorted(want)]
    assert all(np.load(tmp_path / f"out/shard_{k:04d}.npy").tolist() == ids for k, ids in want.items())
    with pytest.raises(Exception, match="beyond 16 bits"):
        sinks.write_npy_shards(shards.pack(id_docs(spark, ["70000:9"]), 5, count=counted())[0], f"file://{tmp_path}/bad", 5, ended())


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.scratch(Cluster, "x")


def test_no_text_goes_through_the_window(spark):
    docs = spark.createDataFrame([(k, "abc" * k) for k in range(20)], "doc_id long, text string")
    placed, _ = order.place(shards.measured(docs), "n", "doc_id")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ["):]
    assert "text" not in window[: window.index("\n")]
    assert {r.doc_id: r.start for r in placed.collect()} == {k: sum(3 * j + 1 for j in range(k)) for k in range(20)}


def test_request_rows_keep_the_continuation(spark):
    rows = [(1, list(range(1, 9)), [20, 21]), (2, [5], [30]), (3, [7, 8], [40, 41, 42])]
    asked = spark.createDataFrame(rows, "request long, context array<int>, continuation array<int>")
    got = {r.request: r for r in chat.request_batches(asked, 5, 2).collect()}
    assert got[1].ids == [6, 7, 8, 20, 21] and (got[1].scored_from, got[1].length) == (3, 5)
    assert got[2].ids == [5, 30, 0, 0, 0] and got[3].ids == [7, 8, 40, 41, 42]
    assert [(got[k].batch_id, got[k].row) for k in (1, 2, 3)] == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(Exception, match="needs an id of context"):
        chat.request_batches(asked, 3, 2).collect()


def test_nucleus_of_a_large_vocabulary(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=32_000) * 3).tolist()) for k in range(4)]
    for p in (0.0, 0.9):
        got = spark.createDataFrame(rows, "k long, l array<double>").select("k", numeric.nucleus(F.col("l"), p).alias("x")).collect()
        for r in got:
            probs = np.exp(np.array(rows[r.k][1]) - np.max(rows[r.k][1]))
            probs /= probs.sum()
            best = np.argsort(-probs, kind="stable")
            n = int((np.concatenate([[0], np.cumsum(probs[best])[:-1]]) <= p).sum())
            assert [e.idx for e in r.x] == best[:n].tolist() and math.isclose(sum(e.p for e in r.x), 1)


def test_dictionary_ids_keep_order_and_edges(spark):
    docs = spark.createDataFrame([(1, " b a\x0bb\n"), (2, None), (3, ""), (4, "zz a")], "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "word string, id int")
    assert {r.doc_id: r.ids for r in encode.dictionary_ids(docs, vocab).collect()} == {1: [4, 3, 4], 2: [], 3: [], 4: [0, 3]}
    assert encode.dictionary_ids(docs.limit(0), vocab).count() == 0


def test_tokenizer_shards(spark):
    files = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(files.path("word_bpe_49k.json"))
    texts = ["One two three.", None, "", "naïve 日本 words " * 9]
    ids = encode.tokenizer_ids(files.path("word_bpe_49k.json"))(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    cut, _ = shards.pack(ids.withColumn("n", F.size("ids")), 7, count=F.col("n"))
    stream = [x for t in texts for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    got: dict = {}
    for r in cut.select("shard_id", "offset", shards.span_ids(encode.with_end(F.col("ids"))).alias("ids")).orderBy("shard_id", "offset").collect():
        got.setdefault(r.shard_id, []).extend(r.ids)
    assert got == {k: stream[7 * k : 7 * k + 7] for k in range(len(stream) // 7)}


def test_text_columns_fall_back(spark):
    df = spark.createDataFrame([(1, "", "c", None), (2, "t", "c", None), (3, "", "", None), (4, None, None, "k")], "doc_id long, text string, content string, body string")
    assert [(r.doc_id, r.text) for r in tables.text_stream(df, "body").orderBy("doc_id").collect()] == [(1, "c"), (2, "t"), (4, "k")]


def test_stored_shards_and_results(spark, tmp_path):
    for k in (1, 0):
        np.save(tmp_path / f"shard_{k:04d}.npy", np.arange(k, k + 3, dtype=np.uint16) + 65_000)
    got = {r.shard_id: r.tokens for r in tables.npy_shards(spark, str(tmp_path)).collect()}
    assert got == {0: [65_000, 65_001, 65_002], 1: [65_001, 65_002, 65_003]}
    with pytest.raises(FileNotFoundError):
        tables.latest_results(spark, str(tmp_path))
    (tmp_path / "deep").mkdir()
    (tmp_path / "other.json").write_text("{}")
    assert tables.latest_results(spark, str(tmp_path)).endswith("other.json")
    (tmp_path / "deep/results_2.json").write_text('{"results": {"t": {"acc,none": 0.0, "acc_stderr,none": 0.1, "acc_norm,none": 0.5}}}')
    (tmp_path / "deep/results_1.json").write_text("{}")
    assert tables.latest_results(spark, str(tmp_path)).endswith("results_2.json")
    assert sinks.copy_results(spark, str(tmp_path), f"{tmp_path}/canonical.json").endswith("results_2.json")
    assert (tmp_path / "canonical.json").read_text() == (tmp_path / "deep/results_2.json").read_text()
    flat = evaluate.flattened(tables.eval_json(spark, f"{tmp_path}/deep/results_2.json"))
    assert evaluate.chosen_metric(flat).first().value == 0.0
    empty = spark.range(0).selectExpr("id as shard_id", "id as length")
    empty.write.parquet(f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        tables.shards(spark, f"{tmp_path}/none")


def test_watch_handles_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def once():
        handle = lambda batch, _: seen.extend(r.path.rpartition("/")[2] for r in batch.collect())
        watch.watch(watch.files_as_they_come(spark, str(folder)), f"{tmp_path}/checkpoint", handle).awaitTermination()

    for k in range(3):
        (folder / f"step_{k}.pt").write_bytes(b"x" * (k + 1))
        (folder / f"note_{k}.txt").write_text("no")
        once()
    once()
    assert sorted(seen) == ["step_0.pt", "step_1.pt", "step_2.pt"]


def test_packing_rate_counts_packed_tokens(spark):
    import bench

    table = spark.createDataFrame([(k, "abc" * 50) for k in range(20)], "doc_id long, text string")
    assert bench.packed_tokens(shards.shard_summary(shards.pack(table, 100, 5)[0])) == 500
    assert bench.packed_tokens(shards.shard_summary(shards.pack(table, 10_000)[0])) == 0


def test_entry_without_the_optional_package(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("corpusloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("corpusloom.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.reload(__spark_entry__)
    assert "o2_pack_token_shards" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_texts_are_tokenised_some_bytes_at_a_time():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "b" * 10, "c" * 50, "", "d" * 5])
    parts = list(encode.slices(texts, 20))
    assert [(p.start, p.stop) for p in parts] == [(0, 3), (3, 4), (4, 6)]


def test_decoding_keeps_byte_order_marks(spark):
    texts = ["\ufeffa\ufeff", "\ufeff", "a\U0001f600b", "", "  x "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r.k: r.t for r in df.select("k", encode.decode(encode.with_end(encode.code_points(F.col("text")))).alias("t")).collect()}
    assert [got[k] for k in range(len(texts))] == [t.strip(" ") for t in texts]


def test_shard_folders_are_listed_by_few_tasks(spark, tmp_path):
    spark.range(300).selectExpr("id as shard_id", "id as doc_id").coalesce(1).write.partitionBy("shard_id").parquet(f"{tmp_path}/many")
    context = spark.sparkContext
    context.setJobGroup("listing", "")
    try:
        assert tables.shards(spark, f"{tmp_path}/many").columns == ["doc_id", "shard_id"]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(k) for job in tracker.getJobIdsForGroup("listing") for k in tracker.getJobInfo(job).stageIds]
    # Before: a task for each folder to list them, and one for each few files to see if there is a row.
    assert 0 < sum(stage.numTasks for stage in stages) <= 4 * context.defaultParallelism + 2


def test_written_shards_hold_the_code_points_of_their_spans(spark, tmp_path):
    texts = ["", None, "a\U0001f600b", "\x02\x00", "äöü" * 50, "x" * 7]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cut, _ = shards.pack(docs, 10)
    sinks.write_shards(cut, f"{tmp_path}/shards")
    key = ["shard_id", "offset"]
    got = [tuple(r) for r in tables.shards(spark, f"{tmp_path}/shards").select(*key, "length", "doc_id", "ids").orderBy(*key).collect()]
    assert got == [tuple(r) for r in cut.select(*key, "length", "doc_id", shards.span_ids().alias("ids")).orderBy(*key).collect()]
    stream = [x for text in texts for x in [*map(ord, text or ""), 2]]
    assert [x for row in got for x in row[-1]] == stream[: len(stream) // 10 * 10]
