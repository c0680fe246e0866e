"""Requests of tasks, attention, orthogonal updates, uploads."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import attention, evaluate, generate, orthogonal, tasks, training
from corpusloom.streaming import upload

# --- requests


def scores(text_counts, context, continuation, reach=3):
    """The same likelihood from a dictionary of counts."""
    characters = len({n for c, n in text_counts if c == ""}) + 1
    total, top = 0.0, True
    for i, x in enumerate(continuation):
        before = (context + continuation[:i])[-reach:]
        known = next(before[len(before) - k :] for k in range(len(before), -1, -1) if any(c == before[len(before) - k :] for c, _ in text_counts))
        follow = {n: v for (c, n), v in text_counts.items() if c == known}
        total += math.log((follow.get(x, 0) + 1) / (sum(follow.values()) + characters))
        top = top and x == min(follow, key=lambda n: (-follow[n], n))
    return total, top


def test_requests_of_two_kinds_come_back_once_and_in_order(spark):
    docs = spark.createDataFrame([("abcabcabd",), ("abd ",), (None,), ("",), ("日本語\U0001f600!",)], "text string")
    counts = generate.counted(docs.where("text is not null"))
    held = {(r["context"], r["next"]): r["n"] for r in counts.collect()}
    rows = [("x", "ab", ["c", "d", None, "zz"]), ("y", None, ["日本", ""]), (None, "q", None), ("z", "日本語", ["\U0001f600!"])]
    choices = spark.createDataFrame(rows, "item string, context string, choices array<string>").withColumn("task", F.lit("clash"))
    turns = spark.createDataFrame([("t", "abcab"), ("u", None)], "item string, text string").withColumn("n", F.lit(1))
    asked = tasks.requests(choices, "pick", tasks.CHOICES).unionByName(tasks.requests(turns, "turns", tasks.ROLLING))
    got = {(r["task"], r["item"], r["nth"]): r for r in tasks.scored(asked, counts).collect()}
    want = {("pick", i, k): (c or "", x or "") for i, c, xs in rows for k, x in enumerate(xs or [])} | {("turns", "t", 0): ("", "abcab"), ("turns", "u", 0): ("", "")}
    assert set(got) == set(want)
    for key, (context, continuation) in want.items():
        likelihood, hit = scores(held, context, continuation)
        assert got[key]["log_likelihood"] == pytest.approx(likelihood, abs=1e-9), key
        assert (got[key]["is_greedy"], got[key]["n"]) == (hit, len(continuation)), key
    picked = [(r["nth"], r["log_likelihood"], r["n"]) for k, r in got.items() if k[1] == "x"]
    by_item = spark.createDataFrame([("x", *p, 0) for p in picked], "item string, choice int, ll double, length long, gold int")
    assert evaluate.choice_accuracy(by_item).first()["items"] == 1


def test_unscored_kinds_and_missing_columns_are_refused_by_name(spark):
    rows = spark.createDataFrame([(1, "a")], "item long, text string")
    with pytest.raises(Exception, match="generate_until is not a scored request"):
        tasks.requests(rows, "writing", tasks.UNTIL).collect()
    with pytest.raises(Exception, match="no requests of kind other"):
        tasks.requests(rows, "writing", "other").collect()
    with pytest.raises(Exception, match="multiple_choice needs context, choices"):
        tasks.requests(rows, "writing", tasks.CHOICES).collect()
    assert dict(tasks.requests(rows, "reading", tasks.ROLLING).dtypes)["item"] == "bigint"


def test_equal_keys_and_an_empty_corpus(spark):
    rows = spark.createDataFrame([(1, "ab"), (1, "c")], "item long, text string")
    counts = generate.counted(spark.createDataFrame([], "text string"))
    with pytest.raises(ValueError, match="equal keys"):
        tasks.scored(tasks.requests(rows, "a", tasks.ROLLING), counts)
    one = tasks.scored(tasks.requests(rows.limit(1), "a", tasks.ROLLING), counts).first()
    assert (one["log_likelihood"], one["is_greedy"], one["n"]) == (0.0, False, 2)


# --- attention


def direct(q, k, v, at_q, at_k):
    s = np.where(at_k[None] <= at_q[:, None], q @ k.T / math.sqrt(q.shape[1]), -np.inf)
    w = np.exp(s - s.max(axis=1, keepdims=True))
    return w / w.sum(axis=1, keepdims=True) @ v


def vectors(spark, rows, fields):
    return spark.createDataFrame([(s, int(a), *[None if x is None else [float(y) for y in x] for x in xs]) for s, a, *xs in rows], "seq string, at long, " + ", ".join(f"{f} array<double>" for f in fields))


@pytest.mark.parametrize(("span", "block"), [(4, 2), (7, 100), (1000, 3)])
def test_attention_equals_the_direct_sum_whatever_the_tiles(spark, span, block):
    rng = np.random.default_rng(5)
    sizes = {"a": 23, "b": 1, "c": 8}
    held = {s: [rng.normal(0, 6, (n, w)) for w in (4, 4, 3)] for s, n in sizes.items()}
    queries = vectors(spark, [(s, 2 * a, held[s][0][a]) for s, n in sizes.items() for a in range(n)] + [("a", 5, None)], ["q"])
    keys = vectors(spark, [(s, 2 * a, held[s][1][a], held[s][2][a]) for s, n in sizes.items() for a in range(n)], ["k", "v"])
    got = {(r["seq"], r["at"]): r["out"] for r in attention.attend(queries, keys, span=span, block=block).collect()}
    assert len(got) == sum(sizes.values())
    for s, n in sizes.items():
        at = np.arange(n) * 2
        want = direct(*held[s], at, at)
        assert np.allclose([got[s, a] for a in at.tolist()], want, atol=1e-10)


def test_scores_of_any_size_and_queries_before_all_keys(spark):
    queries = vectors(spark, [("a", 0, [1000.0]), ("a", 9, [1000.0]), ("b", 1, [1.0])], ["q"])
    keys = vectors(spark, [("a", 3, [1.0], [2.0]), ("a", 4, [-5.0], [7.0]), ("a", 4, [1.0], [4.0])], ["k", "v"])
    assert [(r["seq"], r["at"], r["out"]) for r in attention.attend(queries, keys, span=2).collect()] == [("a", 9, [3.0])]
    assert attention.attend(queries.limit(0), keys).collect() == []
    with pytest.raises(Exception, match="asks twice"):
        attention.attend(queries.unionByName(queries), keys).collect()


def test_later_positions_see_a_latent_cache_as_in_one_pass(spark):
    rng = np.random.default_rng(2)
    n, up_k, up_v = 14, rng.normal(size=(6, 3)), rng.normal(size=(5, 3))
    latent, rope, q = rng.normal(size=(n, 3)), rng.normal(size=(n, 2)), rng.normal(size=(n, 8))
    turn = lambda x, a: np.concatenate([x[: len(x) // 2] * np.cos(a) - x[len(x) // 2 :] * np.sin(a), x[len(x) // 2 :] * np.cos(a) + x[: len(x) // 2] * np.sin(a)])
    cache = vectors(spark, [("a", a, latent[a], rope[a]) for a in range(n)], ["latent", "rope"]).withColumn("rope", attention.rotated(F.col("rope"), F.col("at"), 2))
    keys = attention.expanded(cache, up_k.tolist(), up_v.tolist())
    new = vectors(spark, [("a", a, q[a]) for a in range(9, n)], ["q"])
    got = {r["at"]: r["out"] for r in attention.attend(new, keys, span=4, block=3).collect()}
    normed = latent / np.sqrt((latent**2).mean(axis=1, keepdims=True) + 1e-6)
    k = np.concatenate([normed @ up_k.T, [turn(rope[a], float(a)) for a in range(n)]], axis=1)
    want = direct(q, k, normed @ up_v.T, np.arange(n), np.arange(n))
    assert sorted(got) == list(range(9, n))
    assert np.allclose([got[a] for a in range(9, n)], want[9:], atol=1e-10)


# --- orthogonal updates


def matrix_rows(spark, matrices, **more):
    rows = [(name, a, row.tolist()) for name, m in matrices.items() for a, row in enumerate(m)]
    out = spark.createDataFrame(rows, "name string, at int, row array<double>")
    for c, kind in more.items():
        out = out.withColumn(c, F.lit(None).cast(kind))
    return out


def iterated(x, steps=5):
    y = x / (np.linalg.norm(x) + 1e-7)
    for _ in range(steps):
        a = y @ y.T
        y = 3.4445 * y - 4.7750 * a @ y + 2.0315 * a @ a @ y
    return y


def collected(df, column="row"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["name"], r["at"])):
        out.setdefault(r["name"], []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def test_singular_values_go_to_one_whichever_side_is_longer(spark):
    rng = np.random.default_rng(0)
    given = {"tall": rng.normal(size=(90, 24)), "wide": rng.normal(size=(9, 24)), "zero": np.zeros((5, 24))}
    got = collected(orthogonal.newton_schulz(matrix_rows(spark, given).repartition(3), 24))
    for name, m in given.items():
        assert np.allclose(got[name], iterated(m), atol=1e-9)
    for name in ("tall", "wide"):
        values = np.linalg.svd(got[name], compute_uv=False)
        assert 0.5 < values.min() <= values.max() < 1.5


def test_a_step_looks_ahead_along_its_momentum(spark):
    rng = np.random.default_rng(3)
    given, grads = rng.normal(size=(12, 4)), [rng.normal(size=(12, 4)) for _ in range(2)]
    held, buffer, want = matrix_rows(spark, {"m": given}, buffer="array<double>"), np.zeros((12, 4)), given
    for g in grads:
        held = orthogonal.muon_step(held, matrix_rows(spark, {"m": g}), 4, rate=0.02)
        buffer = 0.95 * buffer + g
        want = want - 0.02 * iterated(0.95 * buffer + g) * math.sqrt(3)
    assert np.allclose(collected(held)["m"], want, atol=1e-10)
    assert np.allclose(collected(held, "buffer")["m"], buffer, atol=1e-12)
    still = orthogonal.muon_step(held, matrix_rows(spark, {"other": given}), 4, rate=0.02)
    assert np.allclose(collected(still)["m"], want, atol=1e-10)


def test_rows_of_another_width_are_refused(spark):
    rows = spark.createDataFrame([("m", 0, [1.0, 2.0]), ("m", 1, [1.0])], "name string, at int, row array<double>")
    with pytest.raises(Exception, match="a row is not 2 numbers"):
        orthogonal.gram(rows, 2).collect()
    with pytest.raises(ValueError, match="a width of"):
        orthogonal.gram(rows, 0)


# --- uploads


def test_files_are_brought_once_and_missing_ones_skipped(spark, tmp_path):
    source, target = tmp_path / "from", f"file://{tmp_path}/to"
    source.mkdir()
    for k in range(3):
        (source / f"f{k}").write_bytes(bytes([k]) * (k * 100))
    ask = [(f"file://{source}/f{k}", f"deep/g{k}") for k in range(3)] + [(f"file://{source}/none", "none"), (None, "x"), (f"file://{source}/f0", None), (f"file://{source}/f1", "deep/g2")]
    files = spark.createDataFrame(ask, "path string, name string")
    upload.bring(files, 0, target)
    there = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "to" / "deep").iterdir()}
    assert sorted(there) == ["g0", "g1", "g2"]
    assert (tmp_path / "to/deep/g2").read_bytes() == bytes([2]) * 200
    upload.bring(files, 0, target)
    upload.bring(files, 7, target)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "to" / "deep").iterdir()} == there
    assert upload.ledger(spark, target).where("status = 'uploaded'").count() == 3
    assert upload.ledger(spark, target).where("status = 'missing'").count() == 3
    (source / "none").write_bytes(b"late")
    (source / "f1").write_bytes(b"changed")
    upload.bring(files, 8, target)
    assert (tmp_path / "to/none").read_bytes() == b"late"
    assert (tmp_path / "to/deep/g1").read_bytes() == b"changed"


def test_a_batch_that_failed_before_its_ledger_is_brought_again(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"whole")
    folder, target = f"{tmp_path}/asked", f"file://{tmp_path}/to"
    spark.createDataFrame([(f"file://{tmp_path}/a", "a")], "path string, name string").write.parquet(folder)
    read = lambda: spark.readStream.schema("path string, name string").parquet(folder)
    whole = upload.bring

    def failing(files, batch, to):
        files.mapInPandas(lambda rows: rows, files.schema).collect()
        raise RuntimeError("lost")

    monkeypatch.setattr(upload, "bring", failing)
    with pytest.raises(Exception, match="lost"):
        upload.upload(read(), target, f"{tmp_path}/checkpoint").awaitTermination()
    monkeypatch.setattr(upload, "bring", whole)
    for _ in range(2):
        upload.upload(read(), target, f"{tmp_path}/checkpoint").awaitTermination()
    assert (tmp_path / "to/a").read_bytes() == b"whole"
    assert upload.ledger(spark, target).count() == 1


# --- training


def softmax_steps(x, y, classes, steps, mode):
    """Whole-batch steps by the plain formulas."""
    w, b, held = np.zeros((classes, x.shape[1])), np.zeros(classes), {}
    losses = []
    for t in range(steps):
        z = x @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        d = (p - np.eye(classes)[y]) / len(y)
        g = {"w": d.T @ x, "b": d.sum(axis=0)}
        norm = math.sqrt(sum((v**2).sum() for v in g.values()))
        g = {k: v * min(1, 0.05 / (norm + 1e-6)) for k, v in g.items()}
        by = lambda most: most * t / 2 if t < 2 else most * (0.1 + 0.45 * (1 + math.cos(math.pi * (t - 2) / (steps - 2))))  # noqa: B023, E731
        for k in g:
            if k == "w" and mode == "muon":
                held[k] = 0.95 * held.get(k, 0) + g[k]
                w = w - by(0.02) * iterated(0.95 * held[k] + g[k]) * math.sqrt(max(w.shape) / min(w.shape))
                continue
            m, v = held.get(k, (0, 0))
            held[k] = m, v = 0.9 * m + 0.1 * g[k], 0.95 * v + 0.05 * g[k] ** 2
            old = w if k == "w" else b
            new = old - by(0.003) * (0.1 * old + m / (1 - 0.9 ** (t + 1)) / (np.sqrt(v / (1 - 0.95 ** (t + 1))) + 1e-8))
            w, b = (new, b) if k == "w" else (w, new)
    return w, b, losses


@pytest.mark.parametrize("mode", ["adamw", "muon"])
def test_training_is_the_same_for_any_number_of_tasks_and_goes_on_from_a_state(spark, mode):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 80)
    x = rng.normal(size=(80, 5)) + y[:, None]
    given = [(k, x[k].tolist(), int(y[k])) for k in range(80)] + [(80, None, 1), (81, x[0].tolist(), None), (82, x[0].tolist(), -100)]
    rows = spark.createDataFrame(given, "key int, x array<double>, y int")
    plan = training.Plan(total=6, warmup=2, mode=mode, clip=0.05)
    w, b, losses = softmax_steps(x, y, 3, 6, mode)
    for parts in (1, 4):
        state, log = training.train(rows.repartition(parts), plan, 3, 5)
        assert np.allclose(state.weights, w, atol=1e-9) and np.allclose(state.bias, b, atol=1e-9)
        assert [e["n"] for e in log] == [80] * 6
        assert np.allclose([e["loss"] for e in log], losses)
    half, _ = training.train(rows, plan, 3, 5, until=3)
    rest, log = training.train(rows, plan, 3, 5, state=half)
    assert [e["step"] for e in log] == [3, 4, 5]
    assert np.allclose(rest.weights, w, atol=1e-9)


def test_batches_hold_every_row_once_an_epoch(spark):
    rows = spark.range(100).select(F.col("id").alias("key"), F.array(F.lit(1.0)).alias("x"), (F.col("id") % 2).alias("y"))
    _, log = training.train(rows, training.Plan(total=6, batches=3), 2, 1)
    assert sum(e["n"] for e in log[:3]) == 100 == sum(e["n"] for e in log[3:])


def test_diverged_training_and_unknown_modes_are_refused(spark):
    rows = spark.createDataFrame([([float("nan")], 0)], "x array<double>, y int")
    start = training.State(np.zeros((2, 1)), np.zeros(2))
    with pytest.raises(RuntimeError, match="diverged"):
        training.train_step(rows, start, training.Plan(total=1))
    with pytest.raises(ValueError, match="no optimizer mode sgd"):
        training.train_step(rows, start, training.Plan(total=1, mode="sgd"))
    empty, entry = training.train_step(rows.limit(0), start, training.Plan(total=1))
    assert entry["n"] == 0 and not empty.weights.any()


def test_attention_of_the_query_copies_little(spark, monkeypatch):
    """A sequence of a table's usual length is few tiles: each of its rows is dealt to no more than two spans."""
    import math

    seen = {}
    whole = attention.attend
    monkeypatch.setattr(attention, "attend", lambda q, k, scale=None, span=attention.SPAN, block=attention.BLOCK: (seen.update(span=span), whole(q, k, scale, span, block))[1])
    from corpusloom.plans.queries import QUERIES

    QUERIES["m4_attention"](spark, "/root/testdata/sf0.001")
    assert math.ceil(10_000 / seen["span"]) <= 2


def test_counts_are_tallied_before_they_are_rows(spark, monkeypatch):
    """One row for each context of a batch and not for each character; the same counts by brute force, whatever the alphabet."""
    import collections

    import pyarrow as pa

    wide = "".join(chr(0x4E00 + k) for k in range(3000)) * 2
    for texts in (["abcabcabc", None, "", "ab\x00"] * 50, [wide, wide[5:900]], [wide * 6 + "".join(chr(0x1F000 + k) for k in range(40_000))]):
        want = collections.Counter((t[max(0, k - 3) : k], t[k : k + 1]) for t in (x or "" for x in texts) for k in range(len(t) + 1))
        got = generate._tally(pa.array(texts, pa.string()), 3)
        assert {(r["context"], r["next"]): r["n"] for r in got.to_pylist()} == want and got.num_rows == len(want)
