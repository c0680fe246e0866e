"""Operator 3 on many calls with several needs, and operator 9 on URLs of many characters."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import toolcalls, urls

CALLS = "conv_id long, call_id string, turn long, after array<string>"


def brute(rows):
    """Layer by layer, for each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {k: (turn or 0, after) for c, k, turn, after in rows if c == conv}
        needs = {k: {a for a in after or () if a in own and a != k} for k, (_, after) in own.items()}
        keys = {}
        while True:
            ready = [k for k in own if k not in keys and needs[k] <= keys.keys()]
            if not ready:
                break
            for k in ready:
                keys[k] = max([own[k][0], *(keys[a] + 1 for a in needs[k])])
        out |= {(conv, k): keys.get(k) for k in own}
    return out


def graph(seed, conv, n, back=3):
    """Calls with two or three needs of calls before or, at times, behind them; turns against the order."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        after = [f"c{rng.randrange(max(0, k - 6), k)}" for _ in range(rng.randrange(back))] if k else []
        if rng.random() < 0.03:
            after.append(f"c{rng.randrange(n)}")
        rows.append((conv, f"c{k}", n - k if rng.random() < 0.5 else k, after))
    return rows


@pytest.mark.parametrize("most", [1_024, 12, 0])
def test_any_graph_in_rows_and_in_layers(spark, monkeypatch, most):
    monkeypatch.setattr(toolcalls, "GATHERED", most)
    rows = [r for k in range(5) for r in graph(k, k, 3 + 4 * k)] + [(None, None, 2, ["a", "b"]), (None, "a", 9, None), (None, "b", 3, [None, "a"]), (None, "z", 0, ["a", "b"])]
    got = {(r.conv_id, r.call_id): r.order_key for r in toolcalls.order_keys(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == brute(rows)


def test_a_thousand_calls_that_each_need_two(spark):
    n = 1_000
    rows = [(1, f"c{k}", n - k, [f"c{j}" for j in (k - 1, k - 2) if j >= 0]) for k in range(n)] + [(2, "x", 1, ["y", "z"]), (2, "y", 0, ["x", "z"]), (2, "z", 5, [])]
    began = time.monotonic()
    got = {(r.conv_id, r.call_id): r.order_key for r in toolcalls.order_keys(spark.createDataFrame(rows, CALLS)).collect()}
    assert time.monotonic() - began < 60
    assert got == brute(rows)


def test_entropy_of_many_characters_takes_no_square_of_them(spark):
    texts = ["", "a", "aab", "Zürich/é😀", "".join(chr(0x4E00 + k % 20_000) for k in range(40_000))]
    began = time.monotonic()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(urls._entropy(F.col("t"))).collect()]
    assert time.monotonic() - began < 30
    for text, bits in zip(texts, got, strict=True):
        assert math.isclose(bits, sum(-n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()), abs_tol=1e-9)
