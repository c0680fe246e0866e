"""Operator 12 against brute force over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical
from tests.llm import data

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", data.ascii_lower(text))


def expected(docs, items, most=20):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in Counter(terms(text)).items() if c[t])
            if s:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=repr)


def corpus(n=300, seed=3):
    """Words by a steep law, so that some are rare; ties, copies, nulls, an empty and a very long text."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    weights = [1 / (k + 1) ** 1.1 for k in range(2000)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(5, 80)))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " ".join(rng.choices(words, weights, k=30_000))), (None, docs[0][1]), (None, docs[0][1]), (n + 3, docs[0][1]), docs[5], docs[5], (n + 4, "Zürich ZÜRICH W1 a-b_c w1.w2")]
    items = [(k, " ".join(docs[k][1].split()[:12])) for k in range(0, 60, 4)] + [(100, "W1 w2 W1 zÜrich"), (101, None), (102, "--"), (103, "unheard of"), (None, "w3 w4"), (100, "w9"), (104, "w1999 w1 w2 w3")]
    return docs, items


def found(spark, docs, items, **kw):
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in lexical.search(df, spark.createDataFrame(items, ITEMS), **kw).collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"tiers": ()}, {"tiers": (0.02, 0.1, 0.5), "most": 3}, {"pass_items": 4, "pass_words": 20, "tiers": (0.3,)}])
def test_results_equal_brute_force(spark, kw):
    docs, items = corpus()
    assert found(spark, docs, items, **kw) == expected(docs, items, kw.get("most", 20))


def test_some_items_are_proven_early_and_the_rest_fall_through(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 500)  # sums in many parts
    docs, items = corpus(1200, 8)
    report: list[dict] = []
    assert found(spark, docs, items, most=2, tiers=(0.1, 0.4), report=report) == expected(docs, items, 2)
    assert [r["tier"] for r in report] == [0, 1, 2] and 0 < report[0]["proven"] + report[1]["proven"] < report[0]["open"]
    assert all(a["open"] - a["proven"] == b["open"] for a, b in zip(report, report[1:], strict=False))


def test_sums_in_whole_numbers_for_long_items(spark, monkeypatch):
    docs, items = corpus(80)
    plain = lexical._added
    monkeypatch.setattr(lexical, "_added", lambda *a, **kw: plain(*a[:8], False, *a[9:], **kw))
    assert found(spark, docs, items) == expected(docs, items)


def test_empty_tables_and_further_columns(spark):
    docs, items = corpus(70)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    table = data.docs(spark)
    bench = spark.createDataFrame([(1, data.prose(99, 20)), (2, "w1 w2")], ITEMS)
    want = data.results(lexical.search(table, bench))
    assert data.results(lexical.search(data.clashing(table), data.clashing(bench))) == want
    assert want == expected([(r[0], r[1]) for r in data.rows()], [(1, data.prose(99, 20)), (2, "w1 w2")])


def test_the_best_are_kept_in_lots():
    rng = np.random.default_rng(1)
    best, rows = lexical._Best(3, 5), []
    for _ in range(40):
        item, score, doc = rng.integers(0, 3, 50), rng.integers(1, 30, 50), rng.integers(0, 1000, 50)
        rows += list(zip(item.tolist(), (-score).tolist(), doc.tolist(), strict=True))
        best.add(item, score, doc, np.zeros(50, bool))
        if rng.random() < 0.3:
            best.settle()
    item, score, doc, _ = best.settle()
    for k in range(3):
        assert [(-s, d) for i, s, d in zip(item.tolist(), score.tolist(), doc.tolist(), strict=True) if i == k] == [(s, d) for i, s, d in sorted(rows) if i == k][:5]
