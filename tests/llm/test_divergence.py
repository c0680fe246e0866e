"""Operator 13 against brute force in whole numbers of any size."""

from __future__ import annotations

import cProfile
import pstats
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import divergence
from tests.llm import data

SCHEMA = "doc_id long, text string, lang string, source string"


def expected(rows, least=10, top=10):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", data.ascii_lower(text))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= least]
        own = sorted(s for la, s in groups if la == lang)

        def share(count, kept=kept):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // whole for t in kept}

        p, q = {s: share(n[lang, s]) for s in own}, share(sum((n[lang, s] for s in own), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            more = [(t, far(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", more, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def made(spark, rows, **kw):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA).coalesce(3), **kw).collect())


def corpus(sources=7):
    rows = [(k, " ".join(f"{w.rstrip('0123456789')}{chr(97 + int(w[1:]) % 26)}" for w in data.prose(k, 5 + k % 9).split()) + " Éa Über zz" * (k % 3), "en" if k % 4 else "de", f"s{k % sources}") for k in range(160)]
    return [*rows, rows[0], (900, None, None, None), (901, "", "", "x"), (902, "The THE the", "fr", "only"), (903, None, "en", "silent"), (904, "w " * 5000, "de", "s0")]


@pytest.mark.parametrize(("chunk", "span", "block"), [(4096, 4, 64), (3, 2, 2), (1, 1, 1)])
def test_values_do_not_depend_on_the_tiling(spark, chunk, span, block):
    assert made(spark, corpus(), least=4, chunk=chunk, span=span, block=block) == expected(corpus(), least=4)


def test_empty_table_and_languages_without_terms(spark):
    assert made(spark, []) == []
    rows = [(1, "a b", "en", "x"), (2, "b c", "en", "y"), (3, None, "en", None), (4, "a", "fr", "x")]
    assert made(spark, rows) == expected(rows)
    assert [r[4] for r in made(spark, rows) if r[2] == "pair"] == [0] * 6


def test_counts_that_are_handed_on_early(spark, monkeypatch):
    rows = corpus(2)
    want = expected(rows)
    found = divergence._Counts
    monkeypatch.setattr(divergence, "HELD_COUNTS", 3)
    assert found and made(spark, rows) == want


def batch(rows):
    return pa.RecordBatch.from_pydict({"text": [r[0] for r in rows], "lang": [r[1] for r in rows], "source": [r[2] for r in rows]})


@pytest.mark.parametrize(("counts", "size"), [(10**6, 16 << 20), (3, 16 << 20), (10**6, 200), (0, 0)])
def test_counts_of_a_task(monkeypatch, counts, size):
    monkeypatch.setattr(divergence, "HELD_COUNTS", counts)
    monkeypatch.setattr(divergence, "HELD_BYTES", size)
    monkeypatch.setattr(divergence.textvec.chunks, "__defaults__", ("text", 100))
    rows = [((text or "") + " ÀB" * (k % 2), lang or "", source or "") for k, text, lang, source in corpus()]
    n, docs = Counter(), Counter()
    for text, *group in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", data.ascii_lower(text))
        n.update((*group, w) for w in words)
        docs.update({(*group, w) for w in words})
    got, n_got, docs_got = list(divergence._count(iter([batch(rows[:50]), batch([]), batch(rows).slice(50)]))), Counter(), Counter()
    for lang, source, term, times, rows_with in (r.values() for b in got for r in b.to_pylist()):
        n_got[lang, source, term] += times
        docs_got[lang, source, term] += rows_with
    assert (n_got, docs_got) == (n, docs)
    assert len(n) == sum(b.num_rows for b in got) or (counts, size) != (10**6, 16 << 20)


def test_terms_of_a_task_cost_no_python_step_each_and_are_handed_on_once():
    letters = np.array([chr(97 + k) for k in range(26)])
    words = ["".join(w) for w in letters[np.arange(50_000)[:, None] // 26 ** np.arange(4) % 26]]
    rows = [(" ".join(words[k : k + 500]), "en", f"s{half}") for _ in range(2) for half in (0, 1) for k in range(0, len(words), 500)]
    profile = cProfile.Profile()
    handed_on = sum(b.num_rows for b in profile.runcall(lambda: list(divergence._count(iter([batch(rows)])))))
    assert handed_on == 2 * len(words)
    assert pstats.Stats(profile).total_calls < len(words) // 2


def test_further_columns_are_not_looked_at(spark):
    docs = data.docs(spark)
    assert data.results(divergence.audit(data.clashing(docs), least=1)) == data.results(divergence.audit(docs, least=1)) != []


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**15), st.integers(1, 8 * 10**15))
def test_shares_are_exact(count, more):
    whole = count + 2 + more
    assert divergence.shares(np.array([count]), np.array([whole])).tolist() == [1 + 10**9 * (count + 2) // whole]


def test_shares_as_a_column(spark):
    rows = [(0, 2), (5, 9), (10**15, 9 * 10**15), (7 * 10**14, 7 * 10**14 + 2)]
    got = spark.createDataFrame(rows, "n long, whole long").select(divergence._share(F.col("n"), F.col("whole"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // whole for n, whole in rows]
