"""Words made to have equal sums of bytes times powers are told apart by every operator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpusloom.llm import decontaminate, packing, queries, simhash, substrings, textvec, wordbpe
from tests.llm import data


def twins(n: int) -> tuple[str, str]:
    """The Thue-Morse word of n letters and its complement: equal sums modulo 2**64 for any odd base."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


LENGTHS = [1024, 4096]


@pytest.mark.parametrize("n", LENGTHS)
def test_hashes_differ(n):
    words = textvec.Words(pa.array([" ".join(twins(n))]))
    one, two = words.digests()
    assert one[0] != one[1] and two[0] != two[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é😀 \n", max_size=90), max_size=12))
def test_distinct_words_are_told_by_their_bytes(texts):
    words = textvec.Words(pa.array(texts, pa.string()))
    first, back = words.distinct()
    spelt = [words.word(i) for i in range(len(words))]
    assert spelt == [w.encode() for t in texts for w in data.words(t)]
    assert [spelt[i] for i in first[back]] == spelt
    assert len({spelt[i] for i in first}) == len(first)
    one, two = words.digests()
    assert len(set(zip(one.tolist(), two.tolist(), strict=True))) == len(set(spelt))


def test_words_whose_quick_hashes_meet_are_told_by_their_bytes(monkeypatch):
    monkeypatch.setattr(textvec, "mix", lambda z: z & np.uint64(1))
    texts = ["one two three one four two", "three " + "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y"]
    words = textvec.Words(pa.array(texts))
    first, back = words.distinct()
    spelt = [words.word(i) for i in range(len(words))]
    assert [spelt[i] for i in first[back]] == spelt
    assert len(first) == len(set(spelt))


@pytest.mark.parametrize("n", LENGTHS)
def test_op2_keeps_a_window_that_only_looks_equal(spark, n):
    a, b = twins(n)
    head = " ".join(f"h{k}" for k in range(19))
    docs = data.docs(spark, [(1, f"{head} {a}", "en", "s", 1), (2, f"{head} {b}", "en", "s", 1), (3, f"{head} {a}", "en", "s", 1)])
    assert {r.doc_id: r.n_removed for r in substrings.dedup(docs).collect()} == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("n", LENGTHS)
def test_op4_gives_each_word_its_own_ids(spark, n):
    from tokenizers import Tokenizer

    a, b = twins(n)
    path = queries.word_tokenizer()
    tokenizer, encoder = Tokenizer.from_file(path), wordbpe.encoder(path)
    for texts in ([f"{a} {b}"], [b], [a]):  # the table outlives a batch
        ids, ends = encoder.encode(pa.array(texts))
        assert ids.tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids and ends[-1] == len(ids)
    import zlib

    pieces = packing.pack(data.docs(spark, [(1, a, "en", "s", 1), (2, b, "en", "s", 1)]), path).collect()
    for doc_id, text in ((1, a), (2, b)):
        want = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for p in pieces:
            if p.doc_id == doc_id:
                assert p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(want)


@pytest.mark.parametrize("n", LENGTHS)
def test_op6_finds_both_items(spark, n):
    a, b = twins(n)
    items = spark.createDataFrame([("x", a), ("y", b)], "item_id string, text string")
    docs = data.docs(spark, [(1, a, "en", "s", 1), (2, b, "en", "s", 1)])
    assert {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.scan(docs, items).collect()} == {1: (1, ["x"]), 2: (1, ["y"])}


@pytest.mark.parametrize("n", LENGTHS)
def test_the_stages_keep_both(spark, n, tmp_path):
    a, b = twins(n)
    docs = data.docs(spark, [(1, a, "en", "s", 1), (2, b, "en", "s", 1)])
    assert {r.doc_id for r in simhash.first_of_each(docs).collect()} == {1, 2}
    spark.createDataFrame([("x", " ".join(f"i{k}" for k in range(12)))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} == {1, 2}, name
