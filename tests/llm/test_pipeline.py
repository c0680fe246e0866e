"""The pipeline, stage by stage, against brute force, and what a lost driver finds again."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import packing, storage
from tests.llm.data import SCHEMA, ascii_lower, clashing, docs, prose, rows, words
from tests.llm.test_groups_and_models import jaccard_groups, near_copies
from tests.llm.test_text_operators import direct_ids, removed_words, verdict

ITEM = " ".join(prose(103, 150).split()[40:70])


def table():
    rng = random.Random(12)
    shared = prose(99, 60)
    few = [f"t{k}" for k in range(12)]
    out = [*rows(), *near_copies(), (970, "SHOUT " * 60, "en", "a", 360), (971, prose(71, 80) + " " + shared, "en", "a", 1), (972, ITEM + " tail", "en", "a", 1)]
    # Texts of few shingles: of eight words, and so of four shingles, the last differs.
    out += [(980 + k, " ".join([*few[:11], f"end{k}"]), "en", "a", 1) for k in range(3)]
    out += [(990 + k, "\n".join([" ".join(few[k : k + 6])] * 2 + [prose(rng.randrange(99), 30)]), "en", "a", 1) for k in range(3)]
    return out


def items():
    return [(1, ITEM), (2, None), (3, "w1, w2; W3!")]


def ruled(given):
    return [r for r in given if verdict(r[1])]


def deduped(given):
    known = [r for r in given if r[0] is not None]
    label = jaccard_groups(known)
    least: dict = {}
    for r, g in zip(known, label, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    kept: dict = {}
    for r, g in zip(known, label, strict=True):
        if r[0] == least[g] and (r[0] not in kept or (r[1] or "") < (kept[r[0]][1] or "")):
            kept[r[0]] = r
    return [*kept.values(), *(r for r in given if r[0] is None)]


def unrepeated(given):
    """Texts without the windows of 20 words that start earlier; unchanged texts as they stand."""
    cut = {(d, n, g): t for d, t, n, g in removed_words(given, 20)}
    out = []
    for r in given:
        (text,) = {t for (d, _, g), t in cut.items() if d == r[0] and (g and t is not None or words(t) == words(r[1]))} or {r[1]}
        gone = len(words(text)) != len(words(r[1]))
        text = text if gone else r[1]
        out.append((*r[:1], text, *r[2:4], None if text is None else len(text)))
    return out


def decontaminated(given):
    spot = lambda t: [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))]
    windows = set()
    for _, text in items():
        w = [x[2] for x in spot(text)]
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    out = []
    for r in given:
        w = spot(r[1])
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(x[2] for x in w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if sum(hit) > 0.5 * len(w):
            continue
        text = r[1]
        for i in range(len(w) - 1, -1, -1):
            if hit[i]:
                # Inside a run everything goes, up to the next hit word.
                end = w[i + 1][0] if i + 1 < len(w) and hit[i + 1] else w[i][1]
                text = text[: w[i][0]] + text[end:]
        out.append((*r[:1], text, *r[2:4], None if text is None else len(text)))
    return out


def test_every_stage_equals_brute_force(spark, tmp_path):
    given = table()
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, [ruled, deduped, unrepeated, decontaminated, None], strict=True):
        df = storage.written(docs(spark, given), "given")
        found = stage(spark, df, str(tmp_path))
        if plain is None:
            break
        assert found.columns == df.columns
        want = plain(given)
        assert Counter(tuple(r) for r in found.collect()) == Counter(want), name
        given = want
    pieces = Counter((r.doc_id, r.doc_tokens, r.start, r.length) for r in found.collect())
    want = Counter((r[0], n, start, length) for r in given for n in [len(direct_ids(r[1])) + 1] for start, length, _ in packing.cuts(n, packing.CAPACITY))
    assert pieces == want


def test_stages_carry_any_column(spark, tmp_path):
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = clashing(docs(spark, [*table(), table()[0]]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.dtypes == df.dtypes
        df = storage.written(out, "stage")
        for r in df.collect():
            assert r["a.b"] == "own a.b" and r["my col"] == "own my col" and r["a map"] == {"k": 1}


def test_a_lost_driver_goes_on_where_it_stood(spark, tmp_path, monkeypatch):
    docs(spark, [r for r in table() if r[0] is not None]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    ran, stages = [], list(corpus_pipeline.STAGES)

    def lost(*_):
        raise RuntimeError("lost")

    def noted(name, stage):
        return name, lambda *given: ran.append(name) or stage(*given)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:2], (stages[2][0], lost), *stages[3:]])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, str(tmp_path), run_id="again")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in stages])
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path), run_id="again").collect()) == want
    assert ran == [name for name, _ in stages[2:]]


def test_a_run_leaves_its_last_stage_alone_behind(spark, tmp_path, monkeypatch):
    docs(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    corpus_pipeline.run(spark, str(tmp_path), run_id="one").count()
    (run,) = (tmp_path / "shared").iterdir()
    assert [p.name for p in run.iterdir() if not p.name.startswith(".")] == ["3-benchmark_decontamination"]


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Cluster)


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
