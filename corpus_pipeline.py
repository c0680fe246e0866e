"""A corpus pipeline of five operators; each stage's rows are written and read by the next.

Quality rules drop documents, near-dedup keeps one of each group of near copies (five-word
shingles, similarity 0.8), substring dedup cuts repeated passages of 20 words or more out of
all but their first place, decontamination cuts benchmark passages of 10 words or more out
of the texts (and drops documents that are mostly such), and packing lays the rest out in
token windows. A stage that changes a text sets n_chars to the new length. Further columns,
whatever their names, go through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, packing, queries, rules, simhash, storage, substrings


def _resized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars after its text, if it has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(storage.unpacked(substrings.dedup(docs, carry=True, verbatim=True), docs), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(decontaminate.remove(docs, queries.table(spark, sf_dir, "benchmark")), docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.word_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("token_packing", token_packing),
]

#: Similarity groups, repeated passages and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The last stage's rows over the whole documents table.

    Each stage's rows go to a folder of the run in the shared folder. A driver that is started
    again with the run_id of a lost one goes on behind the last stage that was finished; what a
    finished stage has read or left behind is deleted.
    """
    folder = f"{storage.shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    done = max((k for k, path in enumerate(paths) if storage.exists(spark, f"{path}/_SUCCESS")), default=-1)
    docs = queries.table(spark, sf_dir, "documents") if done < 0 else spark.read.parquet(paths[done])
    for k in range(done + 1, len(paths)):
        with storage.scope(spark):
            STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            storage.delete(spark, paths[k - 1])
    return STAGES[-1][1](spark, docs, sf_dir)
