"""Connected components of a link table by alternating star contractions.

No node's neighbours are gathered: each round takes minima by a partial aggregate and joins
them back, and every round's table is written, so a hub's rows can be split and a lost
executor costs one round at most. A table that is counted to have SMALL_EDGES links or less
(below two megabytes) is gone through by one task instead; the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import storage

#: Rounds grow with the logarithm of the longest chain of links.
MOST_ROUNDS = 200
#: Links that one task goes through.
SMALL_EDGES = 100_000


def spanned(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n reaches by the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = np.minimum(new, new[label])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _by_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of a small table of links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if parts:
            u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = node[spanned(len(node), at[: len(u)], at[len(u) :])]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, component long")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b): the smallest node it reaches."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = storage.written(edges, "edges")
    state = _digest(edges)
    if not state[0]:
        return _resting_on(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), edges)
    if state[0] <= SMALL_EDGES:
        return _resting_on(_by_one_task(edges), edges)
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = storage.written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = storage.written(large, "large")
        lower = storage.written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = storage.written(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (edges, least, large, lower):
            storage.drop(old)
        edges, before, state = new, state, _digest(new)
        if state == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return _resting_on(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), edges)
    raise RuntimeError("the components did not settle")


def _resting_on(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, for storage.drop to delete the table that it reads."""
    df._corpusloom_path = table._corpusloom_path
    return df


def settled(links: DataFrame, label: str) -> DataFrame:
    """components(links), written, and what it took deleted."""
    found = components(links)
    out = storage.written(found, label)
    storage.drop(found)
    return out


def extended(found: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """found(node, component) with further links(a, b), written: only components that these join are gone through again."""
    mapped = links.select("a", "b")
    for x in "ab":
        mapped = mapped.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    mapped = mapped.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = settled(mapped, "over").withColumnsRenamed({"node": "was", "component": "root"})
    old = found.join(over, found.component == over.was, "left").select("node", F.coalesce("root", "component").alias("component"))
    new = over.join(found, over.was == found.node, "left_anti").select(F.col("was").alias("node"), F.col("root").alias("component"))
    return storage.written(old.union(new), label)
