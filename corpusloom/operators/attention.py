"""Causal attention over long sequences, as tiles whose softmax sums are merged.

A sequence's positions are cut into spans. A task sees one span of queries and one span of keys,
goes through the keys block by block, and keeps for each query the largest score, the sum of
weights below it, and the weighted vector. These three merge in any order, so spans of keys are
merged behind it by an expression. No position meets another as a row: a query and a key are
copied once for each span of the other side, and no task holds more than two spans, whatever
the length of the sequence; a sequence that holds most rows is many keys. What is copied is half
the sequence's length over the span, so a span is as long as a task can hold: at 64 values, some
16 MB of queries and sums and 8 MB of keys and values.

Queries and keys are two tables, so keys may be a cache: new positions attend to all that was
kept before. The latent form keeps a narrow vector and a small rotated part for each position,
and `expanded` makes keys and values of them.

Positions are whole numbers of 0 or more and need not be dense: a query sees every key that is
not behind it. Keys may share a position; queries of a sequence that do are an error. Rows with a
null position or vector take no part, and a query that sees no key has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import numeric

#: Positions of a span (a side of a tile), and of a block of keys within it.
SPAN, BLOCK = 8192, 128
PARTIAL = "seq {seq}, at long, top double, mass double, sum array<double>"


def projected(values: Column, weights: list[list[float]]) -> Column:
    """weights (rows of numbers) times values."""
    rows = F.array(*[F.array(*map(F.lit, row)) for row in weights])
    return F.transform(rows, lambda row: numeric.total(F.zip_with(row, values, lambda a, b: a * b)))


def rotated(values: Column, at: Column, width: int, base: float = 10_000.0) -> Column:
    """values (of an even width) turned by their position: value k and the one half the width on are a pair."""
    half = width // 2
    angles = F.array(*[at * F.lit(base ** (-2 * k / width)) for k in range(half)])

    def turned(x: Column, a: Column) -> Column:
        low, high = F.slice(x, 1, half), F.slice(x, half + 1, half)
        pick = lambda one, other, sign: F.transform(one, lambda v, k: v * F.cos(F.get(a, k)) + F.lit(sign) * F.get(other, k) * F.sin(F.get(a, k)))
        return F.concat(pick(low, high, -1.0), pick(high, low, 1.0))

    return numeric.let(numeric.doubles(values), lambda x: numeric.let(angles, lambda a: turned(x, a)))


def expanded(cache: DataFrame, up_k: list[list[float]], up_v: list[list[float]]) -> DataFrame:
    """keys(seq, at, k, v) of cache(seq, at, latent, rope): the latent is brought to the head's width, the rotated part follows."""
    latent = numeric.rms_norm(numeric.doubles(F.col("latent")))
    normed = cache.select("seq", "at", latent.alias("latent"), numeric.doubles(F.col("rope")).alias("rope"))
    return normed.select("seq", "at", F.concat(projected(F.col("latent"), up_k), "rope").alias("k"), projected(F.col("latent"), up_v).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    held = column.combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _tile(scale: float | None, block: int):
    """Running sums of one span of queries over one span of keys."""

    def run(queries: pa.Table, keys: pa.Table) -> pa.Table:
        n = len(queries)
        top, mass = np.full(n, -np.inf), np.zeros(n)
        if n == 0 or len(keys) == 0:
            none = pa.array([], pa.float64())
            return pa.table({"seq": queries["seq"].slice(0, 0), "at": pa.array([], pa.int64()), "top": none, "mass": none, "sum": pa.array([], pa.list_(pa.float64()))})
        q, k, v = _matrix(queries["q"]), _matrix(keys["k"]), _matrix(keys["v"])
        seen, given = queries["at"].to_numpy(), keys["at"].to_numpy()
        if len(np.unique(seen)) < n:
            raise ValueError(f"sequence {queries['seq'][0]} asks twice at a position")
        total, factor = np.zeros((n, v.shape[1])), scale if scale is not None else q.shape[1] ** -0.5
        for low in range(0, len(given), block):
            part = slice(low, low + block)
            scores = np.where(given[None, part] <= seen[:, None], q @ k[part].T * factor, -np.inf)
            higher = np.maximum(top, scores.max(axis=1))
            anchor = np.where(np.isneginf(higher), 0.0, higher)
            weights, fade = np.exp(scores - anchor[:, None]), np.exp(top - anchor)
            top, mass, total = higher, mass * fade + weights.sum(axis=1), total * fade[:, None] + weights @ v[part]
        kept = np.flatnonzero(mass > 0)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * v.shape[1], pa.int32()), pa.array(total[kept].ravel()))
        return pa.table({"seq": queries["seq"].take(pa.array(kept)), "at": queries["at"].take(pa.array(kept)), "top": top[kept], "mass": mass[kept], "sum": sums})

    return run


def merged(partials: Column) -> Column:
    """The weighted mean that an array of (top, mass, sum) stands for."""

    def whole(top: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            share = F.exp(x["top"] - top)
            sums = F.when(F.size(acc["sum"]) == 0, F.transform(x["sum"], lambda y: y * share)).otherwise(F.zip_with(acc["sum"], x["sum"], lambda a, y: a + y * share))
            return F.struct((acc["mass"] + x["mass"] * share).alias("mass"), sums.alias("sum"))

        start = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<double>").alias("sum"))
        return F.aggregate(partials, start, add, lambda acc: F.transform(acc["sum"], lambda y: y / acc["mass"]))

    return numeric.let(F.array_max(F.transform(partials, lambda x: x["top"])), whole)


def attend(queries: DataFrame, keys: DataFrame, scale: float | None = None, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(seq, at, out) of queries(seq, at, q) and keys(seq, at, k, v); scores are scaled by the root of q's width unless told otherwise."""
    own = lambda at: F.call_function("div", at, F.lit(span).cast("long"))
    asked = queries.where("seq is not null and at is not null and q is not null").select("seq", F.col("at").cast("long").alias("at"), numeric.doubles(F.col("q")).alias("q"))
    asked = asked.withColumn("_q", own(F.col("at")))
    held = keys.where("seq is not null and at is not null and k is not null and v is not null")
    # New names for the columns of one side, which may stem from the same table as the other.
    held = held.select(F.col("seq").alias("seq"), F.col("at").cast("long").alias("at"), numeric.doubles(F.col("k")).alias("k"), numeric.doubles(F.col("v")).alias("v")).withColumn("_k", own(F.col("at")))
    # One row a sequence: from where on it is asked and held. Sequences without the other side drop out.
    asks = asked.groupBy("seq").agg(F.min("_q").alias("_from"), F.max("_q").alias("_to"))
    holds = held.groupBy("seq").agg(F.min("_k").alias("_begin"))
    dealt = asked.join(holds, "seq").where(F.col("_begin") <= F.col("_q")).select("seq", "at", "q", "_q", F.explode(F.sequence("_begin", "_q")).alias("_k"))
    copies = held.join(asks, "seq").where(F.col("_k") <= F.col("_to")).select("seq", "at", "k", "v", "_k", F.explode(F.sequence(F.greatest("_from", "_k"), F.col("_to"))).alias("_q"))
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
    tiles = dealt.groupBy("seq", "_q", "_k").cogroup(copies.groupBy("seq", "_q", "_k"))
    partials = tiles.applyInArrow(_tile(scale, block), PARTIAL.format(seq=dict(dealt.dtypes)["seq"]))
    each = partials.groupBy("seq", "at").agg(F.collect_list(F.struct("top", "mass", "sum")).alias("_partials"))
    return each.select("seq", "at", merged(F.col("_partials")).alias("out"))
