"""Token streams cut into blocks: shards, batches and windows are spans of positions.

A document with n tokens from position `start` on reaches the blocks start div size to
(start + n - 1) div size. All operators work on such spans; token ids are made last, for the
spans that are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import encode
from corpusloom.operators import order


def measured(docs: DataFrame, count: Column | None = None, order_column: str = "doc_id") -> DataFrame:
    """docs with `n`, the tokens of each with its closing id."""
    count = encode.code_point_count(F.col("text")) if count is None else count
    return docs.withColumn("n", (count + 1).cast("long"))


def skip_prefix(placed: DataFrame, skip: int, total: int) -> tuple[DataFrame, int, int]:
    """Documents that begin at or after `skip`, moved to position zero; (rows, skipped, left).

    The document that reaches or crosses the boundary goes with the prefix.
    """
    kept = placed.where(F.col("start") >= skip)
    first = kept.agg(F.min("start")).first()[0]
    skipped = total if first is None else first
    return kept.withColumn("start", F.col("start") - skipped), skipped, total - skipped


def spans(placed: DataFrame, size: int, block: str = "block") -> DataFrame:
    """A row per document and block: block, `begin` (in the document), `length`, `offset` (in the block)."""
    end = F.col("start") + F.col("n")
    low, high = F.expr(f"start div {int(size)}"), F.expr(f"(start + n - 1) div {int(size)}")
    cut = placed.withColumn(block, F.explode(F.sequence(low, high)))
    first, last = F.greatest(F.col("start"), F.col(block) * size), F.least(end, (F.col(block) + 1) * size)
    return cut.withColumns({"begin": first - F.col("start"), "length": last - first, "offset": first - F.col(block) * size})


def span_ids(ids: Column | None = None) -> Column:
    """Ids of a span row, from the document's ids with the closing one; by default the code
    points of its text. An encoder's ids are best stored before the cut, as each span asks for them."""
    if ids is None:
        return encode.code_point_span(F.col("text"), F.col("begin"), F.col("length"))
    return F.slice(ids, (F.col("begin") + 1).cast("int"), F.col("length").cast("int"))


def span_text() -> Column:
    """The text whose code points are the default span_ids."""
    return encode.span_text(F.col("text"), F.col("begin"), F.col("length"))


def checksum(ids: Column, offset: Column) -> Column:
    """Sum of id * (position + 1): tells content and order apart, exact in longs."""
    weighed = F.transform(ids, lambda t, i: t.cast("long") * (offset + i + 1))
    return F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x)


def pack(docs: DataFrame, size: int, max_shards: int | None = None, skip: int = 0, count: Column | None = None, order_column: str = "doc_id") -> tuple[DataFrame, dict]:
    """Spans of the full shards of the stream behind its prefix, and the totals.

    Documents run on from shard to shard; the last, partial shard is not kept.
    """
    placed, totals = order.place(measured(docs, count), "n", order_column)
    placed, skipped, left = skip_prefix(placed, skip, totals.get(None, 0))
    shards = left // size if max_shards is None else min(left // size, max_shards)
    # Before the explode: a document behind the last shard makes no span.
    cut = spans(placed.where(F.col("start") < shards * size), size, "shard_id").where(F.col("shard_id") < shards)
    return cut, {"shards_written": shards, "tokens_written": shards * size, "tokens_skipped": skipped}


def shard_summary(cut: DataFrame, ids: Column | None = None) -> DataFrame:
    part = checksum(span_ids(ids), F.col("offset"))
    return cut.withColumn("part", part).groupBy("shard_id").agg(
        F.count("*").alias("n_docs"), F.sum("length").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("part").alias("checksum"),
    )


@dataclass(frozen=True)
class Position:
    """Where a reader of equal shards stands."""

    shard: int
    token: int
    epoch: int = 0

    def offset(self, shard_size: int, shards: int) -> int:
        return (self.epoch * shards + self.shard) * shard_size + self.token

    @classmethod
    def at(cls, offset: int, shard_size: int, shards: int) -> Position:
        rows, token = divmod(offset, shard_size)
        epoch, shard = divmod(rows, shards)
        return cls(shard, token, epoch)


def full_batches(total: int, batch: int, length: int, offset: int = 0) -> int:
    """Batches that a stream of `total` tokens fills from an offset on, before it starts over."""
    return max(0, total - offset) // (batch * (length + 1))


def batch_rows(placed: DataFrame, total: int, batch: int, length: int, batches: int, offset: int = 0, max_epochs: int | None = None) -> DataFrame:
    """Spans of `batches` batches of `batch` rows with length + 1 tokens, from a global offset on.

    The stream starts over at its end; `epoch` tells how often it has by each span. To read
    into an epoch that max_epochs leaves out is an error.
    """
    row, end = length + 1, offset + batches * batch * (length + 1)
    if total <= 0:
        raise ValueError("no tokens to batch")
    if max_epochs is not None and batches and (end - 1) // total >= max_epochs:
        raise ValueError(f"the batches reach epoch {(end - 1) // total} of {total} tokens; {max_epochs} are allowed")
    laps = F.sequence(F.lit(offset // total).cast("long"), F.lit((end - 1) // total).cast("long"))
    lapped = placed.withColumn("epoch", F.explode(laps)).withColumn("start", F.col("start") + F.col("epoch") * total)
    # Only what lies in [offset, end), counted from offset.
    first = F.greatest(F.col("start"), F.lit(offset))
    last = F.least(F.col("start") + F.col("n"), F.lit(end))
    inside = lapped.withColumns({"_cut": first - F.col("start"), "_first": first, "_last": last}).where("_last > _first")
    moved = inside.withColumns({"start": F.col("_first") - offset, "n": F.col("_last") - F.col("_first")})
    cut = spans(moved, row, "row_id").withColumn("begin", F.col("begin") + F.col("_cut")).drop("_cut", "_first", "_last")
    return cut.withColumns({"batch_id": F.expr(f"row_id div {int(batch)}"), "row": (F.col("row_id") % batch).cast("int")})


def score_windows(cut: DataFrame, size: int, context: int) -> DataFrame:
    """Shard spans cut again at a context's width; windows stay inside their shard and are full."""
    inner = cut.withColumns({"_base": F.col("begin"), "start": F.col("offset"), "n": F.col("length")}).drop("begin", "length", "offset")
    windows = spans(inner, context, "window_id").withColumn("begin", F.col("begin") + F.col("_base")).drop("_base")
    return windows.where(F.col("window_id") < size // context)


def shifted(ids: Column) -> tuple[Column, Column]:
    """(inputs, targets) of a row: all but its last id, all but its first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, 1, n), F.slice(ids, 2, n)


def sufficiency(unique: Column, steps: Column, batch: Column, accum: Column, length: Column, epochs: Column) -> dict[str, Column]:
    """What a run processes and really consumes, and whether the data lasts."""
    rows = steps * batch * accum
    return {"processed": rows * length, "consumed": rows * (length + 1), "enough": unique * epochs >= rows * length}


def check_sufficiency(unique: int, steps: int, batch: int, accum: int, length: int, epochs: int) -> None:
    need = steps * batch * accum * length
    if unique * epochs < need:
        raise ValueError(f"{need} tokens are needed; {unique} in {epochs} epochs give {unique * epochs}")
