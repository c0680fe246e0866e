"""Bounded training samples that do not depend on the order or partitioning of a table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) has this remainder modulo 4 are never learnt from.
HELD_OUT = 2


def held_out() -> F.Column:
    """Whether a row is held out; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT


def drawn(known: DataFrame, label: str, per_label: int, most_labels: int | None) -> DataFrame | None:
    """Of known(doc_id, label, ...), per_label rows of each label, those of least hash, none held
    out, as a table small enough for every executor; None if no row is labelled. Most_labels None
    takes every label. Columns that are no parameters of the draw break ties.

    The share of each label's rows that are drawn follows from a count of all rows, so that no
    task hands more than its share of them to the top-k.
    """
    known = known.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = known.groupBy(label).count().orderBy(F.desc("count"), label)
    counts = (counts if most_labels is None else counts.limit(most_labels)).collect()
    if not counts:
        return None
    # Half as many again as wanted are drawn by hash, so that chance leaves few too few.
    scale = 1_000_000
    draw = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    for row in counts:
        limit = scale if row["count"] <= per_label else min(scale, int(scale * 1.5 * per_label / row["count"]) + 1)
        draw = draw | (F.col(label) == F.lit(row[label])) & (place < limit)
    rest = [c for c in known.columns if c != "doc_id"]
    picked = known.where(draw).orderBy(F.xxhash64("doc_id"), "doc_id", *rest).limit(per_label * len(counts) * 2).collect()
    left, chosen = {row[label]: per_label for row in counts}, []
    for row in picked:
        if left[row[label]] > 0:
            left[row[label]] -= 1
            chosen.append(tuple(row))
    return known.sparkSession.createDataFrame(chosen, known.schema).distinct()


def training_table(docs: DataFrame, label: str, per_label: int) -> DataFrame | None:
    """The rows (doc_id, text, label) of per_label documents of each label; None if none is
    labelled. The driver receives ids and hashes alone, texts stay where they are."""
    digest = F.xxhash64("text").alias("digest")
    known = docs.where(F.col("text").isNotNull())
    wanted = drawn(known.select("doc_id", label, digest), label, per_label, None)
    return None if wanted is None else known.select("doc_id", "text", label, digest).join(F.broadcast(wanted), ["doc_id", label, "digest"], "left_semi").drop("digest")
