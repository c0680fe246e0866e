"""Generation in lock-step from a back-off table of code points counted in a corpus.

The table has a row for each context of up to REACH characters that occurs: what followed it most
often (`top_k`), cut to a nucleus (`top_p`), with running counts. A prompt's next character
comes from the longest of its last contexts that the table has; by temperature zero the most
frequent, else where a supplied draw falls among the counts. Each round adds one character to
every prompt that is still open; those that draw the end stop before it, and all do after
`max_new_tokens`. So the open rows only get fewer, and a round is one join of their last
characters with the table, which goes to every executor where its rows are counted to be few.

Counts are whole numbers and ties go by the character, so results are the same everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import encode
from corpusloom.sources import scratch

REACH = 3
#: Rounds that run as one job.
ROUNDS = 4
#: Table rows that may go to every executor, some hundred bytes each.
SMALL_ROWS = 500_000
#: What stands for the end of a text.
END = ""


#: Bytes of texts that are counted at once; one longer text is alone.
AT_ONCE = 1 << 22


def _tally(texts: pa.Array, reach: int) -> pa.RecordBatch:
    """(context, next, n) of some texts: a place is a number whose digits are the characters before it and its own."""
    held = [t or "" for t in texts.to_pylist()]
    sizes = np.array([len(t) for t in held])
    # Behind `reach` places that stand for nothing, each text's characters and its end, which is none either.
    begin = np.cumsum(sizes + reach + 1) - (sizes + reach + 1)
    flat = np.zeros(int((sizes + reach + 1).sum()), np.uint32)
    inside = np.ones(len(flat), bool)
    inside[(begin[:, None] + np.arange(reach)).ravel()] = False
    ends = begin + sizes + reach
    real = inside.copy()
    real[ends] = False
    flat[real] = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32) + 1
    used = np.flatnonzero(np.bincount(flat, minlength=1))
    number = np.zeros(int(used[-1]) + 1, np.int64)
    number[used] = np.arange(len(used))
    digits, places = number[flat], np.flatnonzero(inside)
    windows = [digits[places - back] for back in range(reach, -1, -1)]
    if len(used) ** (reach + 1) < 1 << 62:
        key = windows[0]
        for w in windows[1:]:
            key = key * len(used) + w
        key, n = np.unique(key, return_counts=True)
        found = [key // len(used) ** back % len(used) for back in range(reach, -1, -1)]
    else:
        rows, n = np.unique(np.stack(windows, axis=1), axis=0, return_counts=True)
        found = list(rows.T)
    names = np.array([chr(c - 1) if c else END for c in used.tolist()], dtype=object)
    context = np.full(len(n), "", dtype=object)
    for digit in found[:-1]:
        context = context + names[digit]
    return pa.RecordBatch.from_arrays([pa.array(context, pa.string()), pa.array(names[found[-1]], pa.string()), pa.array(n.astype(np.int64))], ["context", "next", "n"])


def _tallied(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for part in encode.slices(texts, AT_ONCE):
                yield _tally(texts.slice(part.start, part.stop - part.start), reach)

    return run


def counted(docs: DataFrame, reach: int = REACH, text: str = "text") -> DataFrame:
    """(context, next, n): how often each character, or the end, follows each context of 0 to reach."""
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_tallied(reach), "context string, next string, n long")
    longest = parts.groupBy("context", "next").agg(F.sum("n").alias("n"))
    # Shorter contexts are sums over the longest ones, of which there are few.
    each = F.explode(F.sequence(F.lit(0), F.length("context")))
    return longest.select("context", "next", "n", each.alias("k")).select(F.expr("right(context, k)").alias("context"), "next", "n").groupBy("context", "next").agg(F.sum("n").alias("n"))


def table(counts: DataFrame, top_k: int = 40, top_p: tuple[int, int] = (9, 10)) -> DataFrame:
    """(context, choices: array of (next, upto), whole): a context's choices with the counts up to and with each.

    A choice stays while the share of those before it is at most top_p, a fraction.
    """
    from pyspark.sql.window import Window

    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("n"), "next"))).where(F.col("place") <= top_k)
    gathered = ranked.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("place", "next", "n"))).alias("c"), F.sum("n").alias("total"))
    sums = F.transform("c", lambda x: F.struct(x["next"].alias("next"), x["n"].alias("n"), F.aggregate(F.filter("c", lambda y: y["place"] <= x["place"]), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")))
    kept = F.filter("sums", lambda x: (x["upto"] - x["n"]) * top_p[1] <= F.col("total") * top_p[0])
    short = F.transform(kept, lambda x: F.struct(x["next"].alias("next"), x["upto"].alias("upto")))
    return gathered.withColumn("sums", sums).select("context", short.alias("choices")).withColumn("whole", F.element_at("choices", -1)["upto"])


#: A modulus and the multipliers of a linear generator.
MODULUS, BY_KEY, BY_STEP, MULTIPLIER = 2_147_483_647, 1_000_003, 7_919, 48_271


def draw(key: Column, step: Column, whole: Column, seed: int = 0) -> Column:
    """A number below whole, by key (to 9 * 10**12) and step; no product leaves 64 bits."""
    by = F.lit(MODULUS).cast("long")
    div = lambda a: F.call_function("div", a, by)
    drawn = (key * BY_KEY + step * BY_STEP + seed) % by * MULTIPLIER % by
    return drawn * div(whole) + div(drawn * (whole % by))


def generate(prompts: DataFrame, choices: DataFrame, max_new_tokens: int, temperature: float = 1.0, seed: int = 0, reach: int = REACH) -> DataFrame:
    """(key, prompt, new, n, ended) of prompts(key, prompt); keys are distinct whole numbers."""
    known = scratch.written(choices, "choices")
    small = known.count() <= SMALL_ROWS
    tables = []
    for k in range(reach + 1):
        part = known.where(F.length("context") == k).select(F.col("context").alias(f"context{k}"), F.struct("choices", "whole").alias(f"found{k}"))
        tables.append(F.broadcast(part) if small else part)
    active = prompts.select("key", "prompt", F.expr(f"right(coalesce(prompt, ''), {reach})").alias("last"), F.lit("").alias("new"), F.lit(0).alias("n"), F.lit(False).alias("ended"))
    done: list[DataFrame] = []
    for step in range(max_new_tokens):
        for k in range(reach + 1):
            active = active.withColumn(f"context{k}", F.when(F.length("last") >= k, F.expr(f"right(last, {k})"))).join(tables[k], f"context{k}", "left")
        found = F.coalesce(*[F.col(f"found{k}") for k in range(reach, -1, -1)])
        least = F.lit(0).cast("long") if temperature == 0 else draw(F.col("key"), F.lit(step), found["whole"], seed)
        pick = F.coalesce(F.get(F.filter(found["choices"], lambda c: c["upto"] > least), F.lit(0))["next"], F.lit(END))
        # A prompt that has ended goes through the rest of its job unchanged.
        rows = active.select("key", "prompt", "last", "new", "n", "ended", F.when(F.col("ended"), F.lit(END)).otherwise(pick).alias("pick"))
        active = rows.select("key", "prompt", F.expr(f"right(concat(last, pick), {reach})").alias("last"), F.concat("new", "pick").alias("new"), (F.col("n") + (F.col("pick") != END).cast("int")).alias("n"), (F.col("pick") == END).alias("ended"))
        if step % ROUNDS == ROUNDS - 1 or step == max_new_tokens - 1:
            active = scratch.written(active, "round")
            done.append(active.where("ended"))
            active = active.where("not ended")
            if active.isEmpty():
                break
    out = active
    for df in done:
        out = out.unionByName(df)
    return out.select("key", "prompt", "new", "n", "ended")
