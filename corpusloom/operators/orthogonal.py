"""Orthogonalised updates of matrices that are stored as rows, by Newton-Schulz on their Gram matrix.

A matrix is (name, at, row): any number of rows, each a vector of the narrow width. Every step of
the iteration multiplies the matrix from the right by a polynomial of its own Gram matrix, and
all of these commute. So the rows are read once for the Gram matrix, a sum over rows of a fixed
size; the steps work on that; and a second pass multiplies each row by the product of all
polynomials. Neither the driver nor a task holds more than some width-by-width matrices of one
name, whatever the number of rows. Which side is the longer makes no difference to the result.

The Gram matrix is summed in each task, by name, and the tasks' sums are added slice by slice,
so a name that holds most rows is shared by all tasks. `width` is bounded by WIDEST, checked.
Rows that are null or of another width than the first are an error; a matrix of zeros stays zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import numeric
from corpusloom.sources import scratch

# The coefficients of a step, and what keeps a matrix of zeros from dividing by zero.
FIRST, THIRD, FIFTH, TINY = 3.4445, -4.7750, 2.0315, 1e-7
STEPS = 5
#: Columns that a matrix may have: a Gram matrix is at most 32 MB.
WIDEST = 2048
#: Gram matrices that a task keeps before it hands them on.
KEPT_BYTES = 64 << 20


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    held = batch.column("row")
    if held.null_count or held.flatten().null_count or len(held.flatten()) != len(held) * width:
        raise ValueError(f"a row is not {width} numbers")
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), width)


def gram(matrices: DataFrame, width: int) -> DataFrame:
    """(name, i, n, line): line i of each matrix's Gram matrix, and the number of its rows."""
    if not 0 < width <= WIDEST:
        raise ValueError(f"a width of {width}; it may be 1 to {WIDEST}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (n, total) in sums.items():
                lines = pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * width), pa.array(total.ravel()))
                counts = np.zeros(width, dtype=np.int64)
                counts[0] = n
                yield pa.RecordBatch.from_arrays([pa.array([name] * width, pa.string()), pa.array(np.arange(width, dtype=np.int32)), pa.array(counts), lines], ["name", "i", "n", "line"])
            sums.clear()

        for batch in batches:
            if not len(batch):
                continue
            rows, names = _rows(batch, width), batch.column("name").dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(names.dictionary.to_pylist()):
                own = rows[codes == code]
                kept = sums.setdefault(name, [0, np.zeros((width, width))])
                kept[0] += len(own)
                kept[1] += own.T @ own
                if len(sums) * width * width * 8 > KEPT_BYTES:
                    yield from out()
        yield from out()

    typed = matrices.where("name is not null").select(F.col("name").cast("string").alias("name"), numeric.doubles(F.col("row")).alias("row"))
    parts = typed.mapInArrow(run, "name string, i int, n long, line array<double>")
    cells = parts.select("name", "i", "n", F.posexplode("line").alias("j", "x"))
    sums = cells.groupBy("name", "i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.groupBy("name", "i").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("line"))


def factor(square: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """What a matrix of this Gram matrix is multiplied by from the right."""
    norm = np.sqrt(np.trace(square)) + TINY
    held, product = square / norm**2, np.eye(len(square)) / norm
    for _ in range(steps):
        step = FIRST * np.eye(len(square)) + THIRD * held + FIFTH * held @ held
        held, product = step @ held @ step, product @ step
    return product


def factors(matrices: DataFrame, width: int, steps: int = STEPS) -> DataFrame:
    """(name, rows, factor): the factor's lines, one behind the other; a name is one task's, of a fixed size."""

    def run(lines: pa.Table) -> pa.Table:
        lines = lines.sort_by("i")
        square = lines["line"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(width, width)
        return pa.table({"name": lines["name"].slice(0, 1), "rows": [lines["n"][0].as_py()], "factor": pa.array([factor(square, steps).ravel()], pa.list_(pa.float64()))})

    return gram(matrices, width).groupBy("name").applyInArrow(run, "name string, rows long, factor array<double>")


#: Bytes of factors that may go to every executor.
SMALL_BYTES = 64 << 20


def newton_schulz(matrices: DataFrame, width: int, steps: int = STEPS) -> DataFrame:
    """(name, at, row) with rows of which the matrix's singular values lie near 1, and `rows`, their number."""
    known = scratch.written(factors(matrices, width, steps), "factors")
    held = matrices.where("name is not null").select(F.col("name").cast("string").alias("name"), "at", numeric.doubles(F.col("row")).alias("row"))
    met = held.join(F.broadcast(known) if known.count() * width * width * 8 <= SMALL_BYTES else known, "name")
    # The factor is symmetric, so column j is its j-th line.
    line = lambda j: F.slice("factor", j * width + 1, width)
    dot = lambda j: numeric.total(F.zip_with("row", line(j), lambda a, b: a * b))
    return met.select("name", "at", "rows", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), dot).alias("row"))


def muon_step(parameters: DataFrame, gradients: DataFrame, width: int, rate: float, momentum: float = 0.95, steps: int = STEPS) -> DataFrame:
    """(name, at, row, buffer) after a step, of parameters(name, at, row, buffer) and gradients(name, at, row).

    The buffer, null before the first step, gathers the gradients; the update looks a step
    ahead, is orthogonalised, and grows with the root of the matrix's longer over its shorter
    side. Rows without a gradient are given back as they are.
    """
    times = lambda x, c: F.transform(x, lambda v: v * c)
    plus = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    given = gradients.select("name", "at", numeric.doubles(F.col("row")).alias("_g"))
    met = parameters.select("name", "at", numeric.doubles(F.col("row")).alias("row"), numeric.doubles(F.col("buffer")).alias("buffer")).join(given, ["name", "at"], "left")
    gathered = F.when(F.col("buffer").isNull(), F.col("_g")).otherwise(plus(times("buffer", momentum), F.col("_g")))
    held = scratch.written(met.withColumn("buffer", F.when(F.col("_g").isNull(), F.col("buffer")).otherwise(gathered)), "buffers")
    ahead = held.where("_g is not null").select("name", "at", plus(times("buffer", momentum), F.col("_g")).alias("row"))
    update = newton_schulz(ahead, width, steps).select("name", "at", F.col("row").alias("_u"), "rows")
    longer = F.sqrt(F.greatest("rows", F.lit(width)) / F.least("rows", F.lit(width)))
    moved = F.zip_with("row", "_u", lambda p, u: p - u * longer * rate)
    return held.join(update, ["name", "at"], "left").select("name", "at", F.when(F.col("_u").isNull(), F.col("row")).otherwise(moved).alias("row"), "buffer")
