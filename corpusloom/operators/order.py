"""Prefix sums over an ordered table without a global single-task window.

The sums of the order values are written once, so that what a row's value is made of is read
for them once and once more where rows meet their position. Order values are cut into ranges
of about equal row counts; each range is summed locally and shifted by the totals of the
ranges before it, of which the driver holds one number per range (and source). Only the
order, the source and the value pass through the window; all other columns meet their
position in a hash join.

Rows that share an order value (and source) stand one behind the other, by a hash of the row;
equal rows can't be told apart, so it is all one which comes first. They pass through a
window of their own, a task for each such value, so more than TIED of them are refused.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources import scratch

#: Rows that may share an order value.
TIED = 100_000


def boundaries(df: DataFrame, order: str, ranges: int) -> list:
    """Order values at which ranges begin, after the first."""
    shares = [k / ranges for k in range(1, ranges)]
    if not shares:
        return []
    got = df.agg(F.percentile_approx(order, F.array(*map(F.lit, shares)), max(1000, 100 * ranges))).first()[0]
    return sorted(set(got or []))


def range_of(order: str, bounds: list) -> Column:
    """Number of bounds that are not above the order value, by binary search."""
    if not bounds:
        return F.lit(0)
    held, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    ahead = lambda at, step: (at + step <= n) & F.coalesce(F.get(held, at + step - 1) <= F.col(order), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))


#: Rows of (order, position) that may be sent to every executor: some tens of megabytes.
SMALL_ROWS = 1_000_000


def _digest(df: DataFrame) -> Column:
    """A hash of all columns that Spark can hash."""
    whole = [c.name for c in df.schema if not any(kind in c.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*[F.col("`" + name.replace("`", "``") + "`") for name in whole])


def place(df: DataFrame, value: str, order: str, source: str | None = None, ranges: int | None = None, ties: bool = True) -> tuple[DataFrame, dict]:
    """df with `start`, the sum of value over the rows before, in the order column's order.

    Also the total of each source (under None where there is no source column). A null order
    value comes first. Sources are those of a recipe, so they are few. Without ties, a repeated
    order value is an error.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(order).alias("_order"), F.col(value).alias("_value"), *([] if source is None else [F.col(source).alias("_source")]))
    names = ["_order"] if source is None else ["_order", "_source"]
    keys = scratch.written(keys.groupBy(*names).agg(F.sum("_value").cast("long").alias("_value"), F.count("*").alias("_rows")), "lengths")
    marked = keys.withColumn("_range", range_of("_order", boundaries(keys, "_order", ranges)))
    by = ["_range"] if source is None else ["_source", "_range"]
    sums: dict = {}
    rows = most = 0
    for row in marked.groupBy(*by).agg(F.sum("_value").alias("n"), F.sum("_rows").alias("rows"), F.max("_rows").alias("most")).collect():
        sums.setdefault(None if source is None else row["_source"], {})[row["_range"]] = row["n"] or 0
        rows, most = rows + row["rows"], max(most, row["most"])
    if most > (TIED if ties else 1):
        raise ValueError(f"{most} rows share a value of {order}; " + (f"at most {TIED} may" if ties else "here all have to differ"))
    local = F.coalesce(F.sum("_value").over(Window.partitionBy(*by).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.lit(0).cast("long")
    for name, parts in sums.items():
        sizes = [parts.get(k, 0) for k in range(max(parts) + 1)]
        own = F.get(F.array(*[F.lit(x).cast("long") for x in accumulate([0, *sizes[:-1]])]), F.col("_range"))
        shift = own if source is None else F.when(F.col("_source").eqNullSafe(F.lit(name)), own).otherwise(shift)
    placed = marked.withColumn("start", (local + shift).cast("long")).drop("_range", "_value")
    same = df[order].eqNullSafe(placed["_order"])
    if source is not None:
        same = same & df[source].eqNullSafe(placed["_source"])
    totals = {name: sum(parts.values()) for name, parts in sums.items()}
    met = df.join(F.broadcast(placed) if rows <= SMALL_ROWS else placed.hint("shuffle_hash"), same)
    if most <= 1:
        return met.drop("_rows", *names), totals
    alone, shared = met.where("_rows = 1").drop("_rows", *names), met.where("_rows > 1")
    behind = Window.partitionBy(*names).orderBy("_digest", value).rowsBetween(Window.unboundedPreceding, -1)
    inner = shared.withColumn("_digest", _digest(df)).withColumn("start", (F.col("start") + F.coalesce(F.sum(value).over(behind), F.lit(0))).cast("long"))
    return alone.unionByName(inner.drop("_rows", "_digest", *names)), totals
