"""Few-shot contexts: each item behind k solved examples drawn from a pool without replacement.

Draws are addressed, not listed: the pool's rows are numbered in order, and an item's j-th
example is the row whose number a keyed permutation gives for j. Exemplars meet their items in a
join by that number, so no pair is made that is not drawn, and the pool may be of any size.

The permutation of the n - 1 other rows is start + j * stride, modulo n - 1, with a start and a
stride of the item's own: strides are primes that don't divide n - 1, so k draws are k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import encode
from corpusloom.operators import chat, order

# Primes to stride by. Their product is beyond any 64-bit n - 1, so some are always left.
STRIDES = (1_000_003, 1_299_709, 2_750_159, 7_368_787, 15_485_863, 32_452_843, 49_979_687, 67_867_967)
#: What stands between examples.
GAP = "\n\n"


def start_key(number: Column, seed: int) -> Column:
    """A number's place to begin at, before the modulus."""
    return (number + 1) * F.lit(2_654_435_761) % F.lit(2_147_483_647) + F.lit(seed)


def drawn(numbered: DataFrame, total: int, k: int, seed: int = 0) -> DataFrame:
    """(number, nth, other): for each of numbered(number), k other numbers below total, or all there are."""
    rest, count = total - 1, min(k, total - 1)
    if count <= 0:
        return numbered.select("number", F.lit(0).alias("nth"), F.lit(0).cast("long").alias("other")).where("false")
    strides = [p for p in STRIDES if rest % p] or [1]
    stride = F.element_at(F.array(*[F.lit(p % rest if rest > 1 else 1).cast("long") for p in strides]), (F.col("number") % len(strides) + 1).cast("int"))
    offset = (start_key(F.col("number"), seed) % rest + F.col("nth") * stride) % rest
    each = numbered.select("number", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("nth"))
    return each.select("number", "nth", ((F.col("number") + 1 + offset) % total).alias("other"))


def contexts(items: DataFrame, k: int, seed: int = 0, order_column: str = "item_id") -> tuple[DataFrame, int]:
    """items(order, question, answer) with `number`, `shots` (numbers of the examples, in order) and
    `context`: the examples with their answers, then the question. Also the number of items."""
    placed, totals = order.place(items.withColumn("_one", F.lit(1).cast("long")), "_one", order_column)
    placed, total = placed.withColumnRenamed("start", "number").drop("_one"), totals.get(None, 0)
    solved = placed.select(F.col("number").alias("other"), F.concat_ws(" ", "question", "answer").alias("solved"))
    shots = drawn(placed.select("number"), total, k, seed).join(solved, "other")
    gathered = shots.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "solved"))).alias("shots"))
    joined = placed.join(gathered, "number", "left").withColumn("shots", F.coalesce("shots", F.array().cast(gathered.schema["shots"].dataType)))
    text = F.array_join(F.concat(F.col("shots.solved"), F.array("question")), GAP)
    return joined.withColumn("context", text).withColumn("shots", F.col("shots.other")), total


def requests(contexts: DataFrame, most: int, encoder: encode.Encoder = encode.code_points, order_column: str = "item_id") -> DataFrame:
    """(order, shots, context ids, continuation ids): contexts lose their beginning where both don't
    fit into `most` ids; the answer, behind a space, is always whole."""
    continuation = encoder(F.concat(F.lit(" "), F.col("answer")))
    ids = contexts.select(order_column, "shots", encoder(F.col("context")).alias("context"), continuation.alias("continuation"))
    return ids.withColumn("context", chat.left_truncated(F.col("context"), F.col("continuation"), most))
