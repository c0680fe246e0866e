"""Conversations as training examples: ids, and labels that mask all but the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import encode
from corpusloom.functions.numeric import IGNORED

# Fixed values, the chat template: what stands before and after a message of each role.
PREFIX = {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
SUFFIX = {"system": "\n", "user": "\n", "assistant": ""}
ANSWERS = "assistant"


def _by_role(texts: dict[str, str], role: Column) -> Column:
    """A role's text; an unknown role is an error."""
    out = F.when(F.lit(False), F.lit(""))
    for name, text in texts.items():
        out = out.when(role == name, F.lit(text))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))).cast("string"))


def message_parts(role: Column, text: Column, encoder: encode.Encoder = encode.code_points, end_id: int = encode.END_ID, prefix: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(ids, labels) of one message; prefix, text and suffix are encoded each for itself."""
    before, body, after = encoder(_by_role(prefix or PREFIX, role)), encoder(text), encoder(_by_role(SUFFIX, role))
    answer = role == ANSWERS
    masked = lambda ids: F.array_repeat(F.lit(IGNORED), F.size(ids))
    end = F.when(answer, F.array(F.lit(end_id))).otherwise(F.array().cast("array<int>"))
    ids = F.concat(before, body, after, end)
    labels = F.concat(masked(before), F.when(answer, body).otherwise(masked(body)), masked(after), end)
    return ids, labels


def render(turns: DataFrame, encoder: encode.Encoder = encode.code_points, end_id: int = encode.END_ID, prefix: dict[str, str] | None = None) -> DataFrame:
    """(conv_id, input_ids, labels) of turns(conv_id, turn, role, text); prefix: another template's openings by role."""
    ids, labels = message_parts(F.col("role"), F.col("text"), encoder, end_id, prefix)
    each = turns.select("conv_id", F.struct("turn", ids.alias("ids"), labels.alias("labels")).alias("m"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    joined = lambda part: F.flatten(F.transform("m", lambda m: m[part]))
    return whole.select("conv_id", joined("ids").alias("input_ids"), joined("labels").alias("labels"))


def fitting(examples: DataFrame, max_len: int) -> DataFrame:
    """Examples that are not too long; none is truncated."""
    return examples.where(F.size("input_ids") <= max_len)


def prompt_ids(prompt: Column, encoder: encode.Encoder = encode.code_points, system: Column | None = None) -> Column:
    """Ids that ask for an answer: an optional system turn, the user's, the answer's opening."""
    user = message_parts(F.lit("user"), prompt, encoder)[0]
    parts = [user, encoder(F.lit(PREFIX[ANSWERS]))]
    if system is not None:
        parts.insert(0, F.when(system.isNotNull(), message_parts(F.lit("system"), system, encoder)[0]).otherwise(F.array().cast("array<int>")))
    return F.concat(*parts)


def batches(examples: DataFrame, size: int, ranges: int | None = None) -> DataFrame:
    """Full batches of consecutive examples: adds batch_id and row; the last short one goes."""
    from corpusloom.operators import order

    placed, totals = order.place(examples.withColumn("n", F.lit(1).cast("long")), "n", "conv_id", ranges=ranges)
    full = totals.get(None, 0) // size * size
    kept = placed.where(F.col("start") < full)
    return kept.withColumns({"batch_id": F.expr(f"start div {int(size)}"), "row": (F.col("start") % size).cast("int")}).drop("start", "n")


def padded(batched: DataFrame, pad_id: int = 0) -> DataFrame:
    """ids and labels filled up to their batch's longest example."""
    most = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    fill = lambda c, x: F.concat(F.col(c), F.array_repeat(F.lit(x), F.col("_most") - F.size(c)))
    return batched.withColumn("_most", most).withColumns({"input_ids": fill("input_ids", pad_id), "labels": fill("labels", IGNORED)}).drop("_most")


def unmasked(examples: DataFrame) -> DataFrame:
    """(conv_id, position, id, label) of the positions that are learnt from."""
    pair = F.arrays_zip(F.col("input_ids").alias("id"), F.col("labels").alias("label"))
    each = examples.select("conv_id", F.posexplode(pair).alias("position", "p"))
    return each.where(F.col("p.label") != IGNORED).select("conv_id", "position", F.col("p.id").alias("id"), F.col("p.label").alias("label"))


def left_truncated(context: Column, continuation: Column, most: int) -> Column:
    """The context's last ids that fit before the whole continuation."""
    keep = F.greatest(F.lit(0), F.least(F.size(context), F.lit(most) - F.size(continuation)))
    return F.slice(context, F.size(context) - keep + 1, keep)


def request_batches(requests: DataFrame, most: int, size: int, pad_id: int = 0) -> DataFrame:
    """requests(request, context, continuation) as rows of full model batches, the last one short.

    Adds batch_id, row, `ids` (the context's end, the continuation, then padding to the batch's
    longest), `length` without padding and `scored_from`, the first scored position. A
    continuation that leaves no room for one id of context before it is an error.
    """
    from corpusloom.operators import order

    room = F.size("continuation") < most
    kept = F.when(room & (F.size("context") > 0), left_truncated(F.col("context"), F.col("continuation"), most))
    kept = F.coalesce(kept, F.raise_error(F.lit("a request needs an id of context before its continuation")).cast("array<int>"))
    rows = requests.withColumn("_kept", kept).select("request", F.concat("_kept", "continuation").alias("ids"), F.size("_kept").alias("scored_from"), F.lit(1).cast("long").alias("n"))
    placed, _ = order.place(rows, "n", "request")
    numbered = placed.select("request", F.expr(f"start div {int(size)}").alias("batch_id"), (F.col("start") % size).cast("int").alias("row"), "ids", F.size("ids").alias("length"), "scored_from")
    longest = F.max("length").over(Window.partitionBy("batch_id"))
    return numbered.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), longest - F.col("length"))))


def last_ids(ids: Column, most: int) -> Column:
    keep = F.least(F.size(ids), F.lit(most))
    return F.slice(ids, F.size(ids) - keep + 1, keep)
