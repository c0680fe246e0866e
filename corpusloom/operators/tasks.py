"""Evaluation tasks as one table of requests, scored by a back-off table and given back in order.

`requests` is a polymorphic table function: from a task's rows and its kind it makes rows of
(task, item, nth, kind, context, continuation), item of the type that the task's key has, so
tasks of several kinds are one table. A kind that needs generation is refused by its name before
anything runs, as is a task that lacks a column of its kind.

`scored` reads each continuation character by character: the longest context, of up to REACH
characters before it, that the corpus has gives its probability, add-one smoothed over the
corpus's characters and one unseen. Characters meet contexts in one join, which is a broadcast
where the contexts are counted to be few; sums are by request, so a request of any length is
many tasks' work. Every request comes back, under its key, once.

Null texts are empty; an empty continuation has likelihood zero and is greedy; against an empty
corpus nothing is greedy and likelihoods are zero. Requests of equal keys are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from corpusloom.operators import generate
from corpusloom.sources import scratch

# The kinds of request, and the one that is not scored.
ROLLING, PAIR, CHOICES, UNTIL = "loglikelihood_rolling", "loglikelihood", "multiple_choice", "generate_until"
#: The columns that a task of each kind needs besides `item`.
NEEDS = {ROLLING: ["text"], PAIR: ["context", "continuation"], CHOICES: ["context", "choices"]}
KEY = ["task", "item", "nth"]


@udtf
class _Requests:
    @staticmethod
    def analyze(rows: AnalyzeArgument, task: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if kind.value == UNTIL:
            raise NotImplementedError(f"task {task.value}: {UNTIL} is not a scored request")
        if kind.value not in NEEDS:
            raise ValueError(f"task {task.value}: no requests of kind {kind.value}")
        held = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [name for name in ["item", *NEEDS[kind.value]] if name not in held]
        if missing:
            raise ValueError(f"task {task.value}: {kind.value} needs {', '.join(missing)}")
        out = StructType().add("task", StringType()).add("item", held["item"]).add("nth", IntegerType())
        return AnalyzeResult(schema=out.add("kind", StringType()).add("context", StringType()).add("continuation", StringType()))

    def eval(self, row, task, kind):
        if kind == ROLLING:
            yield task, row["item"], 0, ROLLING, "", row["text"] or ""
        elif kind == PAIR:
            yield task, row["item"], 0, PAIR, row["context"] or "", row["continuation"] or ""
        else:
            for nth, choice in enumerate(row["choices"] or []):
                yield task, row["item"], nth, PAIR, row["context"] or "", choice or ""


def requests(rows: DataFrame, task: str, kind: str) -> DataFrame:
    """(task, item, nth, kind, context, continuation): one for each of the rows, or for each of a row's choices."""
    needed = rows.select([c for c in ["item", *NEEDS.get(kind, [])] if c in rows.columns])
    return _Requests(needed.asTable(), F.lit(task), F.lit(kind))


def contexts(counts: DataFrame) -> DataFrame:
    """(context, total, top, counts): what follows a context, how often, and what most often; of equal ones the first character."""
    first = F.struct(-F.col("n"), F.col("next"))
    return counts.groupBy("context").agg(F.sum("n").alias("total"), F.min_by("next", first).alias("top"), F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("counts"))


def scored(asked: DataFrame, counts: DataFrame, reach: int = generate.REACH) -> DataFrame:
    """asked's keys and kind with (log_likelihood, is_greedy, n) by counts(context, next, n) of `generate.counted`."""
    asked = scratch.written(asked, "requests")
    known = scratch.written(contexts(counts), "contexts")
    if asked.groupBy(*KEY).count().where("count > 1").limit(1).count():
        raise ValueError("requests of equal keys")
    alphabet = known.where("context = ''").select(F.size("counts").alias("n")).first()
    characters = (alphabet["n"] if alphabet else 0) + 1
    head = asked.where("continuation <> ''").select(*KEY, F.expr(f"right(context, {reach})").alias("head"), "continuation")
    each = head.select(*KEY, "head", "continuation", F.explode(F.sequence(F.lit(1), F.length("continuation"))).alias("at"))
    # What stands before a character: at most `reach` of the context and of the continuation.
    own = F.expr(f"substring(continuation, greatest(1, at - {reach}), at - greatest(1, at - {reach}))")
    before = F.expr(f"right(concat(head, own), {reach})")
    each = each.withColumn("own", own).select(*KEY, "at", before.alias("before"), F.expr("substring(continuation, at, 1)").alias("next"))
    tried = each.select(*KEY, "at", "before", "next", F.explode(F.sequence(F.lit(0), F.length("before"))).alias("k"))
    tried = tried.select(*KEY, "at", "next", "k", F.expr("right(before, k)").alias("context"))
    met = tried.join(F.broadcast(known) if known.count() <= generate.SMALL_ROWS else known, "context")
    n = F.coalesce(F.try_element_at("counts", F.col("next")), F.lit(0))
    shares = met.select(*KEY, "at", "k", F.log((n + 1) / (F.col("total") + characters)).alias("lp"), (F.col("top") == F.col("next")).alias("hit"))
    best = shares.groupBy(*KEY, "at").agg(F.max_by(F.struct("lp", "hit"), "k").alias("best"))
    sums = best.groupBy(*KEY).agg(F.sum("best.lp").alias("lp"), F.bool_and("best.hit").alias("hit"))
    length = F.length("continuation").cast("long")
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in KEY], "lp", "hit")
    same = (F.col("task") == F.col("_task")) & F.col("item").eqNullSafe(F.col("_item")) & (F.col("nth") == F.col("_nth"))
    back = asked.join(sums, same, "left")
    return back.select(*KEY, "kind", F.coalesce("lp", F.lit(0.0)).alias("log_likelihood"), F.coalesce("hit", length == 0).alias("is_greedy"), length.alias("n"))
