"""Scores of requests, accuracies, and comparisons of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import numeric

# The metric that counts for each task.
HEADLINE = {"hellaswag": "acc_norm", "arc_easy": "acc_norm", "lambada_openai": "acc", "winogrande": "acc"}


def score_requests(positions: DataFrame, context: int) -> DataFrame:
    """(request, log_likelihood, is_greedy, n) of positions(request, at, logits, target).

    Positions below `context` are the context and are not scored.
    """
    logits = numeric.doubles(F.col("logits"))
    scored = positions.where(F.col("at") >= context)
    each = scored.select("request", (-numeric.nll(logits, F.col("target"))).alias("lp"), (numeric.greedy(logits) == F.col("target")).alias("hit"))
    return each.groupBy("request").agg(F.sum("lp").alias("log_likelihood"), F.bool_and("hit").alias("is_greedy"), F.count("*").alias("n"))


def choice_accuracy(choices: DataFrame) -> DataFrame:
    """(acc, acc_norm, items) of choices(item, choice, ll, length, gold); of equal scores the first choice counts.

    A choice without length counts as one of length 1.
    """
    best = lambda score: F.max_by("choice", F.struct(score, -F.col("choice")))
    items = choices.groupBy("item").agg(best(F.col("ll")).alias("raw"), best(F.col("ll") / F.greatest("length", F.lit(1))).alias("normed"), F.max("gold").alias("gold"))
    hit = lambda c: F.avg((F.col(c) == F.col("gold")).cast("double"))
    return items.agg(hit("raw").alias("acc"), hit("normed").alias("acc_norm"), F.count("*").alias("items"))


def standard_error(share: Column, n: Column) -> Column:
    """Of a mean of n zeros and ones."""
    return F.sqrt(share * (1 - share) / (n - 1))


def headline(results: DataFrame, metrics: dict[str, str] | None = None) -> DataFrame:
    """(run, headline) of results(run, task, metric, value)."""
    counts = F.lit(False)
    for task, metric in (metrics or HEADLINE).items():
        counts = counts | ((F.col("task") == task) & (F.col("metric") == metric))
    return results.where(counts).groupBy("run").agg(F.avg("value").alias("headline"))


def deltas(results: DataFrame, run: str, baseline: str) -> DataFrame:
    """(task, metric, delta, sigma_one, sigma_two) of one run against another."""
    side = lambda name, x: results.where(F.col("run") == name).select("task", "metric", F.col("value").alias(f"v{x}"), F.col("stderr").alias(f"s{x}"))
    both = side(run, 1).join(side(baseline, 2), ["task", "metric"])
    delta = F.col("v1") - F.col("v2")
    return both.select("task", "metric", delta.alias("delta"), (delta / F.col("s1")).alias("sigma_one"), (delta / F.sqrt(F.col("s1") ** 2 + F.col("s2") ** 2)).alias("sigma_two"))


def factorial(values: DataFrame, rows: str, columns: str, value: str, row_pair: tuple[str, str], column_pair: tuple[str, str]) -> DataFrame:
    """Effects of a two-by-two design: what each factor changes, and their interaction."""
    (r0, r1), (c0, c1) = row_pair, column_pair
    wide = values.groupBy(rows).pivot(columns, [c0, c1]).agg(F.first(value))
    at = lambda r, c: F.max(F.when(F.col(rows) == r, F.col(c)))
    cells = wide.agg(at(r0, c0).alias("a"), at(r0, c1).alias("b"), at(r1, c0).alias("c"), at(r1, c1).alias("d"))
    return cells.selectExpr("(c + d - a - b) / 2 as row_effect", "(b + d - a - c) / 2 as column_effect", "d - c - b + a as interaction")


def trajectory(points: DataFrame) -> DataFrame:
    """points(metric, step, value) with each metric's change since the step before."""
    w = Window.partitionBy("metric").orderBy("step")
    return points.withColumn("change", F.col("value") - F.lag("value").over(w))


def flattened(results: DataFrame) -> DataFrame:
    """(run, task, metric, value, stderr) of results(run, json): maps of tasks to named metrics."""
    tasks = F.from_json(F.get_json_object("json", "$.results"), "map<string,map<string,string>>")
    per_task = results.select("run", F.explode(tasks).alias("task", "metrics"))
    each = per_task.select("run", "task", "metrics", F.explode("metrics").alias("key", "raw"))
    named = each.where(F.col("key").endswith(",none") & ~F.col("key").contains("_stderr"))
    metric = F.split_part("key", F.lit(","), F.lit(1))
    error = F.try_element_at("metrics", F.concat(metric, F.lit("_stderr,none"))).try_cast("double")
    return named.select("run", "task", metric.alias("metric"), F.col("raw").try_cast("double").alias("value"), error.alias("stderr"))


def chosen_metric(results: DataFrame) -> DataFrame:
    """(run, task, value): the first there is of acc, acc_norm; zero is a value."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return results.groupBy("run", "task").agg(F.coalesce(pick("acc"), pick("acc_norm")).alias("value"))


def throughput(log: DataFrame) -> DataFrame:
    """log(run, step, tokens, at): tokens a second since the run's entry before."""
    before = F.lag("at").over(Window.partitionBy("run").orderBy("step"))
    seconds = F.unix_micros("at") - F.unix_micros(before)
    return log.withColumn("tokens_per_sec", F.when(seconds > 0, F.col("tokens") * 1e6 / seconds))


Loss = Callable[[Column, Column], Column]


def mean_loss(rows: DataFrame, by: list[str], loss: Loss = numeric.nll) -> DataFrame:
    """(by, loss): the mean over positions that are not ignored of rows(logits, target); any loss of
    (logits, target) that is null where it does not count may take the default's place."""
    each = rows.withColumn("_loss", loss(numeric.doubles(F.col("logits")), F.col("target")))
    mean = numeric.token_mean(F.col("_loss"), F.col("target")).alias("loss")
    return each.groupBy(*by).agg(mean) if by else each.agg(mean)


def micro_mean(losses: DataFrame) -> DataFrame:
    """(step, loss): mean over a step's accumulated micro-batches, losses(step, loss)."""
    return losses.groupBy("step").agg(F.avg("loss").alias("loss"))


def report(samples: DataFrame, title: str, by: str) -> DataFrame:
    """(by, markdown): a document per value of `by`, a quoted section per sample(ord, prompt, response)."""
    section = F.concat(F.lit("### "), F.col("prompt"), F.lit("\n\n> "), F.replace("response", F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("ord", section.alias("s"))))
    text = F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(parts, lambda x: x["s"]), "\n"))
    return samples.groupBy(by).agg(text.alias("markdown"))


def superseded(files: DataFrame, keep: int) -> DataFrame:
    """Numbered step files of files(run, name) behind the latest `keep` of their run; none if keep is not positive."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("name")))
    numbered = files.where(F.col("name").rlike(r"^step_.*\.pt$"))
    return numbered.withColumn("rank", rank).where((F.col("rank") > keep) & F.lit(keep > 0)).drop("rank")


def without_prefix(state: Column, prefix: str = "_orig_mod.") -> Column:
    """A map's keys without the prefix."""
    return F.transform_keys(state, lambda k, _: F.when(k.startswith(prefix), F.substr(k, F.lit(len(prefix) + 1))).otherwise(k))
