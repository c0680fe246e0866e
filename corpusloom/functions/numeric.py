"""Reductions over arrays of logits, in the JVM: one row is one position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once and not again for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(values: Column) -> Column:
    """Shifted by the maximum, so that no term overflows."""
    return let(F.array_max(values), lambda top: top + F.log(total(F.transform(values, lambda x: F.exp(x - top)))))


def log_softmax(values: Column) -> Column:
    return let(log_sum_exp(values), lambda norm: F.transform(values, lambda x: x - norm))


def softmax(values: Column) -> Column:
    return F.transform(log_softmax(values), lambda x: F.exp(x))


def nll(logits: Column, target: Column) -> Column:
    """Negative log-likelihood of the target; null where it is ignored."""
    return F.when(target != IGNORED, log_sum_exp(logits) - F.get(logits, target))


def token_mean(losses: Column, target: Column) -> Column:
    """Mean over positions that are not ignored, zero if all are."""
    kept = F.count(F.when(target != IGNORED, 1))
    return F.coalesce(F.sum(losses), F.lit(0.0)) / F.greatest(F.lit(1), kept)


def perplexity(nll_sum: Column, count: Column) -> Column:
    none = F.raise_error(F.lit("perplexity needs a token")).cast("double")
    return F.when(count > 0, F.exp(nll_sum / count)).otherwise(none)


def top_k(logits: Column, k: int) -> Column:
    """(val, idx) of the k largest, descending; of equal ones the lower index first."""
    marked = F.transform(logits, lambda v, i: F.struct(v.alias("val"), (-i).alias("back")))
    best = F.slice(F.sort_array(marked, asc=False), 1, k)
    return F.transform(best, lambda s: F.struct(s["val"].alias("val"), (-s["back"]).alias("idx")))


def top_k_divergence(student: Column, teacher: Column, temperature: float) -> Column:
    """KL of the teacher's top entries from the student's same entries, both renormalised."""
    t = log_softmax(F.transform(teacher, lambda s: s["val"] / temperature))
    s = let(F.transform(teacher, lambda e: F.get(student, e["idx"]) / temperature), log_softmax)
    return total(F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b)))


def greedy(logits: Column) -> Column:
    """Index of the largest; of equal ones the first."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def nucleus(logits: Column, top_p: float) -> Column:
    """(idx, p) of the tokens before which top_p or less is gathered, renormalised.

    One pass over the sorted probabilities counts the tokens that stay; then they are cut off.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("before"))
    probs = F.transform(softmax(logits), lambda p, i: F.struct(p.alias("p"), (-i).alias("back")))

    def step(acc: Column, s: Column) -> Column:
        return F.struct((acc["n"] + (acc["before"] <= top_p).cast("int")).alias("n"), (acc["before"] + s["p"]).alias("before"))

    def cut(best: Column) -> Column:
        return F.slice(best, F.lit(1), F.aggregate(best, start, step)["n"])

    def renormalised(kept: Column) -> Column:
        mass = total(F.transform(kept, lambda s: s["p"]))
        return let(mass, lambda m: F.transform(kept, lambda s: F.struct((-s["back"]).cast("int").alias("idx"), (s["p"] / m).alias("p"))))

    return let(let(F.sort_array(probs, asc=False), cut), renormalised)


def inverse_cdf(probs: Column, uniform: Column) -> Column:
    """Index of the first entry at which the cumulated probability exceeds uniform."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("i"), F.lit(0.0).alias("sum"))

    def step(acc: Column, p: Column) -> Column:
        here = (acc["at"] < 0) & (acc["sum"] + p > uniform)
        return F.struct(F.when(here, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"), (acc["sum"] + p).alias("sum"))

    last = F.size(probs) - 1
    return F.aggregate(probs, start, step, lambda a: F.when(a["at"] < 0, last).otherwise(a["at"]))


def rms_norm(values: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(total(F.transform(values, lambda x: x * x)) / F.size(values) + eps)
    return let(scale, lambda s: F.transform(values, lambda x: x / s))
