"""Operator 10, quality rules: measures of a text and a short-circuit cascade, all in the JVM.

Each rule is a condition on a text's facts under which the text is rejected. A bounded sample
of the table, drawn by hash, tells what share each rule rejects and how long it takes, given
the facts that are there already when its turn comes; the cascade asks the rules in the order
of rejections per second, and a text that one rule rejects is not put to the next. The order
changes the work alone: a text is kept if no rule rejects it. A text is split into words once
for all of its measures and rules.

About `SAMPLE_ROWS` rows, of each its first `SAMPLE_CHARS` characters, serve for the order
only. Every verdict is on a whole text. Nothing but the sample is shuffled.

Defined results: a null or wordless text has zero for every measure and is rejected as too
short; a null doc_id stays null; rows that repeat have equal results; an empty table gives
none; other columns are ignored by `measure` and kept by `keep`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import storage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CAPITALS = r"\p{Lu}"

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Shares above which a text is rejected.
MOST_SYMBOLS = 0.1
MOST_CAPITALS = 0.4
MOST_DUP_LINES = 0.5
MOST_STUTTER = 0.3
MEAN_WORD = (2.0, 20.0)

SAMPLE_ROWS = 200
SAMPLE_CHARS = 20_000
#: Times that the sample is gone through for one timing.
SAMPLE_PASSES = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def matches(text: Column, pattern: str) -> Column:
    """Characters that a one-character pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def worded_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)).cast("long")


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words in n-word windows that the text has twice or more."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))

    def spread(s: Column) -> Column:
        """First words of the repeated windows, in order; s: (hash, place), sorted."""
        near = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        at = F.transform(s, lambda x, j: F.when(near(x, j - 1) | near(x, j + 1), x["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        each = F.transform(p, lambda i, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - i, F.lit(n))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(placed, lambda s: let(spread(s), total)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def stutter(words: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(F.transform(words, lambda w, i: F.coalesce(w == F.get(words, i - 1), F.lit(False))), lambda x: x)).cast("long")


def _over(part: Column, whole: Column, share: float) -> Column:
    return part > whole * F.lit(share)


@dataclass
class Facts:
    """What a rule may ask of a text; each is a column or the expression that makes it."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, text: Column, words: Column) -> Facts:
        return cls(text, words, **measures(text, words))

    @classmethod
    def known(cls, text: Column, words: Column, given: Column | None = None) -> Facts:
        """With measures that are fields of a struct, or columns."""
        return cls(text, words, **{n: F.col(n) if given is None else given[n] for n in MEASURES})


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(text: Column, words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"), "word_chars": word_chars(words), "n_symbols": matches(text, SYMBOLS),
        "n_dup_lines": dup_lines(text), "n_repeat_words": repeated_words(words),
    }


Rule = Callable[[Facts], Column]

#: Rejecting conditions by name.
RULES: dict[str, Rule] = {
    "few_words": lambda f: f.n_words < LEAST_WORDS,
    "repeated_words": lambda f: f.n_repeat_words * 100 > f.n_words * MOST_REPEATED_PERCENT,
    "symbols": lambda f: _over(f.n_symbols, f.n_words, MOST_SYMBOLS),
    "capitals": lambda f: _over(matches(f.text, CAPITALS), f.word_chars, MOST_CAPITALS),
    "dup_lines": lambda f: _over(f.n_dup_lines, worded_lines(f.text), MOST_DUP_LINES),
    "stutter": lambda f: _over(stutter(f.words), f.n_words, MOST_STUTTER),
    "word_length": lambda f: (f.word_chars < f.n_words * MEAN_WORD[0]) | (f.word_chars > f.n_words * MEAN_WORD[1]),
}
#: Rules that `measure` reports as base_failed.
BASE = ("few_words", "repeated_words")


def sampled(docs: DataFrame) -> DataFrame:
    """text, words and the measures of about SAMPLE_ROWS rows, drawn by hash from the whole table."""
    scale = 1_000_000
    share = min(scale, scale * SAMPLE_ROWS // max(1, docs.count()) + 1)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < share)
    text = F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS)
    staged = drawn.select(text.alias("text")).repartition(4).select("text", words_of(F.col("text")).alias("words"))
    return storage.written(staged.select("*", *[c.alias(n) for n, c in measures(F.col("text"), F.col("words")).items()]), "sample")


def estimate(docs: DataFrame, rules: dict[str, Rule], measured: bool) -> dict[str, tuple[float, float]]:
    """(seconds, share rejected) of each rule on a sample, as it runs in the cascade: on measures
    that are there already, or on words and text alone."""
    sample = sampled(docs)
    make = Facts.known if measured else Facts.of
    facts = make(F.col("text"), F.col("words"))
    many = sample.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_PASSES))))

    def run(condition: Column) -> tuple[float, float]:
        began = time.perf_counter()
        got = many.agg(F.avg(condition.cast("int")), F.max(F.size("words") + F.length("text"))).first()[0]
        return time.perf_counter() - began, got or 0.0

    run(F.length("text") < 0)
    idle = run(F.length("text") < 0)[0]
    out = {}
    for name, rule in rules.items():
        first, share = run(rule(facts))
        out[name] = max(first - idle, 1e-3), share
    storage.drop(sample)
    return out


def ordered(docs: DataFrame, rules: dict[str, Rule], measured: bool = False) -> list[str]:
    figures = estimate(docs, rules, measured)
    return sorted(rules, key=lambda name: -figures[name][1] / figures[name][0])


def rejected_by(facts: Facts, order: list[str], rules: dict[str, Rule]) -> Column:
    """The first rule of the order that rejects the text, else null; later ones are not asked."""
    out = None
    for name in order:
        fails = rules[name](facts)
        out = F.when(fails, F.lit(name)) if out is None else out.when(fails, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def verdict(text: Column, order: list[str], rules: dict[str, Rule]) -> Column:
    """rejected_by, of a text."""
    return let(words_of(text), lambda w: rejected_by(Facts.of(text, w), order, rules))


def keep(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects."""
    return docs.where(verdict(F.coalesce("text", F.lit("")), ordered(docs, rules), rules).isNull())


def measure(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row."""
    rest = {k: v for k, v in rules.items() if k not in BASE}
    order = ordered(docs, rest, measured=True)
    text = F.coalesce("text", F.lit(""))

    def judged(w: Column, m: Column) -> Column:
        facts = Facts.known(text, w, m)
        failed = F.lit(False)
        for name in BASE:
            failed = failed | RULES[name](facts)
        kept = let(failed, lambda x: F.struct(x.alias("failed"), F.when(x, False).otherwise(rejected_by(facts, order, rest).isNull()).alias("kept")))
        return F.struct(m.alias("m"), kept.alias("v"))

    whole = let(words_of(text), lambda w: let(F.struct(*[c.alias(n) for n, c in measures(text, w).items()]), lambda m: judged(w, m)))
    found = docs.select("doc_id", whole.alias("x"))
    return found.select("doc_id", *[f"x.m.{n}" for n in MEASURES], F.col("x.v.failed").alias("base_failed"), F.col("x.v.kept").alias("kept"))
