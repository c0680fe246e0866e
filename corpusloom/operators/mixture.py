"""Several sources drawn into one stream at target token shares."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import order, shards
from corpusloom.sources import scratch

# Text columns in the order in which they are tried.
TEXT_COLUMNS = ("text", "content", "code", "raw_content")


@dataclass(frozen=True)
class Entry:
    """A source's place in a recipe."""

    name: str
    weight: float
    skip: int = 0


# Published mixes (shares of tokens; the web slice of each skips what an earlier run read).
RECIPES = {
    "e2": [Entry("fineweb_edu", 0.55, 8_000_000_000), Entry("web", 0.20), Entry("code", 0.15), Entry("math", 0.10)],
    "e3": [Entry("fineweb_edu", 0.45, 8_000_000_000), Entry("web", 0.20), Entry("code", 0.10), Entry("math", 0.10), Entry("distill", 0.15)],
}


def text_of(columns: list[str], preferred: str | None = None) -> Column:
    """The first text column of a row that is not empty, else null."""
    names = ([preferred] if preferred else []) + [c for c in TEXT_COLUMNS if c != preferred]
    found = [F.nullif(F.col(c), F.lit("")) for c in names if c in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def probe(docs: DataFrame, source: str, order_column: str) -> DataFrame:
    """(source, first, ok): whether each source begins with a text that is not empty."""
    first = F.min_by(F.coalesce("text", F.lit("")), order_column).alias("first")
    return docs.groupBy(source).agg(first).withColumn("ok", F.length("first") > 0)


def normalised(recipe: list[Entry]) -> list[Entry]:
    whole = sum(e.weight for e in recipe)
    return [Entry(e.name, e.weight / whole, e.skip) for e in recipe]


class Mixer:
    """Draws from several queues so that each source stays close to its share of the tokens.

    A source's credit is its share of all tokens drawn, less its own. The source with most
    credit is next, the first of equals; one that has handed over all its documents is out, and
    the shares stay as they are. Documents may be offered long before or just when they
    are due: drawing stops where the next one has not been offered yet.
    """

    def __init__(self, weights: list[float], documents: list[int], most: int | None = None):
        self.sources = [(k, w, deque()) for k, w in enumerate(weights)]
        self.open, self.own = list(documents), [0] * len(weights)
        self.drawn, self.rank, self.most = 0, 0, most

    def offer(self, source: int, document: int, n: int) -> None:
        self.sources[source][2].append((document, n))

    @property
    def held(self) -> int:
        """Documents that are offered and not drawn yet."""
        return sum(len(queue) for _, _, queue in self.sources)

    def draws(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(source, document, rank, tokens before, tokens) as far as the offered documents go."""
        while self.most is None or self.drawn < self.most:
            best, credit = None, 0.0
            for k, weight, queue in self.sources:
                mine = weight * self.drawn - self.own[k]
                if self.open[k] and (best is None or mine > credit):
                    best, credit, waiting = k, mine, queue
            if best is None or not waiting:
                return
            document, n = waiting.popleft()
            yield best, document, self.rank, self.drawn, n
            self.open[best] -= 1
            self.own[best] += n
            self.drawn += n
            self.rank += 1


def draw_times(weights: list[float], totals: list[int]) -> list[list[tuple[float, float, float]]]:
    """For each source (own tokens, all tokens, own per token of all), from where on this share holds.

    What the rule does if documents are cut as fine as one likes: credits of the sources that are
    left stay equal, so the share of one that has run out falls to them in equal parts.
    """
    own, drawn = [0.0] * len(weights), 0.0
    left = [k for k, n in enumerate(totals) if n > 0]
    out: list[list[tuple[float, float, float]]] = [[] for _ in weights]
    while left:
        spare = (1 - sum(weights[k] for k in left)) / len(left)
        # A source without weight is drawn when no other is left.
        rate = {k: max(weights[k] + spare, 1e-12) for k in left}
        for k in left:
            out[k].append((own[k], drawn, rate[k]))
        first = min(left, key=lambda k: (totals[k] - own[k]) / rate[k])
        step = (totals[first] - own[first]) / rate[first]
        drawn += step
        for k in left:
            own[k] += step * rate[k]
        left.remove(first)
    return out


def ranks(docs: DataFrame, recipe: list[Entry], source: str = "source", order_column: str = "doc_id", max_tokens: int | None = None) -> DataFrame:
    """(source, order, n, rank, start) of the documents that are drawn, written once.

    Each decision depends on all before it, so the lengths alone (some bytes a document) pass
    through one task. They come sorted by the time at which `draw_times` has them drawn, so
    that the task holds the few that are not due yet, also when a source has run out. With
    max_tokens, documents that lie behind so many of their own source stay out of it. Order
    values have to differ within a source.
    """
    recipe = normalised(recipe)
    names = [e.name for e in recipe]
    lengths = docs.where(F.col(source).isin(names)).select(F.col(source).alias("_name"), F.col(order_column).alias("_document"), "n")
    rows, _ = order.place(lengths, "n", "_document", "_name", ties=False)
    keep = F.lit(True)
    for e in recipe:
        keep = F.when(F.col("_name") == e.name, F.col("start") >= e.skip).otherwise(keep)
    rows = rows.where(keep)
    first = {r["_name"]: r for r in rows.groupBy("_name").agg(F.min("start").alias("start"), F.count("*").alias("docs"), F.sum("n").alias("n")).collect()}
    weights, counts = [e.weight for e in recipe], [first[name]["docs"] if name in first else 0 for name in names]
    times = draw_times(weights, [first[name]["n"] if name in first else 0 for name in names])
    before, due = F.lit(0).cast("long"), F.lit(0.0)
    for name, parts in zip(names, times, strict=True):
        if name in first:
            before = F.when(F.col("_name") == name, F.col("start") - F.lit(first[name]["start"])).otherwise(before)
            own = F.lit(0.0)
            for mine, drawn, rate in parts:
                own = F.when(F.col("before") >= mine, drawn + (F.col("before") - mine) / rate).otherwise(own)
            due = F.when(F.col("_name") == name, own).otherwise(due)
    meta = rows.select("_name", F.col("_document").cast("long").alias("_document"), "n", before.alias("before")).withColumn("due", due)
    if max_tokens is not None:
        meta = meta.where(F.col("before") < max_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, place = Mixer(weights, counts, max_tokens), {name: k for k, name in enumerate(names)}
        for batch in batches:
            for name, document, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                mixer.offer(place[name], document, n)
            out = list(mixer.draws())
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[names[k] for k in columns[0]], *columns[1:]], types, strict=True)], ["_name", "_document", "rank", "start", "n"])

    queue = meta.repartition(1).sortWithinPartitions("due", "_name", "_document").select("_name", "_document", "n")
    return scratch.written(queue.mapInArrow(run, "_name string, _document long, rank long, start long, n long"), "draws")


def mix(docs: DataFrame, recipe: list[Entry], source: str = "source", order_column: str = "doc_id", max_tokens: int | None = None) -> DataFrame:
    """docs(source, order, n, ...) in drawing order: adds `rank` and `start`, the tokens before.

    The draw is made once, from the lengths (`ranks`). Texts stay where they are and meet their
    rank in a join.
    """
    drawn = ranks(docs, recipe, source, order_column, max_tokens)
    rows = docs.drop("n")
    return rows.join(drawn, (rows[source] == F.col("_name")) & (rows[order_column] == F.col("_document"))).drop("_name", "_document")


def packed(drawn: DataFrame, size: int, max_shards: int | None = None) -> tuple[DataFrame, dict]:
    """Spans of the full shards of a drawn stream (start, n), and the totals."""
    whole = drawn.agg(F.sum("n")).first()[0] or 0
    full = whole // size if max_shards is None else min(whole // size, max_shards)
    cut = shards.spans(drawn.where(F.col("start") < full * size), size, "shard_id").where(F.col("shard_id") < full)
    return cut, {"shards_written": full, "tokens_written": full * size, "tokens_drawn": whole}


def stride_rank(docs: DataFrame, recipe: list[Entry], source: str = "source", order_column: str = "doc_id") -> DataFrame:
    """An approximate mix without a sequential step: documents sort by tokens before / weight.

    Shares agree with the exact mix in the long run; the order of draws does not.
    """
    recipe = normalised(recipe)
    rows, _ = order.place(docs.where(F.col(source).isin([e.name for e in recipe])), "n", order_column, source)
    weight = F.lit(1.0)
    for e in recipe:
        weight = F.when(F.col(source) == e.name, F.lit(e.weight)).otherwise(weight)
    return rows.withColumn("stride", F.col("start") / weight)


def shares(drawn: DataFrame, source: str = "source") -> DataFrame:
    """(source, tokens, share) of all that was drawn, with the tail that fills no shard."""
    sums = drawn.groupBy(source).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    whole = sums.agg(F.sum("tokens")).first()[0] or 1
    return sums.withColumn("share", F.col("tokens") / F.lit(whole))
