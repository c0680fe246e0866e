"""Operator 13, source divergence audit: how far the sources of a language lie apart in their words.

Words are counted per (language, source) where the texts are, in Arrow tables that are merged
when HELD_COUNTS are held, then summed by Spark. A language keeps the terms of at least `least`
of its documents; a kept term gets a place in one of the language's chunks, which hold about
CHUNK terms each. A group's
counts in a chunk are packed into one sparse vector. Groups of a language are dealt into blocks,
and vectors are replicated to every block-by-block tile that their block is part of; a tile goes
through successive chunks, turns its two blocks' counts into shares and adds up their pair
submatrix. Tiles are cut along the vocabulary too (SPAN chunks a task), and their sums are added
by Spark, so a language or a source with most of the rows is work of many tasks.

Shares are whole billionths: p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), divided in three
steps of a thousand, which keeps all numbers in 64 bits up to N + 2 * V of 9 * 10**15.

Bounds: a task holds BLOCK groups twice by CHUNK terms, and packed vectors of SPAN chunks; the
driver holds one row per language. The pair part has a row for each ordered pair of sources of
a language, as is asked for; each of them costs the kept terms.

Defined results: null text, lang and source are ''; a group without terms has shares too (its
counts are zero), and where a language keeps no term all its pairs have value 0; a language of
one source has no pairs; an empty table gives no rows; repeated rows count as often as they
are there; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import storage, textvec, workers

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Terms of a chunk, about; chunks that one tile task goes through; groups of a block.
CHUNK = 4096
SPAN = 4
BLOCK = 64
#: Counts of (language, source, term) that a task holds, and their bytes, before it merges them;
#: if more than half are left, it hands them on.
HELD_COUNTS = 250_000
HELD_BYTES = 16 << 20

#: Lower-cases A-Z and turns all that `[^\x00-\x40\x5B-\x60\x7B-\x7F]` excludes into spaces.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
_INSIDE = textvec.byte_class(b" ")
UNIT = 1_000_000_000


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of these lengths that lie in data one behind the other."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Counts:
    """Occurrences and documents of each (language, source, term)."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[pa.Table] = []
        self.size = self.bytes = 0

    def add(self, part: pa.RecordBatch) -> None:
        words = textvec.Words(part.column("text"), _INSIDE, FOLD)
        if not len(words):
            return
        spelt = _strings(words.data[_INSIDE[words.data]], words.ends - words.starts).dictionary_encode()
        size, number = len(spelt.dictionary), spelt.indices.to_numpy()
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], dtype=np.int64)
        # Each term of a row once, with its times there; then each of a group.
        held, times = np.unique(words.rows() * size + number, return_counts=True)
        key = group[held // size] * size + held % size
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = key[begin]
        columns = [pa.array((key // size).astype(np.int32)), spelt.dictionary.take(pa.array(key % size))]
        columns += [pa.array(np.add.reduceat(times[order], begin)), pa.array(np.diff(np.append(begin, len(order))))]
        self.hold(pa.Table.from_arrays(columns, ["group", "term", "n", "docs"]))

    def hold(self, part: pa.Table) -> None:
        self.parts.append(part)
        self.size += part.num_rows
        self.bytes += part.nbytes

    def full(self, share: int = 1) -> bool:
        return self.size > HELD_COUNTS // share or self.bytes > HELD_BYTES // share

    def merge(self) -> None:
        sums = pa.concat_tables(self.parts).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        self.parts, self.size, self.bytes = [], 0, 0
        self.hold(sums.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for some in (b for part in self.parts for b in part.to_batches(max_chunksize=50_000)):
            group, *rest = some.columns
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), *rest], ["lang", "source", "term", "n", "docs"])
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        for part in textvec.chunks(batch):
            counts.add(part)
            if counts.full():
                counts.merge()
                # What repeats is merged again; what doesn't is handed on.
                if counts.full(2):
                    yield from counts.flush()
    if counts.parts:
        counts.merge()
    yield from counts.flush()


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / whole) for count + 2 <= whole."""
    out, rest = np.zeros(np.broadcast(count, whole).shape, np.int64), count + 2
    for _ in range(3):
        rest = rest * 1000
        step = rest // whole
        rest = rest - step * whole
        out = out * 1000 + step
    return out + 1


def _share(count: Column, whole: Column) -> Column:
    """`shares` as a column expression."""
    out, rest = F.lit(0).cast("long"), count + 2
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        step = div(rest * 1000, whole)
        out, rest = out * 1000 + step, rest * 1000 - step * whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one tile's pairs over the chunks that come, sorted by their number."""
    rows = pa.Table.from_batches(list(batches))
    if not rows.num_rows:
        return
    names = sorted({(s, b) for s, b in zip(rows.column("source").to_pylist(), rows.column("block").to_pylist(), strict=True)})
    at = {s: k for k, (s, _) in enumerate(names)}
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = (np.array([k for k, (_, b) in enumerate(names) if b == side], dtype=np.int64) for side in (i, j))
    total = np.zeros((len(left), len(right)), np.int64)
    chunk = rows.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
        part = rows.take(pa.array(mine))
        size = part.column("terms")[0].as_py()
        own = np.array([at[s] for s in part.column("source").to_pylist()], dtype=np.int64)
        count = np.zeros((len(names), size), np.int64)
        places, values = (part.column(c).combine_chunks() for c in ("places", "counts"))
        many = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        count[np.repeat(own, many), places.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
        whole = np.ones((len(names), 1), np.int64)
        whole[own, 0] = part.column("whole").to_numpy()
        p = shares(count, whole)
        for a, k in enumerate(left):
            total[a] += distances(p[k], p[right]).sum(axis=1)
    a, b = np.meshgrid(left, right, indexing="ij")
    wanted = a < b if i == j else np.ones(a.shape, bool)
    lang = rows.column("lang")[0].as_py()
    pairs = [pa.array([names[k][0] for k in side[wanted].tolist()], pa.string()) for side in (a, b)]
    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pairs[0]), pa.string()), *pairs, pa.array(total[wanted])], ["lang", "a", "b", "value"])


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, chunk: int = CHUNK, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a group lies from the other sources of its
    language (part `pair`), and the terms it has more of than the language (part `term`)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select(blank("text"), blank("lang"), blank("source"))
    found = base.mapInArrow(workers.tidy(_count), "lang string, source string, term string, n long, docs long")
    # Each distinct term of a group, written once: all that follows reads it.
    counts = storage.written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    sizes = {r["lang"]: r for r in terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("n")).collect()}
    langs = docs.sparkSession.createDataFrame([(k, r["v"], r["n"], -(-r["v"] // chunk)) for k, r in sizes.items()], "lang string, v long, lang_whole long, chunks long")
    known = terms.join(F.broadcast(langs), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    kept = storage.written(known.select("lang", "term", "lang_n", "chunk", place.cast("int").alias("place")), "kept")
    held = storage.written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "chunk", "place"), "held")
    # Every group that occurs, with its kept words; those without terms too.
    wholes = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = base.select("lang", "source").distinct().join(wholes, ["lang", "source"], "left").join(F.broadcast(langs), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("chunks", F.lit(0)).alias("chunks"), (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("whole"))
    blocks = groups.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    groups = storage.written(groups.join(F.broadcast(blocks), "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")
    pairs = _ranked(_pairs(groups, held, kept, span), ["lang", "source"])
    terms = _terms(held, groups, langs).withColumn("rank", _rank(["lang", "source"])).where(F.col("rank") <= top)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*order).unionByName(terms.withColumn("part", F.lit("term")).select(*order))


def _rank(by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("rank", _rank(by))


def _pairs(groups: DataFrame, held: DataFrame, kept: DataFrame, span: int) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    packed = held.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("own"))
    sizes = kept.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("terms"))
    each = groups.where("v > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("int"), (F.col("chunks") - 1).cast("int"))))
    vectors = each.join(sizes, ["lang", "chunk"]).join(packed, ["lang", "source", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = vectors.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "span": F.call_function("div", F.col("chunk"), F.lit(span))})
    dealt = spread.select("lang", "i", "j", "span", "chunk", "terms", "source", "block", "whole", F.col("own.place").alias("places"), F.col("own.n").alias("counts"))
    sums = dealt.groupBy("lang", "i", "j", "span").applyInArrow(lambda t: pa.Table.from_batches(list(_tile(iter(t.to_batches()))), _PAIR), "lang string, a string, b string, value long")
    found = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Languages without a kept term have pairs, too: all of value zero.
    bare = groups.where("v = 0").select("lang", "source", "block", "blocks")
    mine = bare.withColumn("other", other).select("lang", F.col("source").alias("a"), F.col("other").alias("block"))
    none = mine.join(bare.select("lang", F.col("source").alias("b"), "block"), ["lang", "block"]).where("a < b").select("lang", "a", "b", F.lit(0).cast("long").alias("value"))
    both = found.unionByName(none)
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return both.select("lang", way.alias("w"), "value").select("lang", "w.source", "w.item", "value")


_PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _terms(held: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more of than its language."""
    rows = held.join(groups.select("lang", "source", "whole"), ["lang", "source"]).join(F.broadcast(langs), "lang")
    both = rows.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("whole")).alias("p"), _share(F.col("lang_n"), F.col("lang_whole") + 2 * F.col("v")).alias("q"))
    d = F.col("p") - F.col("q")
    return both.where("p > q").select("lang", "source", "item", F.call_function("div", d * d, F.col("p") + F.col("q")).alias("value"))
