"""Operator 12, ranked lexical search: a tiered index, read from its high-impact postings down.

Documents are indexed where they are, half a megabyte of text at a time: a segment holds the
postings of the items' terms, by term. A posting's gain is its term's weight times its impact.
Cuts of the gain, taken from a histogram over all postings, part them into tiers, which are
columns of the segment's row, so that a pass over the first tier reads that one alone. Of each
term the largest gain below a tier is known: no document gets more from postings not yet read.

A pass over the tiers read so far sums what each document has of an item; the twentieth best
such sum is a score that twenty documents reach. Where all that an unseen document could have is
less, the item is proven: documents whose sum and open bounds reach that score are completed from
the lower tiers, and no other can be among the best. Items without that proof fall through to the
next tier; in the last one nothing is open, so every item's result is exact.

Items are taken PASS_ITEMS or PASS_WORDS at a time; the driver holds one pass and, for each of
its terms, a document count and bounds. A task holds `most` documents for each item of a pass.
The few best of all tasks are merged by item and a hash of the document, then by item. Sums are
whole numbers below 2**53, or made in 64-bit integers where an item is so long that they may not be.

Defined results: a null text has no terms and doesn't count, an item without terms that occur
has no rows; each item row has its own result, also where rows share an item_id; rows that
share a doc_id are documents of their own; a null doc_id comes after all others of its score;
an empty table of either kind gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from corpusloom.llm import storage, textvec, workers

MOST = 20
PASS_ITEMS = 2_048
PASS_WORDS = 200_000
#: Share of all postings that the tiers but the last hold.
TIERS = (1 / 8, 1 / 2)
#: Parts of a doubling of the gain that the histogram tells apart.
FINE = 16
#: (Item, document) sums that a task holds at once.
CELLS = 2_000_000

#: Lower-cases A-Z and turns all that `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]` excludes into spaces.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
_INSIDE = textvec.byte_class(b" ")
_LAST = np.int64(2**63 - 1)

_SEGMENT = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<int>, ends array<int>, docs array<int>, tf array<long>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD.tobytes()).split()


@dataclass
class Items:
    """One pass: names of its items, the vocabulary, and by term the items that hold it."""

    names: list
    vocabulary: dict[bytes, int]
    begin: np.ndarray  # of each term
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        held = [(vocabulary.setdefault(t, len(vocabulary)), k, n) for k, (_, words) in enumerate(rows) for t, n in Counter(words).items()]
        term, item, times = (np.array([x[i] for x in held], dtype=np.int64) for i in range(3))
        order = np.argsort(term, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))]).astype(np.int64)
        return cls([name for name, _ in rows], vocabulary, begin, item[order], times[order])

    def only(self, wanted: np.ndarray) -> Items:
        """The postings of some items."""
        keep = np.isin(self.item, wanted)
        term = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))[keep]
        begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.begin) - 1))]).astype(np.int64)
        return Items(self.names, {}, begin, self.item[keep], self.times[keep])

    def sums(self, by_term: np.ndarray) -> np.ndarray:
        """What each item's terms come to, repeats included."""
        term = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        out = np.zeros(len(self.names), np.int64)
        np.add.at(out, self.item, self.times * by_term[term])
        return out


def passes(benchmark: DataFrame, most_items: int, most_words: int) -> Iterator[Items]:
    rows: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        words = terms_of(row.text)
        if rows and (len(rows) >= most_items or size + len(words) > most_words):
            yield Items.of(rows)
            rows, size = [], 0
        if words:
            rows.append((row.item_id, words))
            size += len(words)
    if rows:
        yield Items.of(rows)


def _segments(shared):
    """Postings (document, times) of the vocabulary's terms in each half megabyte of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in textvec.chunks(batch):
                words = textvec.Words(part.column("text"), _INSIDE, FOLD)
                first, back = words.distinct()
                raw = words.data.tobytes()
                number = np.array([known.get(raw[a:b], -1) for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)], dtype=np.int64)
                mine = number[back] if len(first) else np.zeros(0, np.int64)
                at = np.flatnonzero(mine >= 0)
                rows = part.num_rows
                key, tf = np.unique(mine[at] * rows + words.rows()[at], return_counts=True)
                term, row = key // max(1, rows), key % max(1, rows)
                used, doc = np.unique(row, return_inverse=True)
                terms, ends = np.unique(term, return_index=True)
                ends = np.append(ends[1:], len(term)) if len(terms) else ends
                lists = [part.column("doc_id").take(pa.array(used)), words.counts[used], terms.astype(np.int32), ends.astype(np.int32), doc.astype(np.int32), tf.astype(np.int64)]
                columns = [pa.array([int((words.counts > 0).sum())]), pa.array([int(words.counts.sum())])]
                columns += [_list(x) for x in lists]
                yield pa.RecordBatch.from_arrays(columns, ["n_docs", "n_terms", "ids", "lengths", "terms", "ends", "docs", "tf"])

    return run


def _list(values) -> pa.Array:
    """One row that holds them all."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Each segment's columns as arrays; a null id is the last of all, and told by `nulls`."""
    for batch in batches:
        for k in range(batch.num_rows):
            out = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if pa.types.is_list(column.type):
                    values = column[k].values
                    if name == "ids":
                        out["nulls"] = values.is_null().to_numpy(zero_copy_only=False)
                        values = values.fill_null(int(_LAST))
                    out[name] = values.to_numpy(zero_copy_only=False)
            yield out


def _by_place(df: DataFrame, value, size: int, join=np.add) -> np.ndarray:
    """Of what `value` gives for each segment, places and numbers, the sums by place (or the
    maxima): a task hands on one row for each place, the driver holds as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for segment in _rows(batches):
            join.at(total, *value(segment))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    out = np.zeros(size, np.int64)
    for r in df.mapInArrow(workers.tidy(run), "place long, n long").groupBy("place").agg((F.sum if join is np.add else F.max)("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def _gains(segment: dict[str, np.ndarray], weight: np.ndarray, n: int, total: int) -> np.ndarray:
    """Weight times impact of each posting."""
    m = 75 + 25 * segment["lengths"].astype(np.int64) * n // total
    tf = segment["tf"]
    return weight[_term(segment["terms"], segment["ends"])] * (1_000_000_000 * tf // (1000 * tf + 12 * m[segment["docs"]]))


def _term(terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each posting's term."""
    return np.repeat(terms, np.diff(ends, prepend=0))


def _bucket(gain: np.ndarray) -> np.ndarray:
    return (np.log2(gain.astype(np.float64) + 1) * FINE).astype(np.int64)


def _part(shared, cuts: list[int], n: int, total: int):
    """A segment's postings by tier: gains of at least cuts[0], of at least cuts[1], ..., the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for segment in _rows(batches):
            gain, term = _gains(segment, weight, n, total), _term(segment["terms"], segment["ends"])
            tier = np.searchsorted(-np.array(cuts, np.int64), -gain, side="left") if cuts else np.zeros(len(gain), np.int64)
            ids = pa.array(segment["ids"], mask=segment["nulls"])
            columns = {"ids": _list(ids)}
            for k in range(len(cuts) + 1):
                mine = np.flatnonzero((tier == k) & (gain > 0))
                terms, ends = np.unique(term[mine], return_index=True)
                ends = np.append(ends[1:], len(mine)) if len(terms) else ends
                columns |= {f"terms{k}": _list(terms.astype(np.int32)), f"ends{k}": _list(ends.astype(np.int32)), f"docs{k}": _list(segment["docs"][mine].astype(np.int32)), f"gains{k}": _list(gain[mine])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _tier_columns(k: int) -> list[str]:
    return [f"{name}{k}" for name in ("terms", "ends", "docs", "gains")]


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, most: int):
        self.most, self.least = most, np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least[item]
        self.parts.append((item[keep], score[keep], doc[keep], null[keep]))
        self.size += int(keep.sum())
        if self.size > 4 * self.most * len(self.least) + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        item, score, doc, null = (np.concatenate(x) for x in zip(none, *self.parts, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        full = place == self.most - 1
        self.least[item[full]] = score[full]
        keep = place < self.most
        self.parts, self.size = [(item[keep], score[keep], doc[keep], null[keep])], int(keep.sum())
        return self.parts[0]


def _added(items: Items, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, values: list[np.ndarray], n_docs: int, base: int, count: int, exact: bool, only: np.ndarray | None = None) -> list[np.ndarray]:
    """For items base to base + count, and each document, the sums of values by posting; only: where."""
    term = _term(terms, ends)
    many = (items.begin[term + 1] - items.begin[term]).astype(np.int64)
    which = np.repeat(np.arange(len(term)), many)
    at = textvec.ranges(items.begin[term], many)
    item = items.item[at] - base
    inside = (item >= 0) & (item < count)
    if only is not None:
        inside[inside] = only[item[inside], docs[which[inside]]]
    which, at, item = which[inside], at[inside], item[inside]
    key, out = item * n_docs + docs[which], []
    for value in values:
        gain = items.times[at] * value[which]
        if exact:
            total = np.bincount(key, weights=gain, minlength=count * n_docs).astype(np.int64)
        else:
            total = np.zeros(count * n_docs, np.int64)
            np.add.at(total, key, gain)
        out.append(total.reshape(count, n_docs))
    return out


def _search(shared, tiers: int, all_tiers: int, most: int):
    """The best of a task's segments by their first tiers; where `floor` is given, of those whose
    bound reaches it, completed from the other tiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor, open_, bound, exact = shared.value
        best, size = _Best(len(items.names), most), len(items.names)
        for segment in _rows(batches):
            n = len(segment["ids"])
            step = max(1, CELLS // max(1, n))
            for base in range(0, size if n else 0, step):
                count = min(step, size - base)
                sums = np.zeros((count, n), np.int64)
                seen = np.zeros((count, n), np.int64)
                for k in range(tiers):
                    terms, ends, docs, gains = (segment[c] for c in _tier_columns(k))
                    values = [gains] if floor is None else [gains, open_[_term(terms, ends)]]
                    found = _added(items, terms, ends, docs, values, n, base, count, exact)
                    sums += found[0]
                    if floor is not None:
                        seen += found[1]
                if floor is not None:
                    wanted = sums + bound[base : base + count, None] - seen >= np.maximum(floor[base : base + count, None], 1)
                    near = np.flatnonzero(wanted.any(axis=0))
                    for k in range(tiers, all_tiers if len(near) else tiers):
                        terms, ends, docs, gains = (segment[c] for c in _tier_columns(k))
                        sums += _added(items, terms, ends, docs, [gains], n, base, count, exact, wanted)[0]
                    sums[~wanted] = 0
                item, doc = np.nonzero(sums >= best.least[base : base + count, None])
                best.add(item + base, sums[item, doc], segment["ids"][doc], segment["nulls"][doc])
        item, score, doc, null = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The best of each item with their ranks; a task merges the rows of a part of the documents."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for by in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
    return found.select("item", "doc_id", "score", "rank")


def search(docs: DataFrame, benchmark: DataFrame, most: int = MOST, tiers: tuple[float, ...] = TIERS, pass_items: int = PASS_ITEMS, pass_words: int = PASS_WORDS, report: list[dict] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's `most` best documents. To report is added, for
    each pass and tier, how many items were open and how many of them were proven."""
    spark = docs.sparkSession
    schema = StructType([StructField("item_id", benchmark.schema["item_id"].dataType)]).add("rank", "integer").add("doc_id", "long").add("score", "long")
    out = [spark.createDataFrame([], schema)]
    for items in passes(benchmark, pass_items, pass_words):
        names = spark.createDataFrame(list(enumerate(items.names)), StructType().add("item", "long").add("item_id", schema["item_id"].dataType))
        for found in _results(docs, items, most, tiers, report):
            out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def _results(docs: DataFrame, items: Items, most: int, shares: tuple[float, ...], report: list[dict] | None) -> Iterator[DataFrame]:
    spark, v = docs.sparkSession, len(items.vocabulary)
    send = spark.sparkContext.broadcast
    segments = storage.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(workers.tidy(_segments(send(items.vocabulary))), _SEGMENT), "segments")
    n, total = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n:
        return
    # One number for each term, and for each bucket of gains.
    df = _by_place(segments.select("terms", "ends"), lambda s: (s["terms"], np.diff(s["ends"], prepend=0)), v)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) if k else 0 for k in df.tolist()], dtype=np.int64)
    held = send(weight)
    buckets = 64 * FINE
    spread = _by_place(segments.select("lengths", "terms", "ends", "docs", "tf"), lambda s: (_bucket(_gains(s, held.value, n, total)), 1), buckets)
    above = np.cumsum(spread[::-1])[::-1]
    cuts = [math.ceil(2 ** (int(np.flatnonzero(above >= share * max(1, above[0]))[-1]) / FINE)) for share in shares]
    cuts = sorted({c for c in cuts if c > 1}, reverse=True)
    kinds = {"terms": "int", "ends": "int", "docs": "int", "gains": "long"}
    schema = "ids array<long>, " + ", ".join(f"{c} array<{kinds[c[:-1]]}>" for k in range(len(cuts) + 1) for c in _tier_columns(k))
    index = storage.written(segments.mapInArrow(workers.tidy(_part(held, cuts, n, total)), schema), "tiers")
    storage.drop(segments)
    last = len(cuts)
    # The largest gain of each term in each tier, from which follow the bounds below it.
    gains = lambda k: _by_place(index.select(f"terms{k}", f"ends{k}", f"gains{k}"), lambda s: (_term(s[f"terms{k}"], s[f"ends{k}"]), s[f"gains{k}"]), v, np.maximum)
    tops = [gains(k) for k in range(1, last + 1)]
    exact = int(items.sums(weight).max(initial=0)) * 1_000_000 < 1 << 53
    pending = np.flatnonzero(items.sums(df) > 0)
    for k in range(last + 1):
        if not len(pending):
            return
        mine = items.only(pending)
        columns = ["ids", *(c for j in range(k + 1) for c in _tier_columns(j))]
        first = _merged(index.select(*columns).mapInArrow(workers.tidy(_search(send((mine, None, None, None, exact)), k + 1, k + 1, most)), "item long, doc_id long, score long"), most)
        if k == last:
            _told(report, k, len(pending), len(pending))
            yield first
            return
        open_ = np.maximum.reduce(tops[k:])
        bound, floor = mine.sums(open_), np.zeros(len(items.names), np.int64)
        for r in first.where(F.col("rank") == most).collect():
            floor[r["item"]] = r["score"]
        proven = pending[(bound[pending] < floor[pending]) | (bound[pending] == 0)]
        _told(report, k, len(pending), len(proven))
        if len(proven):
            found = index.mapInArrow(workers.tidy(_search(send((items.only(proven), floor, open_, bound, exact)), k + 1, last + 1, most)), "item long, doc_id long, score long")
            yield _merged(found, most).join(F.broadcast(spark.createDataFrame([(int(p),) for p in proven], "item long")), "item", "left_semi")
        pending = np.setdiff1d(pending, proven)


def _told(report: list[dict] | None, tier: int, open_: int, proven: int) -> None:
    if report is not None:
        report.append({"tier": tier, "open": open_, "proven": proven})

