"""Operator 2, substring dedup: repeated word windows found by winnowed seeds, then extended.

A window of `length` words contains length - GRAM + 1 short grams; the one of least hash is
its anchor, so equal windows have equal anchors at the same distance. Seeds are all anchors
of the corpus. Those that occur once say that every window around them is unique; they are
named back to their document, and all others are extended both ways, over every window that
the anchor stands for, to hashes of whole windows, 128 bits made of BLAKE2 digests of their
longer words. Of each such window the smallest doc_id
is named back to its document, by 64 of them: two windows of one text that shared those could
only be kept, never cut. A document then knows which of its windows start earlier
elsewhere, and maximal runs of those are cut out.

Grouping is by hash with partial aggregates of fixed size, what returns to a document is
bounded by its own length, and no pair of occurrences is ever made, so a passage that a
third of all documents hold costs its windows once per document. The texts are shuffled
once, by doc_id, for both joins.

Defined results: a null text has no words and stays null; a row with null doc_id has no
place in the order, so it is judged against itself alone and no row against it; rows that
share a doc_id are no earlier than one another; an empty table gives no rows; other columns
are carried in the struct `carried`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import storage, textvec, workers

LENGTH = 20
GRAM = 8


def anchored(hashes: np.ndarray, ptr: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor word, anchor's gram hash) of every window; words of all rows count on."""
    at = textvec.window_starts(ptr, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    gram = min(GRAM, length)
    grams = textvec.rolling_hashes(hashes, gram)
    best, anchor = grams[at], at.copy()
    for j in range(1, length - gram + 1):
        other = grams[at + j]
        less = other < best
        best[less] = other[less]
        anchor[less] = at[less] + j
    return at, anchor, best


def _seeds(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                words = textvec.Words(part.column("text"))
                _, anchor, gram = anchored(words.hashes(), words.ptr, length)
                anchor, first = np.unique(anchor, return_index=True)
                row = np.searchsorted(words.ptr, anchor, side="right") - 1
                place = anchor - words.ptr[row] | part.column("digest").to_numpy()[row].astype(np.int64) << 32
                yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array(place)], ["gram", "doc_id", "place"])

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list<long> column; null is empty."""
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


class _Candidates:
    """The windows of a batch whose anchors are not known to be unique."""

    def __init__(self, part: pa.RecordBatch, length: int):
        self.words = words = textvec.Words(part.column("text"))
        hashes, more = words.digests()
        at, anchor, _ = anchored(hashes, words.ptr, length)
        unique = np.zeros(len(words) + 1, bool)
        place, ends = _lists(part.column("places"))
        row = np.repeat(np.arange(part.num_rows), np.diff(ends))
        inside = (place & 0xFFFFFFFF) < words.counts[row]
        own = inside & (place >> 32 == part.column("digest").to_numpy()[row])
        unique[words.ptr[row[own]] + (place[own] & 0xFFFFFFFF)] = True
        rest = ~unique[anchor]
        self.at = at[rest]
        #: 128 bits that stand for the window.
        self.hash, self.check = (textvec.sequence_hashes(h, self.at, length) for h in (hashes, more))
        self.row = np.searchsorted(words.ptr, self.at, side="right") - 1
        # Whether the same window stands earlier in the row.
        order = np.lexsort((self.at, self.check, self.hash, self.row))
        again = np.zeros(len(order), bool)
        again[1:] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (self.hash, self.check, self.row)])
        self.again = np.zeros(len(order), bool)
        self.again[order] = again


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                found = _Candidates(part, length)
                new = ~found.again & part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[found.row]
                doc_id = part.column("doc_id").take(pa.array(found.row[new]))
                yield pa.RecordBatch.from_arrays([pa.array(found.hash[new].view(np.int64)), pa.array(found.check[new].view(np.int64)), doc_id], ["window", "check", "doc_id"])

    return run


def kept_texts(words: textvec.Words, kept: np.ndarray) -> list[bytes]:
    """Each row's kept words, joined by one space."""
    at = np.flatnonzero(kept)
    size = words.ends[at] - words.starts[at] + 1
    ends = np.cumsum(size)
    data = np.append(words.data, np.uint8(32))[textvec.ranges(words.starts[at], size)]
    data[ends - 1] = 32
    limits = np.concatenate([[0], ends])[np.searchsorted(at, words.ptr)]
    raw = data.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]


def _cut(length: int, names: list[str], verbatim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                found = _Candidates(part, length)
                words, gone = found.words, found.again.copy()
                mine, ends = _lists(part.column("firsts"))
                placed = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                cuts = np.searchsorted(found.row, np.arange(part.num_rows + 1))
                for i in np.unique(found.row):
                    if placed[i]:
                        span = slice(cuts[i], cuts[i + 1])
                        gone[span] |= ~np.isin(found.hash[span], mine[ends[i] : ends[i + 1]].view(np.uint64))
                removed = textvec.covered(len(words), found.at[gone], length)
                sums = np.concatenate([[0], np.cumsum(removed)])
                text = pa.array(kept_texts(words, ~removed), pa.binary()).cast(pa.string())
                given = part.column("text")
                if verbatim:
                    text = pa.compute.if_else(pa.array(np.diff(sums[words.ptr]) > 0), text, given)
                if given.null_count:
                    text = pa.compute.if_else(given.is_null(), given, text)
                out = {
                    "doc_id": part.column("doc_id"), "text": text, "n_words": pa.array(words.counts), "n_removed": pa.array(np.diff(sums[words.ptr])),
                    "removed": textvec.span_lists(*textvec.runs(removed, words.ptr), part.num_rows),
                }
                out |= {n: part.column(n) for n in names}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def dedup(docs: DataFrame, length: int = LENGTH, carry: bool = False, verbatim: bool = False) -> DataFrame:
    """doc_id, text (its kept words, joined by a space), n_words, n_removed, removed (spans of
    words) of each row; with carry, `carried` holds the other columns; with verbatim, a text
    from which nothing is cut stays as it is."""
    extra = storage.carried(docs) if carry else []
    # Rows without an id meet nothing; a key of their own keeps them from one task.
    key = F.coalesce("doc_id", F.xxhash64("text")).alias("key")
    base = docs.select("doc_id", "text", key, F.hash("text").alias("digest"), *extra)
    names = ["carried"] if extra else []
    seeds = base.select("doc_id", "text", "digest").where("doc_id is not null").mapInArrow(workers.tidy(_seeds(length)), "gram long, doc_id long, place long")
    single = seeds.groupBy("gram").agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id"), F.max("place").alias("place")).where("n = 1")
    places = single.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("place").alias("places"))
    known = base.join(places, "key", "left")
    # The same columns on both ways, so that the texts are shuffled once.
    windows = known.mapInArrow(workers.tidy(_windows(length)), "window long, check long, doc_id long")
    firsts = windows.groupBy("window", "check").agg(F.min("doc_id").alias("doc_id")).groupBy(F.col("doc_id").alias("key")).agg(F.collect_list("window").alias("firsts"))
    schema = storage.schema("doc_id long, text string, n_words long, n_removed long, removed array<struct<begin:int,end:int>>", base)
    return known.join(firsts, "key", "left").mapInArrow(workers.tidy(_cut(length, names, verbatim)), schema)
