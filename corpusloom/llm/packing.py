"""Operator 4, packing: token windows of near-equal load by Karmarkar-Karp differencing.

Every document's ids (and a closing id) are cut into full windows and a remainder, which is
cut again at a quarter window, as many small pieces balance better than few large ones. Each
task gathers the small pieces of its own rows, a bounded group at a time, and spreads each
group over k windows: all partial partitions wait in a heap by imbalance, the two most
imbalanced merge with opposing orders, until one is left. Where its fullest window exceeds
the capacity, k rises and the group is spread again. No row moves between tasks, so there
is no shuffle, and a hot source is packed where it is read.

Defined results: a null text is empty (one piece, the closing id alone); a null doc_id stays
null; rows that repeat are packed each for itself; an empty table gives no pieces; other
columns are ignored. A text of any length is cut, so no piece exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm import textvec, wordbpe, workers

CAPACITY = 2048
END_ID = 1
#: Small pieces that are spread together.
GROUP = 512
#: Share of a group's windows that is added when its fullest window is too full.
STEP = 0.002

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each item after multiway differencing of the items over k windows."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    loads: list[np.ndarray | None] = []
    made: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        # Loads ascend; before its first merge an item is a partition with one filled window.
        load = np.zeros(k, np.int64)
        load[-1] = size
        loads.append(load)
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        loads[a] = loads[b] = None
        made.append((a, b, order))
        loads.append(both)
        heapq.heappush(heap, (int(both[0] - both[-1]), n + len(made) - 1))
    # From the last merge back: which final window each slot of a partition became.
    final: dict[int, np.ndarray] = {n + len(made) - 1: np.arange(k)}
    for j in range(len(made) - 1, -1, -1):
        a, b, order = made[j]
        whole = np.empty(k, np.int64)
        whole[order] = final.pop(n + j)
        final[a], final[b] = whole, whole[::-1]
    return np.array([final[i][-1] for i in range(n)], dtype=np.int64)


def spread(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each item, with no window above the capacity and as few windows as that takes."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max() <= capacity:
            return window
        k += max(1, int(k * STEP))


def cuts(total: int, capacity: int) -> list[tuple[int, int, bool]]:
    """(start, length, whole window) of a document's pieces."""
    whole = total // capacity * capacity
    small = max(1, capacity // 4)
    out = [(at, capacity, True) for at in range(0, whole, capacity)]
    return out + [(at, min(small, total - at), False) for at in range(whole, total, small)]


class _Sequences:
    """Numbers the windows of one task and gives the rows of their pieces."""

    def __init__(self, capacity: int, group: int):
        self.capacity, self.group, self.next, self.waiting = capacity, group, TaskContext.get().partitionId() << 40, []

    def add(self, piece: tuple, whole: bool) -> list[tuple]:
        if whole:
            self.next += 1
            return [(*piece, self.next - 1, 0)]
        self.waiting.append(piece)
        return self.flush() if len(self.waiting) == self.group else []

    def flush(self) -> list[tuple]:
        if not self.waiting:
            return []
        sizes = np.array([x[2] for x in self.waiting], dtype=np.int64)
        window = spread(sizes, self.capacity)
        _, window = np.unique(window, return_inverse=True)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.diff(window[order], prepend=-1))
        base = np.repeat((ends - sizes[order])[first], np.diff(first, append=len(order)))
        offset = ends - sizes[order] - base
        out = [(*self.waiting[i], self.next + int(window[i]), int(o)) for i, o in zip(order, offset, strict=True)]
        self.next += int(window.max()) + 1
        self.waiting = []
        return out


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequences = wordbpe.encoder(tokenizer_path).encode, _Sequences(capacity, group)
        end = np.array([end_id], dtype="<u4")

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)

        for batch in batches:
            for part in textvec.chunks(batch):
                ids, at = encode(part.column("text"))
                ids, rows = ids.astype("<u4"), []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.concatenate([ids[at[i] : at[i + 1]], end])
                    for start, length, whole in cuts(len(own), capacity):
                        crc = zlib.crc32(own[start : start + length].data)
                        rows += sequences.add((doc_id, start, length, crc, len(own)), whole)
                if rows:
                    yield table(rows)
        if rows := sequences.flush():
            yield table(rows)

    return docs.select("doc_id", "text").mapInArrow(workers.tidy(run), SCHEMA)
