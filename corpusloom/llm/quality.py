"""Operator 5, quality classifier: random-indexing word vectors and a small numpy network.

A word's index vector is sparse and ternary and follows from the word's hash alone. A word's
context vector is the sum of the index vectors of the words around it in all texts of the
table; words share BUCKETS rows by hash, so the table of vectors has a fixed size, of which
each task makes one and Spark sums them up in slices. A text is the mean of its words' index
vectors and of their context vectors, pooled over the whole text, with the logarithm of its
length, of both means' norms (high where few words make up the text) and the share of words
whose index vector is their neighbour's. A two-layer network turns that into a logit, and a
temperature and offset fitted on rows that the network was not trained on calibrate its
probability.

Labels are taken from a sample of at most PER_LABEL rows of each label, those of least hash,
and never from a held-out row. Of them the driver receives pooled vectors, no texts. Scores
depend on the text and on the table's texts alone.

Defined results: a null or empty text is scored like any text without words; a null doc_id
counts as not held out; rows that repeat have equal results; with no label, or one kind of
label only, every score is 0.5 or that kind's share, smoothed; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import sampling, textvec, workers

PER_LABEL = 3_000
BUCKETS = 1 << 15
DIM = 48
#: Entries of an index vector that are not zero.
NONZERO = 6
REACH = 2
#: Occurrences of a bucket whose contexts are summed in 16 bits an entry.
MOST = 0xFFFF // (4 * REACH * NONZERO)
#: Rows of the table of vectors that are summed as one value.
SLICE = 256
#: A text's figures besides the means.
FIGURES = 4
HIDDEN = 32
EPOCHS = 60
BATCH = 128
RATE = 0.01
DECAY = 1e-4
#: Share of the sample that calibrates the probabilities.
CALIBRATION = 4
THRESHOLD = 0.7


def index_vectors() -> np.ndarray:
    """(BUCKETS, DIM) sparse ternary vectors, from each bucket's number alone."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    seed = np.arange(BUCKETS, dtype=np.uint64)
    for k in range(NONZERO):
        z = textvec.mix(seed * np.uint64(NONZERO) + np.uint64(k) + np.uint64(0xA5A5))
        np.add.at(out, (np.arange(BUCKETS), (z >> np.uint64(8)).astype(np.int64) % DIM), np.where(z & np.uint64(1), 1.0, -1.0).astype(np.float32))
    return out


def buckets(words: textvec.Words) -> np.ndarray:
    return (words.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64)


def lanes(index: np.ndarray) -> np.ndarray:
    """Index vectors, and zeros as the last, with a byte for each entry and eight of them in a number.
    NONZERO is added to an entry, so none is negative and sums of few carry nothing over."""
    return (np.concatenate([index, np.zeros((1, DIM))]) + NONZERO).astype(np.uint8).view(np.uint64)


def add_contexts(words: textvec.Words, index: np.ndarray, out: np.ndarray) -> None:
    """Adds to out, for each bucket, the index vectors (as lanes) within REACH words of its occurrences.

    Occurrences are put side by side by bucket; a bucket's sum is the difference of two running
    sums. Those may run over, as a difference is right as long as it fits itself: 16 bits an
    entry, which MOST occurrences do not fill."""
    own = buckets(words)
    if not len(own):
        return
    # Between rows there are as many empty places as a word reaches over.
    place = np.arange(len(own)) + REACH * (words.rows() + 1)
    near = np.full(place[-1] + REACH + 1, BUCKETS)
    near[place] = own
    order = np.argsort(own.astype(np.uint16), kind="stable")
    own, place = own[order], place[order]
    sums = index[near[place - REACH]]
    for gap in (*range(1 - REACH, 0), *range(1, REACH + 1)):
        sums += index[near[place + gap]]
    total = np.cumsum(sums.view(np.uint8).astype(np.uint16).view(np.uint64), axis=0)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    size = np.diff(first, append=len(own))
    often = -(-size // MOST)
    first = np.repeat(first, often) + MOST * textvec.ranges(np.zeros_like(often), often)
    size = np.diff(first, append=len(own))
    ends = total[first + size - 1]
    ends[1:] -= ends[:-1].copy()
    found = ends.view(np.uint16).astype(np.float32) - (2 * REACH * NONZERO * size)[:, None].astype(np.float32)
    if len(first) > len(often):
        np.add.at(out, own[first], found)
    else:
        out[own[first]] += found


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all texts' words: (BUCKETS, DIM)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = lanes(index_vectors()), np.zeros((BUCKETS, DIM), np.float32)
        for batch in batches:
            for part in textvec.chunks(batch):
                add_contexts(textvec.Words(part.column("text")), index, out)
        yield slices(range(0, BUCKETS // SLICE), [out[k * SLICE : (k + 1) * SLICE] for k in range(BUCKETS // SLICE)])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("sums"), strict=True):
                if k not in sums:
                    sums[k] = np.zeros((SLICE, DIM))
                sums[k] += np.frombuffer(raw.as_buffer(), np.float32).reshape(SLICE, DIM)
        yield slices(sums, [x.astype(np.float32) for x in sums.values()])

    def slices(numbers, values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())], ["slice", "sums"])

    kind = "slice int, sums binary"
    parts = docs.select("text").mapInArrow(workers.tidy(run), kind).repartition(min(BUCKETS // SLICE, 32), "slice").mapInArrow(workers.tidy(total), kind).collect()
    out = np.zeros((BUCKETS, DIM), np.float32)
    for r in parts:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["sums"], np.float32).reshape(SLICE, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS, 2 * DIM)
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    offset: float

    def pooled(self, column: pa.Array) -> np.ndarray:
        return pooled(column, self.table)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.logits(self.pooled(column)) / self.temperature + self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * np.asarray(x, dtype=np.float64)) + 1)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Each text's mean word vectors and figures on them (see the module's head)."""
    words = textvec.Words(column)
    width = table.shape[1]
    out = np.zeros((len(column), width + FIGURES), np.float32)
    rows = np.flatnonzero(words.counts)
    if len(rows):
        own = buckets(words)
        row = words.rows()
        # Equal words of a text are added once, by their number.
        pairs, counts = np.unique(row * BUCKETS + own, return_counts=True)
        owner = pairs // BUCKETS
        first = np.searchsorted(owner, rows)
        sums = np.add.reduceat(table[pairs % BUCKETS] * counts[:, None].astype(np.float32), first, axis=0)
        out[rows, :width] = sums / words.counts[rows, None]
        same = np.zeros(len(own))
        same[1:] = (own[1:] == own[:-1]) & (row[1:] == row[:-1])
        out[rows, width + 1] = np.add.reduceat(same, words.ptr[:-1][rows]) / words.counts[rows]
        for k, half in enumerate((out[rows, : width // 2], out[rows, width // 2 : width])):
            out[rows, width + 2 + k] = np.log(np.linalg.norm(half, axis=1) + 1e-3)
    out[:, width] = np.log1p(words.counts)
    return out


def train(table: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """From the vectors of all words, pooled texts and their labels."""
    width, x, y = 2 * DIM + FIGURES, np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    layers = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0]
    model = Model(table, np.zeros(width), np.ones(width), layers, 1.0, 0.0)
    if not 0 < y.sum() < len(y):
        model.offset = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[:: CALIBRATION], np.delete(order, np.s_[:: CALIBRATION])
    if not 0 < y[used].sum() < len(used):
        used = order
    x = (x - model.mean) / model.scale
    p = {"w1": rng.normal(size=(width, HIDDEN)) / np.sqrt(width), "b1": np.zeros(HIDDEN), "w2": rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), "b2": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    # Both labels weigh alike in training; calibration restores the sample's shares.
    weight = np.where(y == 1, 0.5 / y[used].mean(), 0.5 / (1 - y[used].mean()))
    step, steps = 0, EPOCHS * -(-len(used) // BATCH)
    for _ in range(EPOCHS):
        mixed = rng.permutation(used)
        for some in np.array_split(mixed, max(1, -(-len(used) // BATCH))):
            step += 1
            h = np.tanh(x[some] @ p["w1"] + p["b1"])
            d = (sigmoid(h @ p["w2"] + p["b2"]) - y[some]) * weight[some] / len(some)
            dh = np.outer(d, p["w2"]) * (1 - h**2)
            g = {"w1": x[some].T @ dh + DECAY * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + DECAY * p["w2"], "b2": np.array([d.sum()])}
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, grad in g.items():
                a, b = moments[k]
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model.layers = [p["w1"], p["b1"], p["w2"], float(p["b2"][0])]
    z = np.tanh(x[held] @ p["w1"] + p["b1"]) @ p["w2"] + model.layers[3]
    model.temperature, model.offset = calibrate(z, y[held])
    return model


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(temperature, offset) of least log loss of sigmoid(z / temperature + offset), by Newton steps."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * z + offset)
        w = p * (1 - p)
        grad = np.array([((p - y) * z).sum() + 0.01 * (slope - 1), (p - y).sum() + 0.01 * offset])
        hess = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
        slope, offset = max(0.05, slope - move[0]), offset - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return 1 / slope, offset


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    spark = docs.sparkSession
    marked = labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    table = np.concatenate([index_vectors(), context_vectors(docs)], axis=1)
    vectors = spark.sparkContext.broadcast(table)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                x = pooled(part.column("text"), vectors.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_label"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "_label", "x"])

    # Drawn from the labels alone, so that no text is moved; of rows that share an id one is learnt from.
    wanted, rows = sampling.drawn(marked, "_label", per_label, 2), []
    if wanted is not None:
        texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(wanted), "doc_id")
        made = texts.mapInArrow(workers.tidy(pool), "doc_id long, _label int, x binary").groupBy("doc_id", "_label").agg(F.min("x").alias("x"))
        rows = sorted(tuple(r) for r in made.collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows]).reshape(len(rows), 2 * DIM + FIGURES)
    shared = spark.sparkContext.broadcast(train(table, x, np.array([r[1] for r in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.chunks(batch):
                score = shared.value.score(part.column("text"))
                out = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select("doc_id", "text", sampling.held_out().alias("held_out"))
    return picked.mapInArrow(workers.tidy(run), "doc_id long, held_out boolean, score double, predicted int")
