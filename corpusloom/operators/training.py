"""Training steps of a softmax regression, with gradients summed by Spark.

A step is one job: each task goes through its rows batch by batch and hands on the sums of loss
and gradient, which have a fixed size; Spark adds them entry by entry, and the driver, which
holds the weights, clips and applies them. Rows are never kept by a task, so a partition may be
of any size; a lost task is run again alone, and results don't depend on the number of tasks but
for rounding. Weights, moments and the step are a `State`: training goes on from one exactly.

Weights of a matrix shape are updated by orthogonalised momentum and all others by AdamW, or all
by AdamW. The weights are bounded by MOST entries, checked. A step's batch is the rows whose key
hashes to it, so every row is in one batch of an epoch. Rows with a null vector or target, or an
ignored target, take no part; a batch without rows has loss zero and no gradient. A loss that is
no number stops the training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import numeric
from corpusloom.operators import orthogonal

#: Entries of weights and biases together: they go to each task, and as many sums come back.
MOST = 1 << 20
# AdamW's decay rates and what keeps it from dividing by zero; the momentum of the other.
BETAS, EPSILON, MOMENTUM = (0.9, 0.95), 1e-8, 0.95
MODES = ("muon", "adamw")


@dataclass(frozen=True)
class Plan:
    """How to train: the largest rates, warm-up, length and clipping."""

    total: int
    warmup: int = 0
    mode: str = "adamw"
    rate: float = 0.003
    matrix_rate: float = 0.02
    decay: float = 0.1
    clip: float = 1.0
    batches: int = 1


@dataclass(frozen=True)
class State:
    """Weights (classes by width), bias, both optimizers' moments, steps done."""

    weights: np.ndarray
    bias: np.ndarray
    step: int = 0
    moments: dict = field(default_factory=dict)


def rate(step: int, plan: Plan, most: float) -> float:
    """Linear warm-up, then a cosine down to a tenth."""
    if step < plan.warmup:
        return most * step / max(1, plan.warmup)
    share = (step - plan.warmup) / max(1, plan.total - plan.warmup)
    return most * (0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * share)))


def gradient(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(rows, mean loss, gradient of the weights, of the bias) over rows(x, y)."""
    classes, width = weights.shape
    if classes * (width + 1) > MOST:
        raise ValueError(f"{classes * (width + 1)} weights; at most {MOST} may be trained")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes * (width + 1) + 2)
        for batch in batches:
            y, flat = batch.column("y").to_numpy(zero_copy_only=False), batch.column("x").flatten()
            if not len(y):
                continue
            if flat.null_count or len(flat) != len(y) * width:
                raise ValueError(f"a vector is not {width} numbers")
            if y.min() < 0 or y.max() >= classes:
                raise ValueError(f"a target is none of {classes} classes")
            x = flat.to_numpy(zero_copy_only=False).reshape(len(y), width)
            scores = x @ weights.T + bias
            scores -= scores.max(axis=1, keepdims=True)
            share = np.exp(scores)
            mass = share.sum(axis=1)
            loss = np.log(mass) - scores[np.arange(len(y)), y]
            share /= mass[:, None]
            share[np.arange(len(y)), y] -= 1
            sums += np.concatenate([(share.T @ x).ravel(), share.sum(axis=0), [loss.sum(), len(y)]])
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

    kept = rows.where(f"x is not null and y is not null and y <> {numeric.IGNORED}").select(numeric.doubles(F.col("x")).alias("x"), F.col("y").cast("long").alias("y"))
    cells = kept.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    held = np.zeros(classes * (width + 1) + 2)
    for r in cells.collect():
        held[r["k"]] = r["v"]
    n = int(held[-1])
    mean = held[:-1] / max(1, n)
    return n, float(mean[-1]), mean[: classes * width].reshape(classes, width), mean[classes * width : -1]


def _adamw(value: np.ndarray, grad: np.ndarray, held: tuple | None, step: int, by: float, decay: float) -> tuple[np.ndarray, tuple]:
    first, second = held or (np.zeros_like(value), np.zeros_like(value))
    first, second = BETAS[0] * first + (1 - BETAS[0]) * grad, BETAS[1] * second + (1 - BETAS[1]) * grad**2
    size = np.sqrt(second / (1 - BETAS[1] ** (step + 1))) + EPSILON
    return value * (1 - by * decay) - by * first / (1 - BETAS[0] ** (step + 1)) / size, (first, second)


def _muon(value: np.ndarray, grad: np.ndarray, held: np.ndarray | None, by: float) -> tuple[np.ndarray, np.ndarray]:
    buffer = grad if held is None else MOMENTUM * held + grad
    ahead = MOMENTUM * buffer + grad
    ahead = ahead if ahead.shape[0] >= ahead.shape[1] else ahead.T
    update = ahead @ orthogonal.factor(ahead.T @ ahead)
    update = update if update.shape == value.shape else update.T
    return value - by * math.sqrt(max(value.shape) / min(value.shape)) * update, buffer


def train_step(rows: DataFrame, state: State, plan: Plan) -> tuple[State, dict]:
    """The state behind one step on rows(x, y), and its entry for the log."""
    if plan.mode not in MODES:
        raise ValueError(f"no optimizer mode {plan.mode}; there are {', '.join(MODES)}")
    n, loss, weights, bias = gradient(rows, state.weights, state.bias)
    if not math.isfinite(loss):
        raise RuntimeError(f"the loss is {loss} at step {state.step}: training diverged")
    norm = math.sqrt(float((weights**2).sum() + (bias**2).sum()))
    clip = min(1.0, plan.clip / (norm + 1e-6))
    by, moments = rate(state.step, plan, plan.rate), dict(state.moments)
    if plan.mode == "muon":
        new, moments["weights"] = _muon(state.weights, weights * clip, moments.get("weights"), rate(state.step, plan, plan.matrix_rate))
    else:
        new, moments["weights"] = _adamw(state.weights, weights * clip, moments.get("weights"), state.step, by, plan.decay)
    offset, moments["bias"] = _adamw(state.bias, bias * clip, moments.get("bias"), state.step, by, plan.decay)
    entry = {"step": state.step, "n": n, "loss": loss, "grad_norm": norm, "rate": by}
    return replace(state, weights=new, bias=offset, moments=moments, step=state.step + 1), entry


def train(rows: DataFrame, plan: Plan, classes: int, width: int, key: str = "key", state: State | None = None, until: int | None = None) -> tuple[State, list[dict]]:
    """The state behind the plan's steps, or `until` one, on rows(key, x, y), and the log; from zeros, or from a state on."""
    state, log = state or State(np.zeros((classes, width)), np.zeros(classes)), []
    while state.step < min(plan.total, plan.total if until is None else until):
        own = rows if plan.batches == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(plan.batches)) == state.step % plan.batches)
        state, entry = train_step(own, state, plan)
        log.append(entry)
    return state, log
