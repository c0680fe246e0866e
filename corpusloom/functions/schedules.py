"""Schedules and footprints: arithmetic over parameter tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_rate(step: Column, warmup: Column, steps: Column, peak: Column, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine to floor * peak."""
    progress = (step - warmup) / F.greatest(F.lit(1), steps - warmup)
    cosine = 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, peak * step / F.greatest(F.lit(1), warmup)).otherwise(peak * (floor + (1 - floor) * cosine))


def planned_steps(rows: Column, batch: Column, epochs: Column, most: Column, keep: float = 0.8) -> Column:
    """Steps of the epochs over the share of rows that survives filtering, `most` at most if positive."""
    whole = F.greatest(F.lit(1), F.floor(F.floor(rows * F.lit(keep)) / batch)) * epochs
    return F.when(most > 0, F.least(whole, most)).otherwise(whole).cast("long")


def cache_floats(d_model: Column, heads: Column, d_latent: Column, d_rope: Column) -> tuple[Column, Column]:
    """Cached floats per token and layer: (full keys and values, latent with a rotary key)."""
    return 2 * heads * F.floor(d_model / heads), d_latent + d_rope


def cache_bytes(floats: Column, layers: Column, tokens: int | Column, batch: int = 1, width: int = 2) -> Column:
    return (floats * layers * (tokens * batch * width)).cast("long")


def bits(nats: Column) -> Column:
    return nats / F.lit(math.log(2))


def rotary_table(positions: DataFrame, width: int, base: float = 10_000.0) -> DataFrame:
    """(position, pair, cosine, sine) of the rotations of a head's `width` / 2 value pairs."""
    if width % 2:
        raise ValueError("rotations need an even width")
    half = width // 2
    each = positions.select("position", F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("pair"))
    angle = F.col("position") / F.pow(F.lit(base), F.col("pair") / half)
    return each.select("position", "pair", F.round(F.cos(angle), 9).alias("cosine"), F.round(F.sin(angle), 9).alias("sine"))


def is_matrix(name: Column, dimensions: Column) -> Column:
    """Whether a parameter is a block's weight matrix: no embedding, output head, norm or bias."""
    low = F.lower(name)
    # What the names of all other parameters contain.
    outside = low.contains("embed") | low.contains("lm_head") | low.contains("norm") | low.endswith(".bias")
    return (dimensions >= 2) & ~outside
