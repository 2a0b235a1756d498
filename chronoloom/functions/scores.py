"""Score formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_score(distance: Column, decay: float = 0.5, most: int = 3) -> Column:
    return F.when(distance <= most, F.pow(F.lit(decay), distance)).otherwise(0.0)


def combine(relevance: Column, distance: Column, alpha: float = 0.7) -> Column:
    return alpha * relevance + (1 - alpha) * distance_score(distance)


def retention(hours: Column, strength: Column) -> Column:
    """Ebbinghaus: exp(-whole hours / (24 strength))."""
    return F.exp(-F.floor(hours) / (strength * 24.0))


def importance(base: Column, days: Column, access: Column, degree: Column, rate: float = 0.01) -> Column:
    """Decayed importance with boosts for access and degree, within 0 and 1."""
    raw = base * F.exp(-rate * days) + F.log(access + 1.0) / 10 + F.log(degree + 1.0) / 10
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def composite(access: Column, hours: Column, degree: Column, words: Column) -> Column:
    """Access, recency, degree and length.  Recency is infinite where the last access lies 168 hours ahead of now, as IEEE division has it."""
    weeks = 1 + hours / 168.0
    recent = F.when(weeks != 0, 0.3 / weeks).when(weeks == 0, float("inf"))
    return 0.3 * F.log(access + 1.0) / 10 + recent + 0.25 * F.least(degree, F.lit(20)) / 20.0 + 0.15 * F.least(words / 50.0, F.lit(1.0))


def state_key(*parts: Column) -> Column:
    """Four bins from 0 to 10, joined by colons."""
    return F.concat_ws(":", *[F.round(p * 10).cast("int").cast("string") for p in parts])


def llm_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Dollars, prices per million tokens."""
    return tokens_in * (price_in / 1e6) + tokens_out * (price_out / 1e6)


def circle(i: Column, n: Column, spread: float = 1.0) -> Column:
    """Position i of n on a circle."""
    angle = 2 * 3.141592653589793 * i / n
    return F.struct((spread * F.cos(angle)).alias("x"), (spread * F.sin(angle)).alias("y"))
