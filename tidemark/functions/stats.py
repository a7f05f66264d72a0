"""Statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of Wilson's interval; null for n = 0."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def fisher_interval(r: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Confidence bounds of a correlation by Fisher's transformation; null for fewer than 4 pairs or a perfect r."""
    ok = (n > 3) & (F.abs(r) < 1)
    return F.when(ok, F.tanh(F.atanh(r) - z / F.sqrt(n - 3))), F.when(ok, F.tanh(F.atanh(r) + z / F.sqrt(n - 3)))


def kappa(agreed: Column, by_chance: Column) -> Column:
    """Cohen's kappa from the shares of agreement, seen and expected; null where chance alone explains all."""
    return F.when(by_chance < 1, (agreed - by_chance) / (1 - by_chance))
