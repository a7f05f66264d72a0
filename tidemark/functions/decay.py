"""How confidence ages. Ages are microseconds, half-lives seconds; results between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SINGLE_SOURCE_TRUST, UNEARNED_CROWD_TRUST, MAX_CONFIDENCE, DISSENT_WEIGHT = 0.85, 0.20, 0.97, 0.25
MAX_HALF_LIVES = 60


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def half_lives(age: Column, half_life: Column) -> Column:
    return age / (half_life * 1e6)


def state_confidence(base: Column, age: Column, half_life: Column) -> Column:
    h = half_lives(age, half_life)
    return F.when(half_life.isNull() | (half_life <= 0), 0.0).when(h <= 0, clamp(base)).when(h > MAX_HALF_LIVES, 0.0).otherwise(clamp(base * F.pow(F.lit(0.5), h)))


def value_persistence(p0: Column, asymptote: Column, age: Column, half_life: Column) -> Column:
    h = half_lives(age, half_life)
    return clamp(F.when(h <= 0, p0).when(h > MAX_HALF_LIVES, asymptote).otherwise(asymptote + (p0 - asymptote) * F.pow(F.lit(0.5), h)))


def served_confidence(base: Column, persistence: Column, p0: Column) -> Column:
    """A value no better than a coin toss at first keeps its persistence; others are scaled to what is above one half."""
    return base * F.when(p0.isNull() | (p0 <= 0.5), persistence).otherwise(clamp((persistence - 0.5) / (p0 - 0.5)))


def staleness_band(age: Column, half_life: Column) -> Column:
    h = half_lives(age, half_life)
    return F.when(h < 1, "live").when(h < 2, "recent").when(h < 8, "stale").otherwise("expired")


def serve_value(value: Column, confidence: Column, floor: Column, band: Column, age: Column, max_assert: Column) -> Column:
    """The value, or unknown where confidence is below the floor or the reading too old."""
    gone = (confidence < floor) | (band == "expired") | (max_assert.isNotNull() & (age > max_assert * 1e6))
    return F.when(gone, "unknown").otherwise(value)


def passable(value: Column) -> Column:
    return F.when(value.isin("open", "slow", "congested"), True).when(value == "closed", False)


def severity(value: Column) -> Column:
    return F.when(value == "closed", 4).when(value == "congested", 3).when(value == "slow", 2).when(value == "open", 0).otherwise(1)
