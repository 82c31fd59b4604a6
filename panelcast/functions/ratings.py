"""Rating arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start of every rating, exchange rate, home advantage, pull to the mean between seasons.
START, K, HOME, CARRY = 1500.0, 12.5, 45.0, 0.1


def expected_score(gap):
    """Expected score at a rating gap; on numbers and on columns alike."""
    return 1.0 / (10.0 ** (-gap / 400.0) + 1.0)


def margin(difference: float) -> float:
    """Weight of a result by its margin: its square root, at least one."""
    return max(1.0, abs(difference)) ** 0.5


def expected_home(home: Column, away: Column, advantage: float = HOME) -> Column:
    """Expected score of the home side (win 1, draw 0.5)."""
    return expected_score(home - away + F.lit(advantage))


def margin_factor(difference: Column) -> Column:
    return F.when(difference.isNotNull(), F.sqrt(F.greatest(F.lit(1), F.abs(difference)).cast("double")))


def event_gap(own: Column, other: Column, home: Column, advantage: float = HOME) -> Column:
    """Rating gap from the row's side, home advantage included; null when either side is unrated. An unknown flag counts as home."""
    return own - other + F.when(~home, F.lit(-advantage)).otherwise(F.lit(advantage))
