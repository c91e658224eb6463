"""Rating formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expectancy(home: Column, away: Column, home_advantage: Column) -> Column:
    """Expected home score for a rating gap."""
    gap = home + home_advantage - away
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -gap / 400.0))


def gap_from_score(mean_score: Column) -> Column:
    """Inverse of :func:`expectancy`; null outside (0, 1)."""
    inside = (mean_score > 0) & (mean_score < 1)
    return F.when(inside, -400.0 * F.log10(F.when(inside, 1.0 / mean_score - 1.0)))
