"""Scores, bands and means over whatever parts are present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of_present(*parts: Column) -> Column:
    """Mean of the non-NULL parts, NULL when all are missing."""
    total, n = F.lit(0.0), F.lit(0)
    for part in parts:
        total = total + F.coalesce(part.cast("double"), F.lit(0.0))
        n = n + part.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def whole(score: Column) -> Column:
    """Scores are cut, not rounded; no data scores 0."""
    return F.coalesce(F.floor(score), F.lit(0)).cast("bigint")


def percent(part: Column, total: Column) -> Column:
    """part / total * 100, NULL when total is 0."""
    return F.when(total > 0, part / total * 100)


def band(value: Column, *steps, default) -> Column:
    """First result whose lower bound is reached: band(x, (80, 'ok'), (50, 'warn'), default='fail')."""
    out = None
    for bound, result in steps:
        out = F.when(value >= bound, result) if out is None else out.when(value >= bound, result)
    return out.otherwise(default)


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def schema_score(errors: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), 100 - errors * 5 - warnings).cast("bigint")


def psi_band(score: Column, high: float = 90, low: float = 50) -> Column:
    return F.when(score >= high, "good").when(score >= low, "needs_work").when(score.isNotNull(), "poor")


def card_colour(score: Column) -> Column:
    return F.when(score.isNull(), "gray").when(score >= 90, "green").when(score >= 50, "amber").otherwise("red")


def layer_colour(score: Column) -> Column:
    return F.when(score >= 80, "#16a34a").when(score >= 50, "#d97706").otherwise("#dc2626")


def jaccard(shared: Column, size_a: Column, size_b: Column) -> Column:
    union = size_a + size_b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
