"""Array columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, array: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of ``array``, next to the ``keep`` columns.

    For arrays that cost something to compute. A plain explode makes the optimiser add a filter on the array's size
    and push it towards the scan, so the array would be computed twice, and on the unspread input; the outer form
    with the filter on its result does not.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
