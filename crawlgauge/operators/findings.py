"""Findings: (site, module, check_id, status, value, detail, ord). ``status`` is ok, fail, warn or info."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import each

COLUMNS = ["site", "module", "check_id", "status", "value", "detail", "ord"]


@dataclass
class Check:
    """One check on a one-row-per-site table; a NULL status means it does not apply."""

    check_id: str
    ord: int
    status: Column
    value: Column | None = None
    detail: Column | None = None


check = Check


def ok_or(test: Column, otherwise: str = "fail") -> Column:
    return F.when(test, "ok").otherwise(otherwise)


def one_row_per_check(df: DataFrame, module: str, checks: list[Check]) -> DataFrame:
    """Turn a one-row-per-site table into findings."""
    return all_checks(df, {module: checks})


def all_checks(df: DataFrame, modules: dict[str, list[Check]]) -> DataFrame:
    """Findings of several modules from one row per site, in one pass."""
    listed = [(module, c) for module, checks in modules.items() for c in checks]
    names = ", ".join(
        f"named_struct('module', '{module}', 'check_id', '{c.check_id}', 'ord', {c.ord})" for module, c in listed
    )
    no_value, no_detail = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = F.arrays_zip(
        F.expr(f"array({names})").alias("name"),
        F.array(*[c.status for _, c in listed]).alias("status"),
        F.array(*[no_value if c.value is None else c.value.cast("double") for _, c in listed]).alias("value"),
        F.array(*[no_detail if c.detail is None else c.detail.cast("string") for _, c in listed]).alias("detail"),
    )
    return (
        each(df, ["site"], rows, "f")
        .select("site", "f.name.*", "f.status", "f.value", "f.detail")
        .where(F.col("status").isNotNull())
        .select(*COLUMNS)
    )
