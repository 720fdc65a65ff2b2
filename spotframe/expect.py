"""Constraint checks: all constraints of a table in one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A table breaks a constraint."""


def expect(df: DataFrame, unique: list[list[str]] = (), not_empty: bool = False, **rules: Column) -> DataFrame:
    """``df`` unchanged, if each rule holds on every row and each key is unique; else raises Violation.

    A rule that is null on a row counts as broken.
    """
    checks = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    row = df.agg(F.count("*").alias("_rows"), *checks).first()
    broken = [f"{name}: {row[name]} rows" for name in rules if row[name]]
    if not_empty and not row["_rows"]:
        broken.append("no row")
    for key in unique:
        if twice := df.groupBy(*key).count().where("count > 1").limit(1).collect():
            broken.append(f"{', '.join(key)} isn't unique: {twice[0].asDict()}")
    if broken:
        raise Violation("; ".join(broken))
    return df


def require_same_ids(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises Violation unless both tables hold the same ids."""
    only_a, only_b = a.select(key).join(b.select(key), key, "left_anti"), b.select(key).join(a.select(key), key, "left_anti")
    if not only_a.isEmpty() or not only_b.isEmpty():
        raise Violation(f"{key}: the tables hold different ids")


def in_range(x: Column, low: float, high: float) -> Column:
    """Whether ``x`` is a finite number from low to high; false for null and NaN."""
    x = x.cast("double")
    return F.coalesce(x.between(low, high) & ~F.isnan(x), F.lit(False))


def expect_fractions(cells: DataFrame, mask: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``cells`` (i, j, value) if all are fractions at single places of the matrix, as those of ``mask`` are, which holds 0 and 1."""
    inside = {"row": F.col("i").between(1, n_rows), "col": F.col("j").between(1, n_cols)}
    expect(mask, unique=[["i", "j"]], zero_or_one=F.col("value").isin(0.0, 1.0), **inside)
    return expect(cells, unique=[["i", "j"]], fraction=in_range(F.col("value"), 0.0, 1.0), **inside)
