"""Column expressions with guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(x: Column, y: Column) -> Column:
    """x / y; null where y is 0 or null."""
    return F.try_divide(x.cast("double"), F.nullif(y.cast("double"), F.lit(0.0)))


def pad_pair(row: Column, col: Column) -> Column:
    """Canonical spot id RR_CC; numbers of three digits stay whole."""
    return F.concat(F.format_string("%02d", row), F.lit("_"), F.format_string("%02d", col))


def split_pair(spot: Column) -> Column:
    """(row, col) of a spot id ``\\d+_\\d+`` or four digits; null for other texts."""
    row = F.regexp_extract(spot, r"^(\d+)_(\d+)$|^(\d\d)(\d\d)$", 0)
    wide = F.split(spot, "_")
    return F.when(row == "", None).when(spot.contains("_"), F.struct(F.try_element_at(wide, F.lit(1)).cast("int").alias("row"), F.try_element_at(wide, F.lit(2)).cast("int").alias("col"))).otherwise(
        F.struct(F.substring(spot, 1, 2).cast("int").alias("row"), F.substring(spot, 3, 2).cast("int").alias("col"))
    )


def slug(x: Column) -> Column:
    """Lower-case letters, digits and single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def natural_key(x: Column) -> Column:
    """Sort key in which runs of digits compare as numbers and letters without case."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), F.lit(0)).otherwise(1).alias("k"), F.when(p.rlike(r"^\d+$"), p.cast("decimal(38,0)")).alias("n"), p.alias("s")))


def unseen_share(fraction: Column, depth: Column) -> Column:
    """1 - (1 - fraction) ** depth, stable for small fractions; 1 where the fraction is 1 or more."""
    return F.when(fraction >= 1, 1.0).otherwise(-F.expm1(depth * F.log1p(-fraction)))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def width_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """Equal-width bin 0..n-1 of x in [low, high]; the last bin is closed."""
    at = F.floor(divide(x - low, high - low) * n)
    return F.least(F.coalesce(at, F.lit(0)), F.lit(n - 1)).cast("long")


def unit_vector(x: Column) -> Column:
    """x over its Euclidean norm; raises for a zero vector."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double") * y))
    return F.transform(x, lambda y: y / F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double")))


def squared_distance(x: Column, y: Column) -> Column:
    """Sum of squared differences, left to right in double precision."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def single_spaced(x: Column) -> Column:
    """x without outer blanks, each run of blanks inside as one space."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))
