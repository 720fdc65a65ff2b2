"""Sparse matrices in long form: one row per stored cell.

Counts: an absent cell is a true zero, so means divide by the number of spots. Observed values: an absent cell is
missing, and a stored zero is an observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotframe.expect import expect
from spotframe.functions.columns import divide


def sum_duplicates(entries: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """One row per cell; values of repeated cells are summed."""
    return entries.groupBy(row, col).agg(F.sum(value).alias(value))


def check_counts(entries: DataFrame, value: str) -> DataFrame:
    """Counts must be finite whole numbers, zero or more."""
    x = F.col(value).cast("double")
    return expect(entries, whole=(x == F.rint(x)) & ~F.isnan(x) & (F.abs(x) < float("inf")), not_negative=x >= 0)


def outside_mask(values: DataFrame, mask: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Non-zero values on cells that the mask doesn't hold."""
    return values.where(F.col(value) != 0).join(mask, [row, col], "left_anti")


def support_filter(observed: DataFrame, row: str, col: str, least_cols: int = 1000, least_rows: int = 10) -> DataFrame:
    """Rows with enough observed columns first, then columns with enough of the rows that are left."""
    rows = observed.groupBy(row).count().where(F.col("count") >= least_cols)
    kept = observed.join(rows, row, "left_semi")
    cols = kept.groupBy(col).count().where(F.col("count") >= least_rows)
    return kept.join(cols, col, "left_semi")


def filter_by_count(entries: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Cells of those keys that hold at least ``least`` positive cells."""
    counted = entries.groupBy(*keys).count().where(F.col("count") >= least)
    return entries.join(counted, keys, "left_semi")


def qc_metrics(counts: DataFrame, spot: str, value: str, **subsets: Column) -> DataFrame:
    """Per spot: total, n_genes and, for each subset of genes, its total and percentage."""
    aggs = [F.sum(value).alias("total"), F.count_if(F.col(value) > 0).alias("n_genes")]
    aggs += [F.sum(F.when(inside, F.col(value)).otherwise(0)).alias(f"total_{name}") for name, inside in subsets.items()]
    out = counts.groupBy(spot).agg(*aggs)
    return out.withColumns({f"pct_{name}": divide(100 * F.col(f"total_{name}"), F.col("total")) for name in subsets})


def normalize(counts: DataFrame, spot: str, value: str, to: float = 1e4) -> DataFrame:
    """``counts`` with scaled, the value per ``to`` of the spot's total, and logged, its log1p."""
    totals = counts.groupBy(spot).agg(F.sum(value).alias("_total"))
    out = counts.join(totals, spot).withColumn("scaled", divide(F.col(value) * to, F.col("_total"))).drop("_total")
    return out.withColumn("logged", F.log1p("scaled"))


def gene_means(counts: DataFrame, spots: DataFrame, spot: str, gene: str, value: str) -> DataFrame:
    """Per gene: total, detected spots, and means of scaled and logged values over all spots, zeros included."""
    n = spots.select(spot).distinct().agg(F.count("*").alias("n_spots"))
    out = normalize(counts, spot, value).groupBy(gene).agg(F.sum(value).alias("total"), F.count_if(F.col(value) > 0).alias("detected"), F.sum("scaled").alias("_s"), F.sum("logged").alias("_l"))
    return out.crossJoin(F.broadcast(n)).select(gene, "total", "detected", divide(F.col("_s"), F.col("n_spots")).alias("mean_scaled"), divide(F.col("_l"), F.col("n_spots")).alias("mean_logged"))


def collapse_symbols(counts: DataFrame, genes: DataFrame, spot: str, gene: str, symbol: str, value: str) -> DataFrame:
    """Counts of a spot summed over the genes of one symbol."""
    return counts.join(genes.select(gene, symbol), gene).groupBy(spot, symbol).agg(F.sum(value).alias(value))


def high_expression(counts: DataFrame, spot: str, gene: str, value: str, least: int, quantile: float) -> DataFrame:
    """Cells of at least ``least`` counts whose scaled value reaches the gene's quantile of positive values."""
    scaled = normalize(counts, spot, value).where(F.col(value) > 0)
    cut = scaled.groupBy(gene).agg(F.percentile("scaled", quantile).alias("cut"))
    return scaled.join(cut, gene).where((F.col(value) >= least) & (F.col("scaled") >= F.col("cut"))).select(spot, gene, value)


def complex_counts(counts: DataFrame, members: DataFrame, spot: str, gene: str, unit: str, value: str) -> DataFrame:
    """(spot, unit, value): the least count of the unit's genes in each spot; spots that lack one of them have no row.

    ``members``: unit, gene, one row per gene of a unit.
    """
    size = members.groupBy(unit).agg(F.count("*").alias("_size"))
    found = counts.where(F.col(value) > 0).join(members, gene).groupBy(spot, unit).agg(F.count("*").alias("_n"), F.min(value).alias(value))
    return found.join(size, unit).where("_n = _size").select(spot, unit, value)


def high_complexes(counts: DataFrame, members: DataFrame, spot: str, gene: str, unit: str, value: str, least: int, quantile: float) -> DataFrame:
    """(spot, unit, value): cells of ``complex_counts`` with ``least`` counts whose scaled value reaches the unit's quantile.

    Values are scaled by the spot's total over all genes; the quantile runs over the unit's positive cells.
    """
    totals = counts.groupBy(spot).agg(F.sum(value).alias("_total"))
    scaled = complex_counts(counts, members, spot, gene, unit, value).join(totals, spot).withColumn("_scaled", F.col(value) / F.col("_total") * 1e4)
    cut = scaled.groupBy(unit).agg(F.percentile("_scaled", quantile).alias("_cut"))
    return scaled.join(cut, unit).where((F.col(value) >= least) & (F.col("_scaled") >= F.col("_cut"))).select(spot, unit, value)


def expression_groups(logged: DataFrame, spots: DataFrame, spot: str, gene: str, region: str) -> DataFrame:
    """(region, gene, mean, level): none for a mean of 0, low up to the median of all nonzero logged values, else high."""
    middle = logged.where("logged > 0").agg(F.median("logged").alias("middle"))
    size = spots.groupBy(region).agg(F.count("*").alias("n"))
    genes = logged.select(gene).distinct()
    sums = logged.join(spots.select(spot, region), spot).groupBy(region, gene).agg(F.sum("logged").alias("s"))
    full = size.crossJoin(genes).join(sums, [region, gene], "left").crossJoin(F.broadcast(middle))
    mean = divide(F.coalesce("s", F.lit(0.0)), F.col("n"))
    return full.select(region, gene, mean.alias("mean"), F.when(mean == 0, "none").when(mean <= F.col("middle"), "low").otherwise("high").alias("level"))
