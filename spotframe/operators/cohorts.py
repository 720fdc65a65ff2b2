"""Samples and modalities side by side: checked joins, alignment, summaries over fixed levels, wide tables and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.expect import Violation, expect, in_range
from spotframe.functions.columns import divide
from spotframe.operators.intervals import nearest
from spotframe.staging import broadcast_if_small


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str]) -> DataFrame:
    """``rows`` with the columns of their one row in ``table``; raises where a key has none there or several.

    A key of several columns matches where all of them are equal; one that holds a null has no row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    expect(table, unique=[keys])
    missing = rows.select(*keys).join(table.select(*keys), keys, "left_anti").limit(3).collect()
    if missing:
        raise Violation(f"{', '.join(keys)} without a row in the table: {[tuple(r) for r in missing]}")
    return rows.join(table, keys)


def spot_keys(spots: DataFrame, keys: DataFrame, barcode: str = "barcode", key: str = "key", row: str = "array_row", col: str = "array_col") -> DataFrame:
    """``spots`` with ``key``, by which they meet a coverage table's ``keys`` (key).

    A barcode RR_CC is the key RRCC, any other one its own. Where all ``keys`` are of four digits but not all barcodes,
    keys are the grid's coordinates instead, which must be whole numbers from 0 to 99. Two spots of one key raise.
    """
    four = r"\A[0-9]{4}\z"
    own = F.regexp_replace(barcode, r"\A([0-9]{2})_([0-9]{2})\z", "$1$2")
    seen = keys.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(key).rlike(four), F.lit(False))).alias("unlike")).first()
    if not seen["n"] or seen["unlike"] or spots.where(~own.rlike(four)).isEmpty():
        return expect(spots.withColumn(key, own), unique=[[key]], barcode=F.col(barcode).isNotNull())
    if lacking := [c for c in (row, col) if c not in spots.columns]:
        raise Violation(f"keys are coordinates, but there is no {', '.join(lacking)}")
    whole = {c: in_range(F.col(c), 0, 99) & (F.col(c).cast("double") == F.floor(F.col(c).cast("double"))) for c in (row, col)}
    placed = spots.withColumn(key, F.format_string("%02d%02d", F.col(row).cast("int"), F.col(col).cast("int")))
    expect(spots, **whole)
    return expect(placed, unique=[[key]])


def one_to_one(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner join of several tables, in each of which a key occurs once; raises where it doesn't."""
    out = expect(tables[0], unique=[[key]])
    for t in tables[1:]:
        out = out.join(expect(t, unique=[[key]]), key)
    return out


def members_only(rows: DataFrame, column: str, wanted: list) -> DataFrame:
    """The rows whose ``column`` is among ``wanted``, all of which must occur."""
    kept = rows.where(F.col(column).isin(list(wanted)))
    if missing := set(wanted) - {r[0] for r in kept.select(column).distinct().collect()}:  # at most the wanted values
        raise Violation(f"unknown {column}: {sorted(missing)}")
    return kept


def align(modality: DataFrame, reference: DataFrame, pairs: DataFrame, source: str, target: str, replaced: list[str]) -> DataFrame:
    """Rows of a modality under the ids of the reference, with the reference's values of ``replaced`` columns.

    ``pairs`` holds a spot of the modality (column ``source``) and of the reference (``target``) in each row; ``modality``
    and ``reference`` are keyed by these. The modality's own id and values are kept as source_<name>.
    """
    expect(pairs, unique=[[source], [target]])
    own = modality.select(*[F.col(c).alias(f"source_{c}") if c in (*replaced, source) else F.col(c) for c in modality.columns])
    both = pairs.select(F.col(source).alias(f"source_{source}"), target).join(own, f"source_{source}")
    return both.join(reference.select(target, *replaced), target)


def attach(rows: DataFrame, table: DataFrame, key: str, **default) -> DataFrame:
    """``rows`` with the columns of ``table``; rows without a partner keep null or the given defaults."""
    out = rows.join(broadcast_if_small(table), key, "left")
    return out.fillna(default) if default else out


def override(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` taken from ``other`` where it has a value, else their own."""
    new = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def with_usage(metadata: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """All rows of ``usage`` with the metadata that is there."""
    return metadata.join(usage, key, "right")


def coverage_status(rows: DataFrame, covered: str, total: str, least: float = 0.5, fine: str = "ok") -> DataFrame:
    """``rows`` with coverage_fraction and status: low_coverage below ``least``."""
    share = divide(F.col(covered), F.col(total))
    return rows.withColumn("coverage_fraction", share).withColumn("status", F.when(share >= least, fine).otherwise("low_coverage"))


def available(rows: DataFrame, flag: str = "score_available") -> DataFrame:
    """The rows whose flag is true; a null flag counts as false."""
    return rows.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def level_counts(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """(level, n, percent) for every given level in their order, levels without rows too; percent is of all rows."""
    spark = rows.sparkSession
    dims = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "position int, level string")
    found = rows.groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"))
    whole = rows.agg(F.count("*").alias("total"))
    out = dims.join(found, "level", "left").crossJoin(F.broadcast(whole))
    return out.select("position", "level", F.coalesce("n", F.lit(0)).alias("n"), divide(100 * F.coalesce("n", F.lit(0)), F.col("total")).alias("percent"))


def reference_summary(cells: DataFrame, label: str, umi: str, least_umi: int, least_cells: int, most_cells: int) -> DataFrame:
    """Per label: cells, cells with enough UMIs, cells used and status (retained or too_few_cells); an empty label raises."""
    expect(cells, label=F.trim(F.col(label)) != "")
    out = cells.groupBy(label).agg(F.count("*").alias("n_input"), F.count_if(F.col(umi) >= least_umi).alias("n_umi_pass"))
    enough = F.col("n_umi_pass") >= least_cells
    return out.withColumn("n_used", F.when(enough, F.least("n_umi_pass", F.lit(most_cells))).otherwise(0).cast("long")).withColumn("status", F.when(enough, "retained").otherwise("too_few_cells"))


def median_centroids(rows: DataFrame, group: str, axes: list[str]) -> DataFrame:
    """Per group the median of each axis."""
    return rows.groupBy(group).agg(*[F.median(a).alias(a) for a in axes])


def to_wide(rows: DataFrame, key: str, column: str, value: str, columns: list) -> DataFrame:
    """One row per key and a column for each of ``columns``, with the summed value or null."""
    return rows.groupBy(key).pivot(column, list(columns)).agg(F.sum(value))


def stack_vectors(parts: list[DataFrame], key: str, vector: str) -> DataFrame:
    """Vectors of the same ids joined end to end; raises unless all parts hold the same ids once."""
    out = expect(parts[0].select(key, F.col(vector).alias("_0")), unique=[[key]])
    n = out.count()
    for i, p in enumerate(parts[1:], 1):
        out = out.join(expect(p.select(key, F.col(vector).alias(f"_{i}")), unique=[[key]]), key)
        if p.count() != n or out.count() != n:
            raise Violation(f"{key}: part {i} holds other ids")
    return out.select(key, F.concat(*[F.col(f"_{i}") for i in range(len(parts))]).alias(vector))


def by_code(rows: DataFrame, code: str, position: str) -> DataFrame:
    """``rows`` with place: their rank by code, then by their position, from 0; ranks within a code come from its size."""
    sizes = rows.groupBy(code).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(code).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a code
    inner = F.row_number().over(Window.partitionBy(code).orderBy(position)) - 1
    return rows.withColumn("_i", inner).join(broadcast_if_small(sizes.select(code, before.alias("_b"))), code).withColumn("place", (F.col("_b") + F.col("_i")).cast("long")).drop("_b", "_i")


def category_order(rows: DataFrame, column: str, position: str, first: list[str]) -> DataFrame:
    """(category, place): the categories of ``first`` that occur, in that order, then the others as first seen."""
    fixed = F.array(*[F.lit(x) for x in first])
    seen = rows.groupBy(F.col(column).alias("category")).agg(F.min(position).alias("_seen"))
    at = F.array_position(fixed, F.col("category"))
    order = Window.orderBy(F.when(at > 0, at).otherwise(F.lit(len(first) + 1)), "_seen", "category")  # one row a category
    return seen.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select("category", "place")


def disambiguated(rows: DataFrame, name: str, ident: str) -> DataFrame:
    """``rows`` with label: the name, followed by the id in brackets where several rows share it."""
    twice = F.count("*").over(Window.partitionBy(name)) > 1
    return rows.withColumn("label", F.when(twice, F.concat(F.col(name), F.lit(" ["), F.col(ident).cast("string"), F.lit("]"))).otherwise(F.col(name)))


def file_slugs(rows: DataFrame, name: str, position: str, most: int = 80, empty: str = "annotation", taken: tuple[str, ...] = ("overview",)) -> DataFrame:
    """``rows`` with slug: letters, digits and ``._-`` of the name; a row whose slug is taken counts on from -2 until one is free.

    Rows take their slugs in the order of ``position``; those of ``taken`` are never given. Slugs that differ in
    trailing numbers only may meet, so such rows (names of one table, alike but for their endings) are one group.
    """
    plain = F.substring(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", ""), 1, most)
    base = rows.withColumn("_s", F.when(plain == "", empty).otherwise(plain))

    def numbered(x: pd.DataFrame) -> pd.DataFrame:
        used, count, out = set(taken), {}, []
        for s in (x := x.sort_values("_p", kind="stable"))["_s"]:
            free = s
            while free in used:
                count[s] = count.get(s, 1) + 1
                free = f"{s}-{count[s]}"
            used.add(free)
            out.append(free)
        return pd.DataFrame({"_p": x["_p"], "_s": x["_s"], "slug": out})

    kind = rows.schema[position].dataType.simpleString()
    keys = expect(base.select(F.col(position).alias("_p"), "_s"), unique=[["_p"]])
    slugs = keys.groupBy(F.regexp_replace("_s", r"(-\d+)+$", "")).applyInPandas(numbered, f"_p {kind}, _s string, slug string")
    return base.join(slugs.select(F.col("_p").alias(position), "slug"), position).select(*rows.columns, "slug")


def round_half_even(x: Column) -> Column:
    """x as a whole number, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("long")


def is_close(x: Column, y: Column, rel: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether x lies within ``absolute`` + ``rel`` * |y| of y; infinities equal themselves, null and NaN nothing."""
    a, b = x.cast("double"), y.cast("double")
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    near = F.when(finite, F.abs(a - b) <= absolute + rel * F.abs(b)).otherwise(a == b)
    return F.coalesce(near & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def signed_tss_distance(regions: DataFrame, genes: DataFrame, region: str, gene: str, width: int = 10_000) -> DataFrame:
    """(region, gene, distance): the gene whose transcription start is nearest; distance is negative upstream of it.

    A region that holds the start has distance 0; ties go to the smaller start, then to the smaller gene id.
    """
    tss = F.when(F.col("strand") == "+", F.col("lo")).otherwise(F.col("hi") - 1)
    starts = genes.select("chrom", tss.alias("lo"), (tss + 1).alias("hi"), gene, "strand")
    found = nearest(regions, starts, region, gene, width).withColumnRenamed("distance", "_gap")
    out = found.join(regions.select(region, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), region).join(starts.select(gene, F.col("lo").alias("_tss"), "strand"), gene)
    held = (F.col("_lo") <= F.col("_tss")) & (F.col("_tss") < F.col("_hi"))
    right = F.col("_lo") > F.col("_tss")  # of the start: downstream on the plus strand
    sign = F.when(right == (F.col("strand") == "+"), 1).otherwise(-1)
    return out.select(region, gene, F.when(held, 0).otherwise(sign * (F.col("_gap") + 1)).cast("long").alias("distance"))
