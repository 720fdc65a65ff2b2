"""Sites in files sorted by place, read by region from few of them; and the order of files as they came."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.expect import Violation

#: Rows of a file at most, and bytes of its row groups.
FILE_ROWS, GROUP_BYTES = 4_000_000, 8 << 20


def parse_span(region: str) -> tuple[str, int, int]:
    """(chrom, lo, hi), 0-based and half-open, of ``chrom:start-end``, 1-based and inclusive."""
    chrom, _, span = region.rpartition(":")
    first, _, last = span.replace(",", "").partition("-")
    if not chrom or not first.isdecimal() or not last.isdecimal() or not 1 <= int(first) <= int(last):
        raise Violation(f"{region} isn't chrom:start-end")
    return chrom, int(first) - 1, int(last)


def write_sites(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """``rows`` (chrom, pos and more) as files sorted by place in ``path``/sites, and what each file holds in ``path``/manifest.

    Files hold neighbouring ranges. The manifest comes last, so a folder without one isn't whole. Rows without a place can't be
    found by region, so they raise.
    """
    placed = rows.withColumn("chrom", F.when(F.col("chrom").isNull() | F.col("pos").isNull(), F.raise_error(F.lit("a site lacks its place"))).otherwise(F.col("chrom")))
    placed.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.option("maxRecordsPerFile", file_rows).option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/sites")
    whole = rows.sparkSession.read.parquet(f"{path}/sites")
    held = whole.groupBy(F.col("_metadata.file_name").alias("file"), "chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
    held.coalesce(1).write.parquet(f"{path}/manifest")


def files_of(spark: SparkSession, path: str, region: str) -> list[str]:
    """Files of a folder of ``write_sites`` that hold sites within the bounds of a region."""
    chrom, lo, hi = parse_span(region)
    held = spark.read.parquet(f"{path}/manifest").where((F.col("chrom") == chrom) & (F.col("lo") < hi) & (F.col("hi") >= lo))
    return sorted(r["file"] for r in held.select("file").distinct().collect())


def read_sites(spark: SparkSession, path: str, region: str) -> DataFrame:
    """The sites of a region, from those files alone that hold any; inside them row groups go by their bounds."""
    chrom, lo, hi = parse_span(region)
    files = files_of(spark, path, region)
    rows = spark.read.parquet(*[f"{path}/sites/{f}" for f in files]) if files else spark.read.parquet(f"{path}/sites").limit(0)
    return rows.where((F.col("chrom") == chrom) & (F.col("pos") >= lo) & (F.col("pos") < hi))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each run of equal chromosomes of a file's block. Where a block returns to a chromosome, the run before counts as not ascending."""
    last, known, nth = None, set(), 0

    def row():
        return dict(zip(("file", "block", "nth", "chrom", "first", "last", "ascending"), last))

    for x in batches:
        if not len(x):
            continue
        keys = x[["file", "block", "chrom"]]
        cuts = np.flatnonzero(np.r_[True, (keys.values[1:] != keys.values[:-1]).any(axis=1)])
        pos, out = x["pos"].to_numpy(), []
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            file, block, chrom = keys.iloc[a]
            here, rising = pos[a:b], bool((np.diff(pos[a:b]) >= 0).all())
            if last is not None and last[:2] == [file, block]:
                if last[3] == chrom:
                    last[5:] = [here[-1], last[6] and rising and here[0] >= last[5]]
                    continue
                if chrom in known:  # seen before in this block: the order is broken, which one row says
                    last[6] = False
                    continue
                nth += 1
            else:
                known, nth = set(), 0
            if last is not None:
                out.append(row())
            known.add(chrom)
            last = [file, block, nth, chrom, here[0], here[-1], rising]
        if out:
            yield pd.DataFrame(out)
    if last is not None:
        yield pd.DataFrame([row()])


def order_faults(rows: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """(file, chrom, fault) of files whose positions descend within a chromosome ("unsorted") or whose chromosome comes back ("apart").

    A chromosome that comes back within one block is told as a fault of the one before it.

    ``rows`` come straight from files. Each task reads its blocks once, in order, and tells of each run of a chromosome its
    first and last position; only these few rows are shuffled. Null places count as faults.
    """
    placed = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.coalesce(chrom, F.lit("")).alias("chrom"), F.coalesce(F.col(pos).cast("long"), F.lit(-1)).alias("pos"))
    runs = placed.mapInPandas(_runs, "file string, block long, nth long, chrom string, first long, last long, ascending boolean")
    by = Window.partitionBy("file").orderBy("block", "nth")
    joined = runs.withColumns({"_chrom": F.lag("chrom").over(by), "_last": F.lag("last").over(by)})
    goes_on = F.col("chrom").eqNullSafe(F.col("_chrom"))
    bad = ~F.col("ascending") | (goes_on & (F.col("first") < F.col("_last"))) | (F.col("chrom") == "") | (F.col("first") < 0)
    per = joined.groupBy("file", "chrom").agg(F.max(bad).alias("bad"), F.sum(F.when(goes_on, 0).otherwise(1)).alias("starts"))
    fault = F.when(F.col("bad"), "unsorted").when(F.col("starts") > 1, "apart")
    return per.select("file", "chrom", fault.alias("fault")).where("fault IS NOT NULL")


def check_sorted(rows: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """``rows``, read straight from files, unchanged; raises Violation where ``order_faults`` finds one in a file."""
    if found := order_faults(rows, chrom, pos).limit(1).collect():
        raise Violation(f"{found[0]['file']}: {found[0]['chrom']} is {found[0]['fault']}")
    return rows
