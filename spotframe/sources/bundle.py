"""Bundles of tables on Parquet, and text sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.expect import Violation, expect
from spotframe.functions.columns import pad_pair


@dataclass
class Bundle:
    """An annotated matrix: cells, spots, features, and named embeddings, loadings and graphs."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _into(spark: SparkSession, folder: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside ``folder``, which then takes its name; an existing one is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(folder)
    parent, _, name = folder.rstrip("/").rpartition("/")
    path = f"{parent}/.{name}-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        write(path)
        if not fs.rename(own, target):
            raise OSError(f"{path} can't be renamed to {folder}")
    except BaseException:
        fs.delete(own, True)
        raise


def write_bundle(spark: SparkSession, bundle: Bundle, folder: str) -> None:
    """Write all tables and the manifest beside ``folder``, then rename them there; an existing bundle is an error.

    If a table fails, what has been written is removed.
    """

    def write(path: str) -> None:
        for name, df in bundle.tables.items():
            df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
        manifest = {"tables": sorted(bundle.tables), "meta": bundle.meta}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.text(f"{path}/_manifest")

    _into(spark, folder, write)


def read_bundle(spark: SparkSession, folder: str, names: list[str] | None = None) -> Bundle:
    """A bundle's tables, lazily; only the named ones, and only columns that a plan asks for, are read."""
    manifest = json.loads(spark.read.text(f"{folder}/_manifest").first()["value"])
    wanted = manifest["tables"] if names is None else names
    if missing := set(wanted) - set(manifest["tables"]):
        raise KeyError(f"no table {sorted(missing)} in {folder}")
    return Bundle({n: spark.read.parquet(f"{folder}/{n}") for n in wanted}, manifest["meta"])


def write_gene_bins(rows: DataFrame, folder: str) -> None:
    """Gene-bin rates as zstd Parquet, in ranges of genes, rows sorted by gene, spot and bin."""
    out = rows.repartitionByRange("gene").sortWithinPartitions("gene", "spot", "bin")
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": 3, "parquet.block.row.count.limit": 100_000}
    _into(rows.sparkSession, folder, lambda path: out.write.options(**options).parquet(path))


def write_delimited(rows: DataFrame, folder: str, sep: str = "\t", compressed: bool = False, digits: int | None = None) -> None:
    """Delimited text with a header; doubles with a fixed number of digits where asked for."""
    if digits is not None:
        rows = rows.select(*[F.format_string(f"%.{digits}f", f.name).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema])
    out = rows.write.option("sep", sep).option("header", True)
    _into(rows.sparkSession, folder, (out.option("compression", "gzip") if compressed else out).csv)


def write_factors(usages: DataFrame, loadings: DataFrame, k: int, folder: str) -> None:
    """Factors (id, vec of k values) as two tables of text, usages and loadings, a column for each pattern."""

    def write(path: str) -> None:
        for name, factor in (("usages", usages), ("loadings", loadings)):
            wide = factor.select("id", *[F.col("vec")[i].alias(f"pattern_{i + 1}") for i in range(k)])
            wide.write.option("header", True).csv(f"{path}/{name}")

    _into(usages.sparkSession, folder, write)


def write_statistics(spark: SparkSession, values: dict, folder: str) -> None:
    """One JSON object; values that JSON doesn't know are an error."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("errorifexists").text(folder)


def read_cached(spark: SparkSession, folder: str, column: str, make) -> DataFrame:
    """A detail table from ``folder`` if it exists and has ``column``; else ``make()``, written there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = spark.read.parquet(folder)
        if column in rows.columns:
            return rows
    make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def aligned(bundle: Bundle, modalities: list[str], reference: str, least: int = 3, table: str = "spots", key: str = "spot", position: str = "position") -> Bundle:
    """``bundle``, if each modality's table "<modality>_<table>" holds the reference's spots at the same positions.

    At least ``least`` spots must be there, each once.
    """
    if missing := [m for m in dict.fromkeys([reference, *modalities]) if f"{m}_{table}" not in bundle.tables]:
        raise Violation(f"missing modalities: {', '.join(missing)}")
    own = bundle[f"{reference}_{table}"].select(key, position)
    expect(own, unique=[[key], [position]], given=F.col(key).isNotNull() & F.col(position).isNotNull())
    if own.limit(least).count() < least:
        raise Violation(f"fewer than {least} spots")
    for m in modalities:
        rows = bundle[f"{m}_{table}"].select(key, position)
        both = own.withColumn("_side", F.lit(1)).union(rows.withColumn("_side", F.lit(2)))
        apart = both.groupBy(key, position).agg(F.count("*").alias("_n"), F.count_distinct("_side").alias("_sides")).where("_n <> 2 OR _sides <> 2")
        if unlike := apart.limit(3).collect():
            raise Violation(f"{m} isn't aligned with {reference}: {[r[key] for r in unlike]}")
    return bundle


def write_spots(rows: DataFrame, folder: str, spot: str, label: str, name: str = "cluster", more: list[str] = (), grid: tuple[str, str] | None = None) -> None:
    """A table of spots: barcode, those columns of ``more`` that exist, the label under ``name``.

    With ``grid`` (row, col), the barcode is RR_CC of these columns. Spots are single.
    """
    ident = pad_pair(F.col(grid[0]).cast("int"), F.col(grid[1]).cast("int")) if grid else F.col(spot).cast("string")
    out = rows.select(ident.alias("barcode"), *[c for c in more if c in rows.columns], F.col(label).alias(name))
    write_delimited(expect(out, unique=[["barcode"]], given=F.col("barcode").isNotNull()), folder, sep=",")
