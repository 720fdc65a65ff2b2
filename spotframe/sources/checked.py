"""Readers of tables with a meaning of their own, which they check: summaries, thresholds, pairs, labels, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.expect import Violation, expect, in_range, require_same_ids
from spotframe.sources.readers import read_table


def not_blank(name: str):
    return F.col(name).isNotNull() & (F.trim(name) != "")


def read_rates(spark: SparkSession, path: str, fields: dict[str, str]) -> dict[str, float]:
    """{name: percentage} of the columns ``fields`` {name: column} in a summary of exactly one row; from 0 to 100, finite."""
    rows = read_table(spark, path, {c: "double" for c in fields.values()})
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise Violation(f"{path}: one row expected, not {'none' if not found else 'several'}")
    expect(rows, **{c: in_range(F.col(c), 0.0, 100.0) for c in fields.values()})
    return {name: found[0][c] for name, c in fields.items()}


def read_threshold(spark: SparkSession, path: str, field: str = "reads_threshold") -> float:
    """The number above 0 in the first row of a table; later rows don't count."""
    row = read_table(spark, path, {field: "double"}).first()
    if row is None or row[field] is None or not 0 < row[field] < float("inf"):
        raise Violation(f"{path}: {field} must be a finite number above 0")
    return row[field]


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    """(spot, reads, depth, site_count) of a histogram of depths; depths and counts above 0, one number of reads a spot."""
    rows = read_table(spark, path, {"spot": "string", "reads": "long", "depth": "long", "site_count": "long"})
    expect(rows, not_empty=True, spot=not_blank("spot"), reads=F.col("reads") >= 0, depth=F.col("depth") > 0, site_count=F.col("site_count") > 0)
    unlike = rows.groupBy("spot").agg(F.min("reads").alias("least"), F.max("reads").alias("most")).where("least <> most").first()
    if unlike:
        raise Violation(f"reads of spot {unlike['spot']} differ: {unlike['least']} and {unlike['most']}")
    return rows


def read_correspondence(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The id columns of a table that matches spots of several assays one to one; no id is blank or stands twice in its column."""
    rows = read_table(spark, path, {c: "string" for c in columns})
    return expect(rows, unique=[[c] for c in columns], not_empty=True, **{f"{c} given": not_blank(c) for c in columns})


PAIR_COLUMNS = ("lr_pair", "ligand_gene_symbols", "receptor_gene_symbols", "ligand_ensembl_ids", "receptor_ensembl_ids")


def read_pair_database(spark: SparkSession, path: str) -> DataFrame:
    """(pair, ligand, receptor, ligand_ids, receptor_ids, complex) of a comma-separated list of ligands and receptors.

    A pair is named by its symbols, ligand first, with a blank between; several symbols or ids are parted by semicolons.
    """
    pair, ligand, receptor, ligand_ids, receptor_ids = PAIR_COLUMNS
    rows = read_table(spark, path, {c: "string" for c in PAIR_COLUMNS}, sep=",")
    named = {f"{c} given": not_blank(c) for c in (pair, ligand, receptor)}
    expect(rows, not_empty=True, **named, name=F.col(pair) == F.concat_ws(" ", ligand, receptor))
    several = F.col(ligand).contains(";") | F.col(receptor).contains(";")
    return rows.select(F.col(pair).alias("pair"), F.col(ligand).alias("ligand"), F.col(receptor).alias("receptor"), F.col(ligand_ids).alias("ligand_ids"), F.col(receptor_ids).alias("receptor_ids"), several.alias("complex"))


def read_labels(spark: SparkSession, path: str, observed: DataFrame, key: str = "cluster", label: str = "annotation") -> DataFrame:
    """(key, label) for exactly the ids that ``observed`` (key) holds; none is labelled twice or with a blank."""
    rows = read_table(spark, path, {key: "string", label: "string"}, sep=",")
    rows = rows.select(F.trim(key).alias(key), F.trim(label).alias(label))
    expect(rows, unique=[[key]], **{f"{key} given": not_blank(key), f"{label} given": not_blank(label)})
    require_same_ids(rows, observed.select(F.col(key).cast("string").alias(key)).distinct(), key)
    return rows


def read_weights(spark: SparkSession, metadata: str, weights: str, types: list[str], key: str = "barcode", more: dict[str, str] | None = None) -> DataFrame:
    """Spots of a metadata table with the weights of ``types``; both tables hold the same ids, once each, none blank.

    ``more``: columns of the metadata with their types. A weight may be missing.
    """
    rule = {f"{key} given": not_blank(key)}
    left = read_table(spark, metadata, {key: "string"} | (more or {}), sep=",", key=[key], **rule)
    right = read_table(spark, weights, {key: "string"} | {t: "double" for t in types}, sep=",", key=[key], **rule)
    expect(left, not_empty=True)
    require_same_ids(left, right, key)
    return left.join(right, key)


MARKER_COLUMNS = {"cluster": "string", "modality": "string", "marker_type": "string", "rank": "int", "feature_id": "string", "feature_name": "string", "direction": "string"}


def read_markers(spark: SparkSession, path: str, cluster: str | None = None) -> DataFrame:
    """Markers as they were written, of one cluster if asked for; ranks count from 1 and are single in cluster, modality and type."""
    rows = read_table(spark, path, MARKER_COLUMNS)
    expect(rows, unique=[["cluster", "modality", "marker_type", "rank"]], rank=F.col("rank") >= 1, feature=not_blank("feature_id"))
    if cluster is None:
        return rows
    return expect(rows.where(F.col("cluster") == cluster), not_empty=True)


def discover_samples(spark: SparkSession, folders: list[str], files: dict[str, str]) -> list[dict[str, str]]:
    """For each sample's folder {sample: its name, and a path for each of ``files`` {name: place inside}}; all must exist."""
    out: list[dict[str, str]] = []
    for folder in folders:
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        paths = {name: f"{folder.rstrip('/')}/{inside}" for name, inside in files.items()}
        lacking = [p for p in paths.values() if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
        if lacking:
            raise FileNotFoundError(f"sample {root.getName()} lacks {', '.join(lacking)}")
        if any(s["sample"] == root.getName() for s in out):
            raise Violation(f"two samples are named {root.getName()}")
        out.append({"sample": root.getName()} | paths)
    return out
