"""Readers of the text and JSON inputs. All declare their schema and check their constraints in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.expect import Violation, expect
from spotframe.functions.columns import pad_pair, split_pair
from spotframe.sources.sites import check_sorted, parse_span


def _csv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t", comment: str | None = None) -> DataFrame:
    out = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST").option("encoding", "UTF-8")
    return (out.option("comment", comment) if comment else out).csv(path)


def without_mark(df: DataFrame) -> DataFrame:
    """Column names and texts without a byte order mark and outer blanks."""
    out = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return out.withColumns({f.name: F.trim(F.regexp_replace(f.name, "^﻿", "")) for f in out.schema if f.dataType.simpleString() == "string"})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, line) of a text file; an empty file or a blank line is an error. Positions follow the file's order."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), F.col("value").alias("line"))
    return expect(rows, not_empty=True, not_blank=F.trim("line") != "")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, feature_name, feature_type of a headerless table; ids are non-empty and unique."""
    rows = _csv(spark, path, "feature_id string, feature_name string, feature_type string")
    return expect(rows, unique=[["feature_id"]], id_given=F.coalesce(F.trim("feature_id"), F.lit("")) != "")


def read_positions(spark: SparkSession, path: str, in_tissue_only: bool = False) -> DataFrame:
    """Spot positions; array coordinates stay text, with whole numbers in array_row_n and array_col_n."""
    rows = _csv(spark, path, "barcode string, in_tissue string, array_row string, array_col string, pxl_row_in_fullres string, pxl_col_in_fullres string", header=True)
    whole = {c: F.expr(f"try_cast({c} AS INT)") for c in ("in_tissue", "pxl_row_in_fullres", "pxl_col_in_fullres")}
    rows = rows.withColumns(whole).withColumns({f"{c}_n": F.expr(f"try_cast({c} AS INT)") for c in ("array_row", "array_col")})
    rows = expect(rows, unique=[["barcode"], ["array_row_n", "array_col_n"]], in_tissue=F.col("in_tissue").isin(0, 1), rows_whole=F.col("array_row_n").isNotNull(), cols_whole=F.col("array_col_n").isNotNull(), pixels=F.col("pxl_row_in_fullres").isNotNull() & F.col("pxl_col_in_fullres").isNotNull())
    if not in_tissue_only:
        return rows
    return expect(rows.where("in_tissue = 1"), not_empty=True)


def read_matrix_market(spark: SparkSession, path: str, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(i, j, value) of a coordinate file, 1-based, repeated cells summed; the declared shape must be the given one."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    part = F.split(F.trim("value"), r"\s+")
    cells = lines.select(F.try_element_at(part, F.lit(1)).cast("long").alias("i"), F.try_element_at(part, F.lit(2)).cast("long").alias("j"), F.coalesce(F.try_element_at(part, F.lit(3)), F.lit("1")).cast("double").alias("value"), F.monotonically_increasing_id().alias("_at"))
    head = cells.orderBy("_at").limit(1).first()
    if head is None or (n_rows is not None and head["i"] != n_rows) or (n_cols is not None and head["j"] != n_cols):
        raise Violation(f"the declared shape is {head and (head['i'], head['j'])}, not {(n_rows, n_cols)}")
    out = cells.where(F.col("_at") != head["_at"]).drop("_at")
    inside = F.col("i").between(1, head["i"]) & F.col("j").between(1, head["j"])
    out = expect(out, inside_shape=inside, finite=~F.isnan("value") & (F.abs("value") < float("inf")))
    return out.groupBy("i", "j").agg(F.sum("value").alias("value"))


def read_value_mask(spark: SparkSession, path: str, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(i, j) of observed cells; the file holds only 0 and 1."""
    cells = expect(read_matrix_market(spark, path, n_rows, n_cols), zero_or_one=F.col("value").isin(0.0, 1.0))
    return cells.where("value = 1").select("i", "j")


COVERAGE = "chrom string, start long, end long, percent double, methylated long, unmethylated long, spot string"


def read_coverage(spark: SparkSession, path: str, base: int = 1, ordered: bool = False) -> DataFrame:
    """Coverage rows as chrom, pos (0-based), pct, meth, unmeth, spot. ``base``: where the file starts counting.

    With ``ordered`` each file must be sorted, its chromosomes in one piece each.
    """
    rows = _csv(spark, path, COVERAGE)
    if ordered:
        check_sorted(rows, pos="start")
    rows = expect(rows, chrom=F.col("chrom").isNotNull(), single=(F.col("start") == F.col("end")) & (F.col("start") >= base), percent=F.col("percent").between(0, 100), counts=(F.col("methylated") >= 0) & (F.col("unmethylated") >= 0))
    return rows.select("chrom", (F.col("start") - base).alias("pos"), F.col("percent").alias("pct"), F.col("methylated").alias("meth"), F.col("unmethylated").alias("unmeth"), "spot")


def read_region(rows: DataFrame, region: str) -> DataFrame:
    """(spot, site_count, percent) of the sites inside ``chrom:start-end``, 1-based and inclusive."""
    chrom, lo, hi = parse_span(region)
    inside = rows.where((F.col("chrom") == chrom) & (F.col("pos") >= lo) & (F.col("pos") < hi))
    return inside.groupBy("spot").agg(F.count("*").alias("site_count"), (100 * F.sum("meth") / F.nullif(F.sum(F.col("meth") + F.col("unmeth")), F.lit(0))).alias("percent"))


def gtf_attribute(name: str) -> Column:
    """The value of a quoted attribute of a GTF row, null where it is missing."""
    return F.nullif(F.regexp_extract("attr", rf'(?:^|;)\s*{name} "([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("gene",), require: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """GTF rows of the given features as 0-based, half-open intervals; gene_name falls back to gene_id."""
    rows = _csv(spark, path, "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attr string", comment="#").where(F.col("feature").isin(*features))
    out = rows.select("chrom", (F.col("start") - 1).alias("lo"), F.col("end").alias("hi"), "strand", F.col("feature").alias("kind"), gtf_attribute("gene_id").alias("gene_id"), gtf_attribute("gene_name").alias("name"), gtf_attribute("gene_type").alias("gene_type"), gtf_attribute("transcript_id").alias("transcript_id"))
    out = out.withColumn("gene_name", F.coalesce("name", "gene_id")).drop("name")
    return expect(out, not_empty=True, unique=[["gene_id"]] if features == ("gene",) else [], strand=F.col("strand").isin("+", "-"), length=F.col("hi") > F.col("lo"), **{c: F.col(c).isNotNull() for c in require})


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, lo, hi, region ("chrom:lo-hi") and width of a BED file, unique."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)|^$")).select(part[0].alias("chrom"), F.try_element_at(part, F.lit(2)).cast("long").alias("lo"), F.try_element_at(part, F.lit(3)).cast("long").alias("hi"))
    rows = rows.withColumn("region", F.concat_ws("", "chrom", F.lit(":"), "lo", F.lit("-"), "hi")).withColumn("width", F.col("hi") - F.col("lo"))
    return expect(rows, unique=[["region"]], bounds=(F.col("lo") >= 0) & (F.col("hi") > F.col("lo")))


def parse_regions(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with chrom, lo, hi of ids ``chrom:start-end``; other ids and empty intervals are errors."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    out = rows.withColumn("chrom", F.regexp_extract(column, pattern, 1)).withColumns({"lo": F.expr(f"try_cast(regexp_extract(`{column}`, '{pattern}', 2) AS BIGINT)"), "hi": F.expr(f"try_cast(regexp_extract(`{column}`, '{pattern}', 3) AS BIGINT)")})
    return expect(out, form=F.col(column).rlike(pattern), length=F.col("hi") > F.col("lo"))


def read_json_number(spark: SparkSession, path: str, field: str, low: float, high: float) -> float:
    """A number at a dotted path of a JSON file; missing, not a number (booleans included) or out of range is an error."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{field}").alias("x")).first()
    row = spark.range(1).select(F.expr(f"try_cast({_quoted(text['x'] if text else None)} AS DOUBLE)").alias("x")).first()
    if row["x"] is None or not low <= row["x"] <= high:
        raise Violation(f"{field}: {text and text['x']!r} isn't a number from {low} to {high}")
    return row["x"]


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(pair, row_offset, col_offset, degrees) of a registration file keyed ``moving_to_reference``; all must be given."""
    kind = "map<string, struct<row_offset_fullres_pixels: double, col_offset_fullres_pixels: double, rotation_degrees: double>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("pair", "x"))
    out = rows.select("pair", F.col("x.row_offset_fullres_pixels").alias("row_offset"), F.col("x.col_offset_fullres_pixels").alias("col_offset"), F.col("x.rotation_degrees").alias("degrees"))
    return expect(out, not_empty=True, given=F.col("row_offset").isNotNull() & F.col("col_offset").isNotNull() & F.col("degrees").isNotNull())


def read_table(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t", key: list[str] | None = None, **rules: Column) -> DataFrame:
    """The named columns of a table with a header, cast where they can be; required columns, keys and rules are checked."""
    raw = without_mark(spark.read.option("sep", sep).option("header", True).csv(path))
    if missing := [c for c in columns if c not in raw.columns]:
        raise Violation(f"missing columns: {', '.join(missing)}")
    out = raw.select(*[F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in columns.items()])
    return expect(out, unique=[key] if key else [], **rules)


def read_wide(spark: SparkSession, path: str, ids: list[str], prefix: str, sep: str = ",") -> DataFrame:
    """Long form (ids, name, value) of the columns ``prefix``N, in the order of N; each row's values must sum to 1."""
    raw = without_mark(spark.read.option("sep", sep).option("header", True).csv(path))
    names = sorted((c for c in raw.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    if not names:
        raise Violation(f"no column {prefix}N")
    rows = raw.select(*ids, *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in names])
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return expect(rows, unique=[ids], sums=F.abs(total - 1) <= 1e-6).unpivot(ids, names, "name", "value")


def read_pairs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Two-column correspondence of ids ``row_col``, written anew with two digits each; one to one."""
    out = read_table(spark, path, {first: "string", second: "string"})
    out = expect(out, form=F.col(first).rlike(r"^\d+_\d+$") & F.col(second).rlike(r"^\d+_\d+$"))
    padded = {c: pad_pair(split_pair(F.col(c))["row"], split_pair(F.col(c))["col"]) for c in (first, second)}
    return expect(out.withColumns(padded), unique=[[first], [second]])


def read_samples(spark: SparkSession, pattern: str, schema: str, name: str, sep: str = ",") -> DataFrame:
    """All files of a wildcard with ``sample`` from the file's name by the regex ``name``."""
    rows = spark.read.schema(schema).option("sep", sep).option("header", True).csv(pattern)
    return rows.withColumn("sample", F.regexp_extract(F.col("_metadata.file_name"), name, 1))
