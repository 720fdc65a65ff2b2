"""Written tables that cut lineage, checked broadcasts, and sums over rows in order without one task for all."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.expect import Violation

#: Rows up to which a side may be broadcast; beyond it Spark's own shuffled joins are used.
BROADCAST_ROWS = 100_000

_own_folder: list[str] = []
_staged: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a session in one process takes a folder of its own.

    Executors on other machines would not see such a folder, so a session on a cluster raises an error instead.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise Violation("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spotframe-"))
    return _own_folder[0]


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.add(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _staged.discard(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_staged):
        try:
            remove_folder(spark, path)
        except Exception:  # the session may have ended
            return


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where a staged table has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """For each {value column: new column}: the sum over all rows before each row in the order of ``order``.

    Rows are range-partitioned and staged; only one total per partition meets in one place. Rows equal
    in ``order`` are taken one after another in any order. Nulls come first; a null value counts as 0.
    """
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), *order)
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranged")
    filled = {v: F.coalesce(F.col(v), F.lit(0)).cast("long") for v in values}
    totals = ranged.groupBy("_part").agg(*[F.sum(x).alias(f"_t_{v}") for v, x in filled.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_l_{v}") for v, x in filled.items()])
    out = local.join(F.broadcast(bases), "_part").withColumns({new: (F.col(f"_b_{v}") + F.col(f"_l_{v}")).cast("long") for v, new in values.items()})
    return out.drop("_part", "_row", *[f"_{x}_{v}" for x in "bl" for v in values])
