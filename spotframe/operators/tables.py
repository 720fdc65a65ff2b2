"""Table operators: bins, dense groups, ranks, set operations, lists and status ladders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.expect import Violation, expect
from spotframe.functions.columns import divide
from spotframe.staging import broadcast_if_small


def bin_rates(sites: DataFrame, width: int, spot: str | None = None) -> DataFrame:
    """Per genome bin: rows, mean of percentages, and coverage-weighted rate. ``sites``: chrom, pos, pct, meth, unmeth."""
    keys = ["chrom", (F.floor(F.col("pos") / width) * width).cast("long").alias("bin"), *([spot] if spot else [])]
    out = sites.groupBy(*keys).agg(F.count("*").alias("n_sites"), F.sum("pct").alias("_pct"), F.sum("meth").alias("meth"), F.sum("unmeth").alias("unmeth"))
    return out.withColumn("mean_rate", divide(F.col("_pct"), F.col("n_sites") * 100)).withColumn("weighted_rate", divide(F.col("meth"), F.col("meth") + F.col("unmeth"))).drop("_pct")


def outer_pair(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_1", "_2")) -> DataFrame:
    """Full outer join; other columns take suffixes."""
    a = left.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in keys])
    return a.join(b, keys, "full_outer")


def pair_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only in the first, only in the second."""
    sides = left.select(key, F.lit(1).alias("side")).distinct().union(right.select(key, F.lit(2).alias("side")).distinct()).groupBy(key).agg(F.bit_or("side").alias("sides"))
    return sides.agg(*[F.count_if(F.col("sides") == k).alias(name) for k, name in ((3, "n_both"), (1, "n_only_1"), (2, "n_only_2"))])


def state_detail(sites: DataFrame, states: DataFrame, spots: DataFrame, spot: str = "spot") -> DataFrame:
    """Per spot and state: matched sites and their mean rate; every pair is there, null rate where none matches."""
    dims = spots.select(spot).distinct().crossJoin(broadcast_if_small(states.select("state").distinct()))
    found = sites.join(states, ["chrom", "pos"]).groupBy(spot, "state").agg(F.count("*").alias("n"), F.sum("pct").alias("s"))
    out = dims.join(found, [spot, "state"], "left")
    return out.select(spot, "state", F.coalesce("n", F.lit(0)).alias("site_count"), divide(F.col("s"), F.col("n") * 100).alias("rate"), F.coalesce("s", F.lit(0)).alias("pct_sum"))


def support_threshold(detail: DataFrame, spot: str, least_total: int, least_each: int) -> DataFrame:
    """Rows of spots with enough sites in all, then those with enough sites themselves."""
    total = F.sum("site_count").over(Window.partitionBy(spot))
    return detail.withColumn("total_sites", total).where((F.col("total_sites") >= least_total) & (F.col("site_count") >= least_each))


def state_summary(detail: DataFrame, spots: DataFrame, spot: str, group: str, least_each: int) -> DataFrame:
    """Per group and state, empty pairs included: passing spots, their sites and the pooled rate."""
    dims = spots.select(group).distinct().crossJoin(broadcast_if_small(detail.select("state").distinct()))
    found = detail.where(F.col("site_count") >= least_each).join(spots.select(spot, group), spot).groupBy(group, "state").agg(F.count("*").alias("n"), F.sum("site_count").alias("c"), F.sum("pct_sum").alias("s"))
    out = dims.join(found, [group, "state"], "left")
    return out.select(group, "state", F.coalesce("n", F.lit(0)).alias("n_spots"), F.coalesce("c", F.lit(0)).alias("n_sites"), divide(F.col("s"), F.col("c") * 100).alias("pooled_rate"))


def dense_means(rows: DataFrame, keys: dict[str, DataFrame], value: str) -> DataFrame:
    """Mean of ``value`` for every combination of the keys' members; combinations without rows have count 0."""
    dims = reduce(lambda a, b: a.crossJoin(broadcast_if_small(b)), [d.select(k).distinct() for k, d in keys.items()])
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    return dims.join(found, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("n"), divide(F.col("_s"), F.col("_n")).alias("mean"))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_k(rows, keys, order, 1, "_first").drop("_first")


def relabel_by_size(members: DataFrame, node: str, label: str) -> DataFrame:
    """Labels renumbered from 0 by size, larger first, then by least member."""
    sizes = members.groupBy(label).agg(F.count("*").alias("_n"), F.min(node).alias("_m"))
    new = sizes.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("_n"), "_m")) - 1).cast("long")).select(label, "cluster")
    return members.join(new, label).select(node, "cluster")


def in_all(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Keys that occur with every distinct member."""
    n = rows.agg(F.count_distinct(member).alias("_all"))
    return rows.groupBy(key).agg(F.count_distinct(member).alias("_n")).crossJoin(F.broadcast(n)).where("_n = _all").select(key)


def one_annotation(rows: DataFrame, key: str, sample: str, annotation: str) -> DataFrame:
    """(key, annotation, n_samples) over all samples; raises where samples annotate a key differently."""
    out = rows.groupBy(key).agg(F.count_distinct(annotation).alias("_kinds"), F.min(annotation).alias(annotation), F.count_distinct(sample).alias("n_samples"))
    if not out.where("_kinds > 1").isEmpty():
        raise Violation(f"{key}: annotations differ between samples")
    return out.drop("_kinds")


def outer_union(rows: DataFrame, key: str, sample: str, annotation: str, value: str) -> DataFrame:
    """(sample, key, annotation, value): for each sample every key of any sample, its summed value or 0.

    Raises where samples annotate a key differently.
    """
    keys = one_annotation(rows, key, sample, annotation).drop("n_samples")
    found = rows.groupBy(sample, key).agg(F.sum(value).alias(value))
    dims = keys.crossJoin(broadcast_if_small(rows.select(sample).distinct()))
    return dims.join(found, [sample, key], "left").select(sample, key, annotation, F.coalesce(value, F.lit(0)).alias(value))


def inner_concat(rows: DataFrame, key: str, sample: str, annotation: str) -> DataFrame:
    """The rows whose key occurs in every sample; raises where samples annotate a common key differently, or share none."""
    common = in_all(rows, key, sample)
    out = rows.join(common, key, "left_semi")
    if one_annotation(out, key, sample, annotation).isEmpty():
        raise Violation(f"{key}: the samples share none")
    return out


def shared_rows(rows: DataFrame, key: str, sample: str, columns: list[str]) -> DataFrame:
    """(key, columns) of the keys that occur in every sample; raises where samples give a shared key different columns.

    A null and a value differ. Keys that some sample lacks may differ.
    """
    shared = rows.join(in_all(rows, key, sample), key, "left_semi")
    return expect(shared.select(key, *columns).distinct(), unique=[[key]])


def membership_counts(rows: DataFrame, key: str, sets: list[Column]) -> DataFrame:
    """(mask, n): how many keys belong to exactly the sets whose bits the mask holds."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(s, F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(sets)])
    return rows.select(key, bits.alias("bit")).groupBy(key).agg(F.bit_or("bit").alias("mask")).groupBy(F.col("mask").cast("long").alias("mask")).agg(F.count("*").alias("n"))


def cross_table(rows: DataFrame, row: str, col: str, cols: list) -> DataFrame:
    """Counts of each pair; columns n_<value> for the given values."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(col) == c).alias(f"n_{c}") for c in cols])


def unpivot_rates(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Long form: ids, context, rate."""
    return rows.unpivot(ids, values, "context", "rate")


def complete_cases(rows: DataFrame, columns: list[str], reads: str, least: int) -> DataFrame:
    """Rows without nulls in ``columns`` and with enough reads."""
    return rows.dropna(subset=columns).where(F.col(reads) >= least)


def explode_list(rows: DataFrame, column: str, item: str, sep: str = ";") -> DataFrame:
    """One row per item of a delimited list, with its position from 0; empty lists give no row."""
    parts = F.filter(F.transform(F.split(column, sep), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("*", F.posexplode(parts).alias("position", item))


def linked_status(links: DataFrame, genes: DataFrame, item: str, key: str) -> DataFrame:
    """``links`` with status: linked where the item is a known key, else missing."""
    known = genes.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    return links.join(known, F.col(item) == F.col("_k"), "left").withColumn("status", F.when(F.col("_known"), "linked").otherwise("missing")).drop("_k", "_known")


def row_fractions(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Share of each value in its group's sum; null where the sum is 0."""
    return rows.withColumn("fraction", divide(F.col(value), F.sum(value).over(Window.partitionBy(*group))))


def status_ladder(rows: DataFrame, rungs: list[tuple[Column, str]], start: str) -> DataFrame:
    """``status``: the name of the last rung whose condition holds, else ``start``."""
    status = F.lit(start)
    for condition, name in rungs:
        status = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(status)
    return rows.withColumn("status", status)


def downsample(rows: DataFrame, label: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each label, those of least seeded hash; the same rows at every run."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def complex_percent(counts: DataFrame, n_spots: int, gene: str, members: DataFrame, unit: str) -> DataFrame:
    """Percentage of spots that express each unit: the least over its genes, 0 if one has no feature.

    ``members``: (unit, gene), the gene null where it isn't mapped.
    """
    each = counts.where("n > 0").groupBy(gene).agg((100.0 * F.count("*") / n_spots).alias("_p"))
    out = members.join(each, gene, "left")
    return out.groupBy(unit).agg(F.min(F.when(F.col(gene).isNull(), 0.0).otherwise(F.coalesce("_p", F.lit(0.0)))).alias("percent"))
