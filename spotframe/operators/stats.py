"""Statistics: multiple testing, rank sums, Welch tests, correlations, thresholds, saturation and variance shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.expect import expect
from spotframe.functions.columns import divide, unseen_share
from spotframe.operators.tables import top_k
from spotframe.staging import running_start


def adjust_bh(rows: DataFrame, group: list[str], p: str, key: list[str], out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg within each group over non-null p: cumulative least of p * n / rank from the largest p down."""
    valid = rows.where(F.col(p).isNotNull())
    n = F.count("*").over(Window.partitionBy(*group))
    valid = valid.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(p, *key))).withColumn("_q", F.least(F.lit(1.0), F.col(p) * n / F.col("_r")))
    down = Window.partitionBy(*group).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    valid = valid.withColumn(out, F.min("_q").over(down)).drop("_r", "_q")
    return valid.unionByName(rows.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after shifting x above 8."""
    x, shift = np.asarray(x, float).copy(), np.zeros_like(np.asarray(x, float))
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    inv = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / x


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's t: the regularised incomplete beta at df / (df + t^2) by its continued fraction."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    a, b, x = df / 2, np.full_like(df, 0.5), df / (df + t * t)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        cum = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.clip(np.where(flip, 1 - cum, cum), 0.0, 1.0)


def t_p_value(t: str, df: str) -> Column:
    """Two-sided p of Student's t; null in, null out."""

    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna()
        out = pd.Series(np.nan, index=t.index)
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
        return out.astype(object).where(ok, None)

    run.__annotations__ = {"t": pd.Series, "df": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(t, df)


# Coefficients of the expansion of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a standard normal, by the rational expansion of the complementary error function (error < 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def group_moments(observed: DataFrame, spots: DataFrame, spot: str, feature: str, group: str, value: str) -> DataFrame:
    """(feature, group, n1, s1, q1, n0, s0, q0): counts, sums and sums of squares inside and outside each group.

    The outside is the total minus the inside, so values are read once.
    """
    rows = observed.join(spots.select(spot, group), spot)
    x = F.col(value)
    inside = rows.groupBy(feature, group).agg(F.count("*").alias("n1"), F.sum(x).alias("s1"), F.sum(x * x).alias("q1"))
    all_ = Window.partitionBy(feature)
    out = inside.withColumns({f"{c}0": F.sum(f"{c}1").over(all_) - F.col(f"{c}1") for c in "nsq"})
    return out


def welch(moments: DataFrame, least: int = 2) -> DataFrame:
    """Means, t and degrees of freedom of inside against outside; valid from ``least`` values on both sides.

    With no spread at all: equal means give t 0 and p 1, different ones an infinite t and p 0.
    """
    n1, n0 = F.col("n1"), F.col("n0")
    m1, m0 = divide(F.col("s1"), n1), divide(F.col("s0"), n0)
    v1 = F.greatest(F.lit(0.0), divide(F.col("q1") - divide(F.col("s1") * F.col("s1"), n1), n1 - 1))
    v0 = F.greatest(F.lit(0.0), divide(F.col("q0") - divide(F.col("s0") * F.col("s0"), n0), n0 - 1))
    e1, e0 = divide(v1, n1), divide(v0, n0)
    out = moments.where((n1 >= least) & (n0 >= least)).withColumns({"mean_in": m1, "mean_out": m0, "_e1": e1, "_e0": e0})
    se2 = F.col("_e1") + F.col("_e0")
    gap = F.col("mean_in") - F.col("mean_out")
    t = F.when(se2 > 0, divide(gap, F.sqrt(se2))).when(gap == 0, 0.0).otherwise(F.signum(gap) * float("inf"))
    df = divide(se2 * se2, divide(F.col("_e1") * F.col("_e1"), n1 - 1) + divide(F.col("_e0") * F.col("_e0"), n0 - 1))
    return out.withColumn("t", t).withColumn("df", df).drop("_e1", "_e0")


def welch_p(tested: DataFrame) -> DataFrame:
    """``tested`` with p; see ``welch`` for values without spread."""
    return tested.withColumn("p", F.when(F.col("t") == 0, 1.0).when(F.abs("t") == float("inf"), 0.0).otherwise(t_p_value("t", "df")))


def rank_sums(counts: DataFrame, spots: DataFrame, spot: str, gene: str, group: str, value: str) -> DataFrame:
    """(gene, group, n1, n, rank_sum_x2, ties): twice the sum of average ranks inside the group, and the sum of t^3 - t.

    Absent cells are zeros: they form one bucket of ties that is never materialised.
    """
    size = spots.groupBy(group).agg(F.count("*").alias("n1")).withColumn("n", F.sum("n1").over(Window.partitionBy(F.lit(1))))
    cells = counts.where(F.col(value) > 0).join(spots.select(spot, group), spot).groupBy(gene, value, group).agg(F.count("*").alias("c1"))
    levels = cells.groupBy(gene, value).agg(F.sum("c1").alias("c"))
    below = Window.partitionBy(gene).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("b", F.coalesce(F.sum("c").over(below), F.lit(0)))
    stored = levels.groupBy(gene).agg(F.sum("c").alias("stored"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tie"))
    inside = cells.join(levels, [gene, value]).groupBy(gene, group).agg(F.sum("c1").alias("k1"), F.sum(F.col("c1") * (2 * F.col("b") + F.col("c") + 1)).alias("r"))
    full = stored.crossJoin(F.broadcast(size)).join(inside, [gene, group], "left")
    z = F.col("n") - F.col("stored")
    k1 = F.coalesce("k1", F.lit(0))
    return full.select(gene, group, "n1", "n", (F.coalesce("r", F.lit(0)) + 2 * z * k1 + (F.col("n1") - k1) * (z + 1)).alias("rank_sum_x2"), (F.col("tie") + z * z * z - z).alias("ties"))


def wilcoxon(ranks: DataFrame) -> DataFrame:
    """``ranks`` with z (tie-corrected, no continuity correction) and its two-sided p."""
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n0 = n - n1
    tie = 1 - divide(F.col("ties"), n * n * n - n)
    sd = F.sqrt(n1 * n0 * (n + 1) / 12 * tie)
    z = divide(F.col("rank_sum_x2") / 2 - n1 * (n + 1) / 2, sd)
    return ranks.withColumn("z", z).withColumn("p", F.when(z.isNull(), 1.0).otherwise(normal_p_value(z)))


def gene_markers(normalized: DataFrame, spots: DataFrame, spot: str, gene: str, group: str) -> DataFrame:
    """Per group and gene: n1, n, z, p, adjusted p, log2 fold change of means over all spots, and the share of spots expressing it.

    ``normalized`` has scaled and logged values (see matrix.normalize); ranks run on the former, which orders as the latter.
    """
    tested = adjust_bh(wilcoxon(rank_sums(normalized, spots, spot, gene, group, "scaled")), [group], "p", [gene])
    rows = normalized.where(F.col("scaled") > 0).join(spots.select(spot, group), spot).groupBy(gene, group).agg(F.sum("logged").alias("s"), F.count("*").alias("k"))
    totals = rows.groupBy(gene).agg(F.sum("s").alias("all_s"))
    out = tested.join(rows, [gene, group], "left").join(totals, gene, "left")
    inside = divide(F.coalesce("s", F.lit(0.0)), F.col("n1"))
    outside = divide(F.coalesce("all_s", F.lit(0.0)) - F.coalesce("s", F.lit(0.0)), F.col("n") - F.col("n1"))
    fold = F.log2((F.expm1(inside) + 1e-9) / (F.expm1(F.greatest(outside, F.lit(0.0))) + 1e-9))
    return out.select(gene, group, "n1", "n", "z", "p", "p_adjusted", fold.alias("log2_fold"), divide(F.coalesce("k", F.lit(0)), F.col("n1")).alias("fraction"))


def _finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def rising_markers(tested: DataFrame, group: str, feature: str, score: str, effect: str, fdr: float = 0.05, top: int = 50) -> DataFrame:
    """The ``top`` features of each group by score with a finite effect above 0 and adjusted p of at most ``fdr``, ranked from 1."""
    kept = tested.where(_finite(effect) & _finite("p_adjusted") & (F.col(effect) > 0) & (F.col("p_adjusted") <= fdr))
    return top_k(kept, [group], [F.desc(score), F.col(feature)], top)


def cluster_markers(tested: DataFrame, group: str, gene: str, fdr: float = 0.05, least_fold: float = 0.25, least_fraction: float = 0.1, top: int = 100, least_spots: int = 2) -> DataFrame:
    """The ``top`` genes of each cluster by z with adjusted p below ``fdr``, enough fold change and enough expressing spots.

    Clusters of fewer than ``least_spots`` spots, inside or outside, have none.
    """
    sizes = (F.col("n1") >= least_spots) & (F.col("n") - F.col("n1") >= least_spots)
    kept = tested.where(sizes & _finite("log2_fold") & _finite("p_adjusted") & (F.col("p_adjusted") < fdr) & (F.col("log2_fold") >= least_fold) & (F.col("fraction") >= least_fraction))
    return top_k(kept, [group], [F.desc("z"), F.col(gene)], top)


def guarded_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, Pearson r (null for fewer than two rows or a constant side), root mean squared difference."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = rows.where(a.isNotNull() & b.isNotNull())
    out = pairs.agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.avg((a - b) * (a - b)).alias("d"))
    return out.select("n", F.when((F.col("n") > 1) & (F.col("vx") > 0) & (F.col("vy") > 0), divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy")))).alias("pearson"), F.sqrt("d").alias("rmse"))


def average_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Average ranks over the whole table, from counts of distinct values that are summed up by ranges of values."""
    levels = running_start(rows.groupBy(value).agg(F.count("*").alias("_c")), [value], {"_c": "_b"})
    return rows.join(levels.select(value, (F.col("_b") + (F.col("_c") + 1) / 2).alias(out)), value)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and the correlation of average ranks."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return guarded_correlation(average_rank(average_rank(pairs, x, "_rx"), y, "_ry"), "_rx", "_ry").select("n", F.col("pearson").alias("spearman"))


def otsu_threshold(reads: DataFrame, value: str) -> DataFrame:
    """One row: n, bins and the threshold that parts log10 of positive values best; at least 1.

    Fewer than two positive levels raise an error. floor(sqrt(n)) bins within 32 and 256; the first split of largest between-class variance; its right edge, rounded up.
    """
    logs = reads.where(F.col(value) > 0).select(F.log10(F.col(value).cast("double")).alias("x"))
    span = logs.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = span.withColumn("bins", F.least(F.lit(256), F.greatest(F.lit(32), F.floor(F.sqrt("n")))).cast("long"))
    at = F.least(F.col("bins") - 1, F.coalesce(F.floor(divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("bins")), F.lit(0)))
    filled = logs.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    dims = span.select("n", "lo", "hi", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin")).join(filled, "bin", "left").fillna(0, ["c"])
    dims = dims.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins")).withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(1))
    dims = dims.withColumns({"w0": F.sum("c").over(upto), "m0": F.sum(F.col("c") * F.col("mid")).over(upto), "m": F.sum(F.col("c") * F.col("mid")).over(all_)})
    w1 = F.col("n") - F.col("w0")
    gap = divide(F.col("m0"), F.col("w0")) - divide(F.col("m") - F.col("m0"), w1)
    score = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    best = dims.withColumn("score", F.round(score, 6)).agg(F.max_by(F.struct("n", "bins", "lo", "hi", "width", "bin"), F.struct("score", -F.col("bin"))).alias("k"))
    edge = F.col("k.lo") + (F.col("k.bin") + 1) * F.col("k.width")
    threshold = F.greatest(F.lit(1), F.ceil(F.round(F.pow(F.lit(10.0), edge), 6))).cast("long")
    levels = F.when(F.col("k.lo") < F.col("k.hi"), threshold).otherwise(F.raise_error(F.lit("no threshold: fewer than two positive levels")).cast("long"))
    return best.select(F.col("k.n").alias("n"), F.col("k.bins").alias("bins"), levels.alias("threshold"))


def saturation_curve(histogram: DataFrame, samples: DataFrame, step: float) -> DataFrame:
    """(sample, target, fraction, n_spots, q25, q50, q75): expected distinct sites after thinning whole samples.

    ``histogram``: sample, spot, reads, depth, site_count; ``samples``: sample, source, threshold. Targets are the multiples
    of ``step`` up to the sample's source; at each, all spots of more reads than the threshold are thinned by target /
    source. Raises Violation for bad values, spots with two numbers of reads, samples without such a spot or below a step.
    """
    expect(histogram, not_empty=True, reads=F.col("reads") >= 0, depth=F.col("depth") > 0, site_count=F.col("site_count") > 0)
    kept = histogram.join(samples, "sample").where(F.col("reads") > F.col("threshold"))
    spots = histogram.groupBy("sample", "spot").agg(F.min("reads").alias("lo"), F.max("reads").alias("hi"))
    good = spots.join(samples, "sample").groupBy("sample").agg(F.count_if(F.col("lo") > F.col("threshold")).alias("n"), F.bool_and(F.col("lo") == F.col("hi")).alias("same"), F.max("source").alias("source"))
    expect(good, spots_above_the_threshold=F.col("n") > 0, one_number_of_reads_a_spot=F.col("same"), source_of_a_step=F.floor(F.col("source") / step) >= 1)
    steps = F.explode(F.sequence(F.lit(1), F.floor(F.col("source") / step).cast("int")))
    targets = kept.withColumn("k", steps).withColumn("target", F.col("k") * float(step)).withColumn("fraction", F.col("target") / F.col("source"))
    each = targets.groupBy("sample", "target", "fraction", "spot").agg(F.sum(F.col("site_count") * unseen_share(F.col("fraction"), F.col("depth"))).alias("expected"))
    quartiles = each.groupBy("sample", "target", "fraction").agg(F.count("*").alias("n_spots"), F.percentile("expected", [0.25, 0.5, 0.75]).alias("q"))
    return quartiles.select("sample", "target", "fraction", "n_spots", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


def factor_r2(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: n, groups, R2 and adjusted R2 of a one-hot design on ``keys``: between over total sum of squares."""
    x = F.col(value).cast("double")
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    out = cells.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    r2 = divide(F.col("b") - mean, F.col("q") - mean)
    adjusted = F.when(F.col("n") > F.col("groups"), 1 - (1 - r2) * divide(F.col("n") - 1, F.col("n") - F.col("groups")))
    return out.select("n", "groups", r2.alias("r2"), adjusted.alias("adjusted_r2"))


def additive_r2(rows: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """One row: n, rank and R2 of the additive one-hot design; the normal equations hold one row per level.

    Cells of the two factors are summed in Spark; only the table of cells, whose size is that of the levels' product,
    meets in one place.
    """
    x = F.col(value).cast("double")
    cells = rows.groupBy(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b")).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.factorize(t["a"], sort=True)[0], pd.factorize(t["b"], sort=True)[0]
        k = a.max() + 1
        design = np.zeros((len(t), 1 + k + b.max() + 1))
        design[:, 0] = design[np.arange(len(t)), 1 + a] = design[np.arange(len(t)), 1 + k + b] = 1
        n, s = t["n"].to_numpy(float), t["s"].to_numpy(float)
        gram, right = design.T @ (design * n[:, None]), design.T @ s
        coef = np.linalg.lstsq(gram, right, rcond=None)[0]
        total = t["q"].sum() - s.sum() ** 2 / n.sum()
        left = t["q"].sum() - coef @ right
        r2 = 1 - left / total if total > 0 else None
        return pd.DataFrame({"n": [int(n.sum())], "rank": [int(np.linalg.matrix_rank(gram))], "r2": [r2]})

    return cells.groupBy(F.lit(True).alias("all")).applyInPandas(solve, "n long, rank long, r2 double")


def variance_partition(r2: DataFrame) -> DataFrame:
    """Shares of variance from R2 of first, second, additive and interaction designs; they sum to 1, shared may be negative."""
    a, b, ab, full = (F.col(c) for c in ("r2_first", "r2_second", "r2_additive", "r2_interaction"))
    return r2.withColumns({"unique_first": ab - b, "unique_second": ab - a, "shared": a + b - ab, "interaction_gain": full - ab, "residual": 1 - full})


def row_zscore(rows: DataFrame, feature: str, value: str) -> DataFrame:
    """``z``: the value against its feature's mean and population deviation; 0 for a constant feature, null stays."""
    w = Window.partitionBy(feature)
    sd = F.stddev_pop(value).over(w)
    return rows.withColumn("z", F.when(F.col(value).isNotNull(), F.when(sd > 0, divide(F.col(value) - F.avg(value).over(w), sd)).otherwise(0.0)))


def dot_plot(counts: DataFrame, logged: DataFrame, spots: DataFrame, spot: str, gene: str, group: str) -> DataFrame:
    """(group, gene, fraction, mean, z): share of spots detecting, mean over all spots, z of means across groups; dense."""
    size = spots.groupBy(group).agg(F.count("*").alias("n"))
    dims = size.crossJoin(counts.select(gene).distinct())
    found = logged.join(spots.select(spot, group), spot).groupBy(group, gene).agg(F.count_if(F.col("logged") > 0).alias("k"), F.sum("logged").alias("s"))
    out = dims.join(found, [group, gene], "left").select(group, gene, divide(F.coalesce("k", F.lit(0)), F.col("n")).alias("fraction"), divide(F.coalesce("s", F.lit(0.0)), F.col("n")).alias("mean"))
    return row_zscore(out, gene, "mean")
