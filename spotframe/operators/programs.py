"""Expression programs as published: overdispersed genes, scaling by gene, a grid of factorisations that can be resumed,
consensus, and gene scores by regression on the usages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.expect import Violation
from spotframe.functions.columns import divide
from spotframe.operators.linalg import fit_factor, nmf_runs, run_sums
from spotframe.operators.mapping import consensus
from spotframe.operators.tables import top_k
from spotframe.staging import release, staged

#: Counts of a spot after scaling, and the genes of largest mean that set the least spread.
PER_SPOT, TOP_MEANS = 1e6, 20


def per_million(counts: DataFrame) -> DataFrame:
    """(spot, gene, n, value): ``counts`` (spot, gene, n) with each spot's sum scaled to a million."""
    totals = counts.groupBy("spot").agg(F.sum("n").cast("double").alias("_t"))
    return counts.join(totals.where("_t > 0"), "spot").select("spot", "gene", "n", (F.col("n") * PER_SPOT / F.col("_t")).alias("value"))


def gene_moments(values: DataFrame, spots: int) -> DataFrame:
    """(gene, mean, var) over all ``spots`` spots; absent cells are zeros."""
    sums = values.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / spots
    return sums.select("gene", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("q") / spots - mean * mean).alias("var"))


def overdispersed_genes(counts: DataFrame, spots: DataFrame, n: int) -> DataFrame:
    """(gene, ratio, rank): the ``n`` genes of largest Fano factor over the expected one.

    Expected is a^2 mean + b^2, where a is the least coefficient of variation of the TOP_MEANS genes of largest mean and
    b^2 the median Fano factor of genes within the middle 80 % of both means and Fano factors.
    """
    m = spots.select("spot").distinct().count()
    rows = gene_moments(per_million(counts), m).where("mean > 0").withColumn("fano", F.col("var") / F.col("mean"))
    rows = staged(rows, "moments")
    top = rows.orderBy(F.desc("mean"), "gene").limit(TOP_MEANS).agg(F.min(F.sqrt("var") / F.col("mean")).alias("a"))
    box = rows.agg(*[F.percentile(c, F.array(F.lit(0.1), F.lit(0.9))).alias(c) for c in ("mean", "fano")]).first()
    inside = F.lit(True)
    for c in ("mean", "fano"):
        low, high = box[c] or (0.0, 0.0)
        inside = inside & (F.col(c) > low) & (F.col(c) < high)
    middle = rows.where(inside).agg(F.percentile("fano", 0.5).alias("b2"))
    limits = top.crossJoin(middle)  # one row
    scored = rows.crossJoin(F.broadcast(limits)).select("gene", F.round(divide(F.col("fano"), F.col("a") * F.col("a") * F.col("mean") + F.col("b2")), 9).alias("ratio"))
    return top_k(scored.withColumn("all", F.lit(True)), ["all"], [F.desc("ratio"), F.col("gene")], n).select("gene", "ratio", "rank")


def program_input(counts: DataFrame, spots: DataFrame, genes: DataFrame, empty_spots: bool = False) -> DataFrame:
    """(row, col, value): counts of ``genes`` (gene), each gene over its standard deviation over all spots (n - 1).

    Raises Violation where a spot has no count of these genes. With ``empty_spots`` such a spot counts in the deviations and
    has no row here: its usages are zeros, the only fit of a row of zeros, which ``all_usages`` adds.
    """
    m = spots.select("spot").distinct().count()
    chosen = counts.where("n > 0").join(genes.select("gene"), "gene", "left_semi")
    if not empty_spots and not spots.join(chosen, "spot", "left_anti").isEmpty():
        raise Violation("a spot has no count of the chosen genes")
    moments = gene_moments(chosen.withColumn("value", F.col("n").cast("double")), m)
    scale = moments.select("gene", F.sqrt(F.col("var") * m / max(m - 1, 1)).alias("sd"))
    return chosen.join(scale, "gene").select(F.col("spot").alias("row"), F.col("gene").alias("col"), divide(F.col("n"), F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("value"))


def all_usages(usage: DataFrame, spots: DataFrame, k: int) -> DataFrame:
    """``usage`` (id, vec) with a row of ``k`` zeros for each of ``spots`` that has none; no rows at all stay none."""
    if usage.isEmpty():
        return usage
    missing = spots.select(F.col("spot").alias("id")).distinct().join(usage, "id", "left_anti")
    return usage.union(missing.select("id", F.array_repeat(F.lit(0.0), k).alias("vec")))


def _done(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _places(folder: str, k: int, runs: int, batch: int) -> list[tuple[int, int, str]]:
    return [(a, min(batch, runs - a), f"{folder}/k={k}/runs={a}-{min(a + batch, runs)}") for a in range(0, runs, batch)]


def factorise_grid(entries: DataFrame, ranks: list[int], runs: int, folder: str, batch: int = 20, iterations: int = 1000, tol: float = 1e-4, seed: int = 0) -> list[tuple[int, int]]:
    """Write the spectra of ``runs`` factorisations of each rank under ``folder``, and return the (k, first run) fitted now.

    ``batch`` runs share their joins and are kept together. What a stopped call has finished stays: the next call with
    the same arguments fits only what is missing.
    """
    fitted = []
    for k in ranks:
        for first, size, path in _places(folder, k, runs, batch):
            if _done(entries.sparkSession, f"{path}/figures"):
                continue
            w, h, errors, taken = nmf_runs(entries, k, size, iterations, tol, seed + 7919 * k + first)
            h.write.mode("overwrite").parquet(f"{path}/spectra")
            entries.sparkSession.createDataFrame([(errors, taken)], "errors array<double>, iterations int").coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")
            release(w, h)
            fitted.append((k, first))
    return fitted


def merged_spectra(spark: SparkSession, folder: str, k: int, runs: int, batch: int = 20) -> tuple[DataFrame, list[float], int]:
    """(id, vec) with all runs' spectra of rank ``k``, the runs' errors and most iterations; raises where runs are missing."""
    out, errors, taken = None, [], 0
    for _, _, path in _places(folder, k, runs, batch):
        if not _done(spark, f"{path}/figures"):
            raise Violation(f"{path} isn't finished: call factorise_grid again")
        h, figures = spark.read.parquet(f"{path}/spectra"), spark.read.parquet(f"{path}/figures").first()
        errors, taken = errors + list(figures["errors"]), max(taken, figures["iterations"])
        out = h if out is None else out.join(h.withColumnRenamed("vec", "_v"), "id").select("id", F.concat("vec", "_v").alias("vec"))
    return staged(out, "spectra"), errors, taken


def choose_rank(entries: DataFrame, ranks: list[int], runs: int, folder: str, batch: int = 20) -> list[tuple[int, float, float]]:
    """(k, silhouette, prediction error) of each rank of a finished grid, over all spectra."""
    out = []
    for k in ranks:
        figures = consensus(entries, k, runs, density=np.inf, spectra=merged_spectra(entries.sparkSession, folder, k, runs, batch))[2]
        out.append((k, figures["silhouette"], figures["prediction_error"]))
    return out


def gene_scores(values: DataFrame, usage: DataFrame, spots: int, k: int) -> DataFrame:
    """(program, gene, score): least squares of each gene's z-scored values on the usages, without an intercept.

    ``values``: spot, gene, value, absent cells zero; ``usage``: id, vec of all spots. A gene of no spread scores 0. Sums of
    a gene's values times usages are joined in Spark; only the usages' k x k products reach the driver.
    """
    gram = run_sums(usage.select("id", "vec", F.array(F.lit(0.0)).alias("cross")), 1, k)[0][0]
    inverse = np.linalg.pinv(gram)
    total = usage.agg(*[F.sum(F.col("vec")[i]).alias(f"t{i}") for i in range(k)]).first()
    cross = values.join(usage.select(F.col("id").alias("spot"), "vec"), "spot").groupBy("gene").agg(*[F.sum(F.col("vec")[i] * F.col("value")).alias(f"x{i}") for i in range(k)])
    rows = cross.join(gene_moments(values, spots), "gene")
    z = [divide(F.col(f"x{i}") - F.col("mean") * float(total[f"t{i}"] or 0.0), F.sqrt("var")) for i in range(k)]
    scores = [sum((F.coalesce(z[j], F.lit(0.0)) * float(inverse[i, j]) for j in range(k)), F.lit(0.0)) for i in range(k)]
    return rows.select("gene", F.posexplode(F.array(*scores)).alias("program", "score")).select("program", "gene", "score")


def program_table(counts: DataFrame, spots: DataFrame, usage: DataFrame, k: int, top: int = 50) -> DataFrame:
    """(program, rank, gene, score, weight): each program's ``top`` genes by score, with their weights per million.

    ``usage`` (id, vec) is that of ``consensus``; weights are the non-negative fit of the values per million on the usages
    that sum to one in each spot.
    """
    values = staged(per_million(counts).select("spot", "gene", "value"), "million")
    m = spots.select("spot").distinct().count()
    whole = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    shares = staged(usage.select("id", F.transform("vec", lambda x: F.coalesce(divide(x, whole), F.lit(0.0))).alias("vec"), F.array(F.lit(0.0)).alias("cross")), "shares")
    cells = values.select(F.col("spot").alias("row"), F.col("gene").alias("col"), "value")
    weights = fit_factor(cells, shares, None, "col", run_sums(shares, 1, k)[0], 200)
    weights = weights.select(F.col("id").alias("gene"), F.posexplode("vec").alias("program", "weight"))
    best = top_k(gene_scores(values, usage, m, k), ["program"], [F.desc("score"), F.col("gene")], top)
    return best.join(weights, ["program", "gene"]).select("program", "rank", "gene", "score", "weight")


def programs(counts: DataFrame, spots: DataFrame, k: int, folder: str, genes: int = 2000, runs: int = 100, batch: int = 20, top: int = 50, empty_spots: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """``program_table``, usages (id, vec) and figures of a consensus of rank ``k``; the grid's state is kept under ``folder``.

    With ``empty_spots`` a spot without a count of the chosen genes has usages of zero; otherwise it raises.
    """
    entries = staged(program_input(counts, spots, overdispersed_genes(counts, spots, genes), empty_spots), "input")
    factorise_grid(entries, [k], runs, folder, batch)
    _, usage, figures = consensus(entries, k, runs, spectra=merged_spectra(counts.sparkSession, folder, k, runs, batch))
    usage = all_usages(usage, spots, k)
    return program_table(counts, spots, usage, k, top), usage, figures
