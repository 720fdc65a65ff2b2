"""Queries on counts and observed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import matrix, stats, tables

from .registry import query
from .views import table, view

LOGGED = "logged AS (SELECT spot, gene, n, ln(1 + n * 10000.0 / sum(n) OVER (PARTITION BY spot)) AS lg, n * 10000.0 / sum(n) OVER (PARTITION BY spot) AS sc FROM counts)"


@query("SELECT l_suppkey AS spot, l_partkey AS gene, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM {lineitem} GROUP BY 1, 2")
def coo_dedup(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("spot"), F.col("l_partkey").alias("gene"), F.col("l_quantity").cast("long").alias("n"))
    return matrix.sum_duplicates(rows, "spot", "gene", "n")


@query("""WITH r AS (SELECT spot FROM {counts} GROUP BY spot HAVING count(*) >= 400),
    k AS (SELECT * FROM counts WHERE spot IN (SELECT spot FROM r)),
    c AS (SELECT gene FROM k GROUP BY gene HAVING count(*) >= 20)
    SELECT spot, gene, n FROM k WHERE gene IN (SELECT gene FROM c)""")
def support_filter(spark, d):
    return matrix.support_filter(view(spark, d, "counts"), "spot", "gene", 400, 20)


@query("SELECT spot FROM {counts} GROUP BY spot HAVING count(*) >= 480")
def spot_filter(spark, d):
    return matrix.filter_by_count(view(spark, d, "counts"), ["spot"], 480).select("spot").distinct()


@query("""WITH j AS (SELECT c.spot, c.gene, c.n, s.sample FROM {counts} c JOIN {spots} s ON c.spot = s.spot),
    g AS (SELECT sample, gene FROM j GROUP BY sample, gene HAVING count(*) >= 10)
    SELECT j.sample, j.spot, j.gene, j.n FROM j JOIN g ON j.sample = g.sample AND j.gene = g.gene""")
def gene_filter_per_sample(spark, d):
    rows = view(spark, d, "counts").join(view(spark, d, "spots").select("spot", "sample"), "spot")
    return matrix.filter_by_count(rows, ["sample", "gene"], 10).select("sample", "spot", "gene", "n")


@query("""SELECT spot, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_genes, CAST(sum(CASE WHEN gene % 10 = 0 THEN n ELSE 0 END) AS BIGINT) AS total_mt,
    CAST(sum(CASE WHEN gene % 17 = 3 THEN n ELSE 0 END) AS BIGINT) AS total_hb, 100.0::DOUBLE * sum(CASE WHEN gene % 10 = 0 THEN n ELSE 0 END) / sum(n) AS pct_mt,
    100.0::DOUBLE * sum(CASE WHEN gene % 17 = 3 THEN n ELSE 0 END) / sum(n) AS pct_hb FROM {counts} GROUP BY spot""")
def qc_metrics(spark, d):
    return matrix.qc_metrics(view(spark, d, "counts"), "spot", "n", mt=F.col("gene") % 10 == 0, hb=F.col("gene") % 17 == 3)


@query("SELECT spot, CAST(sum(n) AS BIGINT) AS umi, count(*) AS genes FROM {counts} GROUP BY spot")
def umi_genes(spark, d):
    return view(spark, d, "counts").groupBy("spot").agg(F.sum("n").alias("umi"), F.count_if(F.col("n") > 0).alias("genes"))


@query(f"""WITH {LOGGED}, m AS (SELECT count(DISTINCT spot) AS k FROM {{spots}}), d AS (SELECT * FROM {{counts}} LIMIT 0)
    SELECT gene, CAST(sum(n) AS BIGINT) AS total, count(*) AS detected, round(sum(sc) / any_value(k), 6) AS mean_scaled, round(sum(lg) / any_value(k), 6) AS mean_logged
    FROM logged, m GROUP BY gene""")
def cp10k_mean(spark, d):
    out = matrix.gene_means(view(spark, d, "counts"), view(spark, d, "spots"), "spot", "gene", "n")
    return out.withColumn("mean_scaled", F.round("mean_scaled", 6)).withColumn("mean_logged", F.round("mean_logged", 6))


@query(f"""WITH {LOGGED}, d AS (SELECT * FROM {{counts}} LIMIT 0), x AS (SELECT gene, sum(lg) AS s FROM logged GROUP BY gene)
    SELECT gene, round(s, 6) AS logged_sum FROM x ORDER BY round(s, 6) DESC, gene LIMIT 20""")
def top_genes(spark, d):
    rows = matrix.normalize(view(spark, d, "counts"), "spot", "n").groupBy("gene").agg(F.round(F.sum("logged"), 6).alias("logged_sum"))
    return rows.orderBy(F.desc("logged_sum"), "gene").limit(20)


@query("SELECT spot, symbol, CAST(sum(n) AS BIGINT) AS n FROM {counts} c JOIN {genes} g ON c.gene = g.gene GROUP BY spot, symbol")
def symbol_collapse(spark, d):
    return matrix.collapse_symbols(view(spark, d, "counts"), view(spark, d, "genes"), "spot", "gene", "symbol", "n")


@query("""WITH s AS (SELECT spot, gene, n, CAST(n * 10000.0 AS DOUBLE) / sum(n) OVER (PARTITION BY spot) AS sc FROM {counts}),
    q AS (SELECT gene, quantile_cont(sc, 0.75) AS cut FROM s GROUP BY gene)
    SELECT s.spot, s.gene, s.n FROM s JOIN q ON s.gene = q.gene WHERE s.n >= 30 AND s.sc >= q.cut""")
def high_expression(spark, d):
    return matrix.high_expression(view(spark, d, "counts"), "spot", "gene", "n", 30, 0.75)


@query("""WITH m AS (SELECT gene AS unit, gene FROM {genes} WHERE gene % 3 = 0 UNION ALL SELECT gene AS unit, gene + 1 FROM {genes} WHERE gene % 3 = 0 AND gene % 2 = 0),
    z AS (SELECT unit, count(*) AS k FROM m GROUP BY unit), t AS (SELECT spot, CAST(sum(n) AS DOUBLE) AS total FROM {counts} GROUP BY spot),
    u AS (SELECT c.spot, m.unit, count(*) AS k, min(c.n) AS n FROM counts c JOIN m ON c.gene = m.gene GROUP BY 1, 2), x AS (SELECT u.spot, u.unit, u.n, u.n / total * 10000.0::DOUBLE AS sc FROM u JOIN z ON u.unit = z.unit AND u.k = z.k JOIN t ON t.spot = u.spot),
    q AS (SELECT unit, quantile_cont(sc, 0.5) AS cut FROM x GROUP BY unit) SELECT x.spot, x.unit, x.n FROM x JOIN q ON x.unit = q.unit WHERE x.n >= 20 AND sc >= cut""")
def complex_high_expression(spark, d):
    genes = view(spark, d, "genes").where("gene % 3 = 0")
    members = genes.select(F.col("gene").alias("unit"), "gene").union(genes.where("gene % 2 = 0").select(F.col("gene").alias("unit"), F.col("gene") + 1))
    return matrix.high_complexes(view(spark, d, "counts"), members, "spot", "gene", "unit", "n", 20, 0.5)


@query("SELECT count(*) AS rows_outside FROM {counts} c WHERE n <> 0 AND NOT EXISTS (SELECT 1 FROM {observed} o WHERE o.spot = c.spot AND o.feature = c.gene AND o.num > 0)")
def outside_mask(spark, d):
    mask = view(spark, d, "observed").where("num > 0").select("spot", F.col("feature").alias("gene"))
    return matrix.outside_mask(view(spark, d, "counts"), mask, "spot", "gene", "n").agg(F.count("*").alias("rows_outside"))


@query("SELECT cluster, count(*) AS n, CAST(min(spot) AS BIGINT) AS first_spot, CAST(max(spot) AS BIGINT) AS last_spot FROM {spots} GROUP BY cluster")
def cluster_sizes(spark, d):
    return view(spark, d, "spots").groupBy("cluster").agg(F.count("*").alias("n"), F.min("spot").alias("first_spot"), F.max("spot").alias("last_spot"))


@query("""WITH a AS (SELECT l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS total FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY 1),
    b AS (SELECT l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS total FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT a.gene, a.total AS total_1, b.total AS total_2 FROM a JOIN b ON a.gene = b.gene""")
def gene_inner_pair(spark, d):
    a, b = _halves(spark, d)
    return tables.outer_pair(a, b, ["gene"]).where("total_1 is not null and total_2 is not null")


def _halves(spark, d):
    rows = table(spark, d, "lineitem")
    return [rows.where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("total")) for s in ("F", "O")]


@query("""WITH a AS (SELECT DISTINCT l_partkey AS gene FROM {lineitem} WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_partkey AS gene FROM {lineitem} WHERE l_linestatus = 'O')
    SELECT (SELECT count(*) FROM a JOIN b USING (gene)) AS n_both, (SELECT count(*) FROM a WHERE gene NOT IN (SELECT gene FROM b)) AS n_only_1,
    (SELECT count(*) FROM b WHERE gene NOT IN (SELECT gene FROM a)) AS n_only_2""")
def pair_counts(spark, d):
    return tables.pair_counts(*_halves(spark, d), "gene")


PAIR = """a AS (SELECT l_partkey AS gene, sum(l_quantity) AS x FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY 1),
    b AS (SELECT l_partkey AS gene, sum(l_quantity) AS y FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY 1), p AS (SELECT * FROM a JOIN b USING (gene))"""


@query(f"WITH {PAIR} SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse FROM p")
def safe_corr_rmse(spark, d):
    a, b = _halves(spark, d)
    out = stats.guarded_correlation(a.join(b.withColumnRenamed("total", "other"), "gene"), "total", "other")
    return out.withColumn("pearson", F.round("pearson", 6)).withColumn("rmse", F.round("rmse", 6))


@query(f"""WITH {PAIR}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
    SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r""")
def spearman(spark, d):
    a, b = _halves(spark, d)
    return stats.spearman(a.join(b.withColumnRenamed("total", "other"), "gene"), "total", "other").withColumn("spearman", F.round("spearman", 6))


@query(f"""WITH {LOGGED}, d AS (SELECT * FROM {{counts}} LIMIT 0), e AS (SELECT * FROM {{spots}} LIMIT 0), z AS (SELECT cluster, count(*) AS m FROM spots GROUP BY cluster),
    dims AS (SELECT cluster, m, gene FROM z CROSS JOIN (SELECT DISTINCT gene FROM counts)),
    f AS (SELECT cluster, gene, count(*) AS k, sum(lg) AS s FROM logged JOIN spots USING (spot) GROUP BY cluster, gene),
    x AS (SELECT dims.cluster, dims.gene, coalesce(k, 0) / CAST(m AS DOUBLE) AS fraction, coalesce(s, 0.0) / m AS mean FROM dims LEFT JOIN f ON dims.cluster = f.cluster AND dims.gene = f.gene)
    SELECT cluster, gene, round(fraction, 6) AS fraction, round(mean, 6) AS mean, round(CASE WHEN stddev_pop(mean) OVER (PARTITION BY gene) > 1e-9 THEN (mean - avg(mean) OVER (PARTITION BY gene)) / stddev_pop(mean) OVER (PARTITION BY gene) ELSE 0 END, 4) + 0.0::DOUBLE AS z FROM x""")
def dotplot_stats(spark, d):
    counts = view(spark, d, "counts")
    out = stats.dot_plot(counts, matrix.normalize(counts, "spot", "n"), view(spark, d, "spots"), "spot", "gene", "cluster")
    return out.select("cluster", "gene", F.round("fraction", 6).alias("fraction"), F.round("mean", 6).alias("mean"), (F.round("z", 4) + 0.0).alias("z"))


@query("""WITH x AS (SELECT spot, feature, CAST(num AS DOUBLE) / den AS v FROM {observed})
    SELECT spot, feature, round(CASE WHEN stddev_pop(v) OVER (PARTITION BY feature) > 0 THEN (v - avg(v) OVER (PARTITION BY feature)) / stddev_pop(v) OVER (PARTITION BY feature) ELSE 0 END, 6) AS z FROM x""")
def row_zscore(spark, d):
    rows = view(spark, d, "observed").withColumn("v", F.col("num") / F.col("den"))
    return stats.row_zscore(rows, "feature", "v").select("spot", "feature", F.round("z", 6).alias("z"))
