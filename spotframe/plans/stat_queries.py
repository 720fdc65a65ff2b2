"""Queries on statistics, space, graphs and factorisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import deconvolution as deconvolve
from spotframe.operators import graph, linalg, mapping, matrix, programs, spatial, stats
from spotframe.staging import new_folder, staged

from .registry import query
from .views import table, view


@query("""WITH p AS (SELECT event_type, event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE floor(value) / 500 END AS p FROM {event}), v AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS r FROM p WHERE p IS NOT NULL),
    q AS (SELECT event_id, p, min(least(1.0::DOUBLE, p * n / r)) OVER (PARTITION BY event_type ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS a FROM v)
    SELECT p.event_id, p.p, round(q.a, 9) AS p_adjusted FROM p LEFT JOIN q ON p.event_id = q.event_id""")
def bh_adjust(spark, d):
    rows = view(spark, d, "event").select("event_type", "event_id", F.when(F.col("event_id") % 9 != 0, F.floor("value") / 500).alias("p"))
    return stats.adjust_bh(rows, ["event_type"], "p", ["event_id"]).select("event_id", "p", F.round("p_adjusted", 9).alias("p_adjusted"))


MOMENTS = """o AS (SELECT spot, feature, CAST(num AS DOUBLE) / 8 AS x FROM {observed}), i AS (SELECT feature, cluster, count(*) AS n1, sum(x) AS s1, sum(x * x) AS q1 FROM o JOIN {spots} USING (spot) GROUP BY 1, 2),
    m AS (SELECT *, sum(n1) OVER (PARTITION BY feature) - n1 AS n0, sum(s1) OVER (PARTITION BY feature) - s1 AS s0, sum(q1) OVER (PARTITION BY feature) - q1 AS q0 FROM i),
    w AS (SELECT *, s1 / n1 AS m1, s0 / n0 AS m0, greatest(0, q1 - s1 * s1 / n1) / (n1 - 1) / n1 AS e1, greatest(0, q0 - s0 * s0 / n0) / (n0 - 1) / n0 AS e0 FROM m WHERE n1 >= 2 AND n0 >= 2)"""


def _moments(spark, d):
    rows = view(spark, d, "observed").select("spot", "feature", (F.col("num").cast("double") / 8).alias("x"))
    return stats.group_moments(rows, view(spark, d, "spots"), "spot", "feature", "cluster", "x")


@query(f"""WITH {MOMENTS} SELECT feature, cluster, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round(m1, 9) AS mean_in, round(m0, 9) AS mean_out,
    round(CASE WHEN e1 + e0 > 1e-15 THEN (m1 - m0) / sqrt(e1 + e0) WHEN m1 = m0 THEN 0 ELSE sign(m1 - m0) * 'inf'::DOUBLE END, 6) AS t FROM w""")
def welch_stats(spark, d):
    out = stats.welch(_moments(spark, d))
    return out.select("feature", "cluster", "n1", "n0", F.round("mean_in", 9).alias("mean_in"), F.round("mean_out", 9).alias("mean_out"), F.round("t", 6).alias("t"))


@query()
def region_markers(spark, d):
    tested = stats.adjust_bh(stats.welch_p(stats.welch(_moments(spark, d))), ["cluster"], "p", ["feature"])
    tested = tested.withColumn("effect", F.col("mean_in") - F.col("mean_out"))
    return stats.rising_markers(tested, "cluster", "feature", "t", "effect").select("cluster", "feature", "rank", "t", "effect", "p", "p_adjusted")


@query("""WITH s AS (SELECT spot, cluster, count(*) OVER (PARTITION BY cluster) AS n1, count(*) OVER () AS n FROM {spots}), g AS (SELECT DISTINCT gene FROM {counts}),
    f AS (SELECT g.gene, s.spot, s.cluster, s.n1, s.n, coalesce(c.n, 0) AS v FROM g CROSS JOIN s LEFT JOIN counts c ON c.gene = g.gene AND c.spot = s.spot),
    r AS (SELECT *, 2 * rank() OVER (PARTITION BY gene ORDER BY v) + count(*) OVER (PARTITION BY gene, v) - 1 AS r2, count(*) OVER (PARTITION BY gene, v) AS t FROM f)
    SELECT gene, cluster, any_value(n1) AS n1, any_value(n) AS n, CAST(sum(r2) AS BIGINT) AS rank_sum_x2, CAST(sum(sum(t * t - 1)) OVER (PARTITION BY gene) AS BIGINT) AS ties FROM r GROUP BY gene, cluster""")
def wilcoxon_z(spark, d):
    counts = view(spark, d, "counts")
    out = stats.rank_sums(counts, view(spark, d, "spots"), "spot", "gene", "cluster", "n")
    return out.select("gene", "cluster", "n1", F.col("n"), F.col("rank_sum_x2").cast("long").alias("rank_sum_x2"), F.col("ties").cast("long").alias("ties"))


def _horner() -> str:
    out = str(stats.ERFC[-1])
    for c in reversed(stats.ERFC[:-1]):
        out = f"({out} * t + {c})"
    return out


TESTED = f"""s AS (SELECT spot, cluster, count(*) OVER (PARTITION BY cluster) AS n1, count(*) OVER () AS n FROM {{spots}}), w AS (SELECT spot, gene, n * 10000.0::DOUBLE / sum(n) OVER (PARTITION BY spot) AS v FROM {{counts}}), g AS (SELECT DISTINCT gene FROM counts),
    f AS (SELECT g.gene, s.cluster, s.n1, s.n, coalesce(w.v, 0) AS v FROM g CROSS JOIN s LEFT JOIN w ON w.gene = g.gene AND w.spot = s.spot),
    r AS (SELECT *, 2 * rank() OVER (PARTITION BY gene ORDER BY v) + count(*) OVER (PARTITION BY gene, v) - 1 AS r2, count(*) OVER (PARTITION BY gene, v) AS t FROM f),
    a AS (SELECT gene, cluster, CAST(any_value(n1) AS DOUBLE) AS n1, CAST(any_value(n) AS DOUBLE) AS n, CAST(sum(r2) AS DOUBLE) / 2 AS rs, CAST(sum(sum(t * t - 1)) OVER (PARTITION BY gene) AS DOUBLE) AS ties,
      sum(ln(1 + v)) AS lg, count(*) FILTER (v > 0) AS k FROM r GROUP BY gene, cluster),
    z AS (SELECT *, (rs - n1 * (n + 1) / 2) / nullif(sqrt(n1 * (n - n1) * (n + 1) / 12 * (1 - ties / (n * n * n - n))), 0) AS z, lg / n1 AS inside, (sum(lg) OVER (PARTITION BY gene) - lg) / (n - n1) AS outside FROM a),
    e AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM z),
    p AS (SELECT *, CASE WHEN z IS NULL THEN 1.0 ELSE least(1.0, t * exp(-x * x + {_horner()})) END AS p FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, gene) AS i, count(*) OVER (PARTITION BY cluster) AS m FROM p),
    tested AS (SELECT gene, cluster, n1, n, z, p, min(least(1.0, p * m / i)) OVER (PARTITION BY cluster ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS p_adjusted,
      log2((exp(inside) - 1 + 1e-9) / (exp(greatest(outside, 0)) - 1 + 1e-9)) AS log2_fold, k / n1 AS fraction FROM o)"""


def _tested(spark, d, counts: str = "counts"):
    return stats.gene_markers(matrix.normalize(view(spark, d, counts), "spot", "n"), view(spark, d, "spots"), "spot", "gene", "cluster")


@query(f"WITH {TESTED} SELECT gene, cluster, round(z, 6) + 0.0 AS z, round(p, 6) AS p, round(p_adjusted, 6) AS p_adjusted, round(log2_fold, 6) + 0.0 AS log2_fold, round(fraction, 6) AS fraction FROM tested")
def gene_markers(spark, d):
    signed = [(F.round(c, 6) + 0.0).alias(c) for c in ("z", "log2_fold")]
    return _tested(spark, d).select("gene", "cluster", signed[0], F.round("p", 6).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"), signed[1], F.round("fraction", 6).alias("fraction"))


# with planted markers the published rate of 0.05 parts the genes
RAISED = TESTED.replace("{counts}", "{planted}").replace("FROM counts", "FROM planted")


@query(f"""WITH {RAISED}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 9) DESC, gene) AS rank FROM tested WHERE log2_fold > 0 AND p_adjusted <= 0.05)
    SELECT cluster, gene, rank FROM k WHERE rank <= 20""")
def rising_markers(spark, d):
    tested = _tested(spark, d, "planted").withColumn("z", F.round("z", 9))
    return stats.rising_markers(tested, "cluster", "gene", "z", "log2_fold", 0.05, 20).select("cluster", "gene", "rank")


@query(f"""WITH {RAISED}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 9) DESC, gene) AS rank FROM tested WHERE n1 >= 2 AND n - n1 >= 2 AND p_adjusted < 0.05 AND log2_fold >= 0.25 AND fraction >= 0.1)
    SELECT cluster, gene, rank FROM k WHERE rank <= 100""")
def cluster_markers(spark, d):
    tested = _tested(spark, d, "planted").withColumn("z", F.round("z", 9))
    return stats.cluster_markers(tested, "cluster", "gene").select("cluster", "gene", "rank")


@query("""WITH x AS (SELECT log10(CAST(reads AS DOUBLE)) AS x FROM {reads}), s AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, CAST(least(256, greatest(32, floor(sqrt(count(*))))) AS BIGINT) AS bins FROM x),
    f AS (SELECT CAST(least(bins - 1, floor(coalesce((x - lo) / nullif(hi - lo, 0) * bins, 0))) AS BIGINT) AS bin, count(*) AS c FROM x, s GROUP BY 1),
    d AS (SELECT n, lo, bins, (hi - lo) / bins AS w, b AS bin, coalesce(c, 0) AS c, lo + (b + 0.5) * ((hi - lo) / bins) AS mid FROM s, range(256) t(b) LEFT JOIN f ON f.bin = b WHERE b < bins),
    k AS (SELECT *, sum(c) OVER (ORDER BY bin) AS w0, sum(c * mid) OVER (ORDER BY bin) AS m0, sum(c * mid) OVER () AS m FROM d),
    z AS (SELECT *, round(coalesce(w0 * (n - w0) * power(m0 / nullif(w0, 0) - (m - m0) / nullif(n - w0, 0), 2), 0), 6) AS score FROM k)
    SELECT n, bins, CAST(greatest(1, ceil(round(power(10, lo + (bin + 1) * w), 6))) AS BIGINT) AS threshold FROM z ORDER BY score DESC, bin LIMIT 1""")
def otsu_threshold(spark, d):
    return stats.otsu_threshold(view(spark, d, "reads"), "reads")


@query("""WITH h AS (SELECT r.spot % 3 AS sample, r.spot, reads, depth, site_count, CAST(2 + r.spot % 3 AS DOUBLE) AS source FROM {reads} r JOIN {depth} d ON r.spot = d.spot WHERE reads > 3),
    t AS (SELECT *, unnest(range(1, CAST(floor(source / 0.25) AS BIGINT) + 1)) * 0.25::DOUBLE AS target FROM h),
    e AS (SELECT sample, target, target / source AS fraction, spot, sum(site_count * (1 - power(1 - target / source, depth))) AS x FROM t GROUP BY 1, 2, 3, 4)
    SELECT sample, target, fraction, count(*) AS n_spots, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75 FROM e GROUP BY 1, 2, 3""")
def saturation_curve(spark, d):
    histogram = view(spark, d, "reads").join(view(spark, d, "depth"), "spot").withColumn("sample", F.col("spot") % 3)
    samples = spark.range(3).select(F.col("id").alias("sample"), (F.col("id") + 2.0).alias("source"), F.lit(3).alias("threshold"))
    out = stats.saturation_curve(histogram, samples, 0.25)
    return out.select("sample", "target", "fraction", "n_spots", *[F.round(f"q{p}", 6).alias(f"q{p}") for p in (25, 50, 75)])


R2 = """c AS (SELECT {k} AS k, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM {{event}} GROUP BY 1), z AS (SELECT sum(n) AS n, count(*) AS g, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM c)"""


@query(f"""WITH {R2.format(k="event_type")} SELECT CAST(n AS BIGINT) AS n, g AS groups, round((b - s * s / n) / (q - s * s / n), 6) AS r2, round(1 - (1 - (b - s * s / n) / (q - s * s / n)) * (n - 1) / (n - g), 6) AS adjusted_r2 FROM z""")
def r2_one_factor(spark, d):
    return stats.factor_r2(view(spark, d, "event"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("r2", "adjusted_r2")})


@query()
def variance_partition(spark, d):
    rows = view(spark, d, "event").withColumn("band", F.col("user_id") % 6)
    one = lambda keys, name: stats.factor_r2(rows, keys, "value").select(F.col("r2").alias(name))
    both = stats.additive_r2(rows, "event_type", "band", "value").select(F.col("r2").alias("r2_additive"))
    r2 = one(["event_type"], "r2_first").crossJoin(one(["band"], "r2_second")).crossJoin(one(["event_type", "band"], "r2_interaction")).crossJoin(both)
    return stats.variance_partition(r2)


@query("""SELECT spot, round(50 + (grid_col * 10 - 50) * cos(radians(30)) - (grid_row * 10 - 40) * sin(radians(30)) + 3, 6) AS moved_x, round(40 + (grid_col * 10 - 50) * sin(radians(30)) + (grid_row * 10 - 40) * cos(radians(30)) - 7, 6) AS moved_y FROM {spots}""")
def affine_register(spark, d):
    rows = view(spark, d, "spots").withColumns({"x": F.col("grid_col") * 10.0, "y": F.col("grid_row") * 10.0})
    return spatial.affine(rows, "x", "y", 30.0, 3.0, -7.0, (50.0, 40.0)).select("spot", F.round("moved_x", 6).alias("moved_x"), F.round("moved_y", 6).alias("moved_y"))


def _points(spark, d, condition: str):
    return view(spark, d, "spots").where(condition).select(F.col("sample").alias("part"), F.col("spot").alias("id"), F.col("grid_col").cast("double").alias("x"), F.col("grid_row").cast("double").alias("y"))


@query("""WITH p AS (SELECT a.sample AS part, a.spot AS id, b.spot AS other, CAST((a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col) AS DOUBLE) AS d2 FROM {spots} a JOIN {spots} b ON a.sample = b.sample WHERE a.cluster = 0 AND b.cluster = 1)
    SELECT s.sample AS part, s.spot AS id, other, d2 FROM spots s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM p) q ON q.id = s.spot AND k = 1 WHERE cluster = 0""")
def nearest_spot(spark, d):
    return spatial.nearest_spot(_points(spark, d, "cluster = 0"), _points(spark, d, "cluster = 1"))


@query("""WITH p AS (SELECT a.sample AS part, a.spot AS id, min((a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col)) AS d2 FROM {spots} a JOIN {spots} b ON a.sample = b.sample AND a.spot <> b.spot WHERE a.cluster <= 1 AND b.cluster <= 2 GROUP BY 1, 2)
    SELECT s.sample AS part, count(d2) AS n, round(median(sqrt(d2)), 9) AS median_distance FROM spots s LEFT JOIN p ON p.id = s.spot WHERE s.cluster <= 1 GROUP BY s.sample""")
def nearest_excl_self_median(spark, d):
    out = spatial.nearest_median(_points(spark, d, "cluster <= 1"), _points(spark, d, "cluster <= 2"))
    return out.withColumn("median_distance", F.round("median_distance", 9))


@query("""SELECT spot, CASE WHEN cluster = 4 OR EXISTS (SELECT 1 FROM {spots} b WHERE b.cluster = a.cluster AND b.spot <> a.spot AND abs(a.grid_row - b.grid_row) <= 1 AND abs(a.grid_col - b.grid_col) <= 1) THEN CASE WHEN cluster = 4 THEN 'none' ELSE concat('L', cluster) END ELSE 'none' END AS layer FROM {spots} a""")
def grid_neighbor_filter(spark, d):
    rows = view(spark, d, "spots").withColumn("layer", F.when(F.col("cluster") == 4, "none").otherwise(F.concat(F.lit("L"), F.col("cluster"))))
    return spatial.drop_isolated(rows, [], "spot", "grid_row", "grid_col", "layer").select("spot", "layer")


@query("""WITH w AS (SELECT event_id, value / 500 AS a, (user_id % 10) / 10.0::DOUBLE AS b, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 0.3::DOUBLE END AS c, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 0.1::DOUBLE END AS other FROM {event})
    SELECT event_id, CASE WHEN c IS NULL OR other IS NULL THEN 'none' WHEN (CASE WHEN a >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN b >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN c >= 0.5 THEN 1 ELSE 0 END) <> 1 THEN 'none'
      WHEN a >= 0.5 AND a - greatest(b, c) >= 0.1 THEN 'A' WHEN b >= 0.5 AND b - greatest(a, c) >= 0.1 THEN 'B' ELSE 'none' END AS layer FROM w""")
def layer_call(spark, d):
    rows = view(spark, d, "event").select("event_id", (F.col("value") / 500).alias("a"), (F.col("user_id") % 10 / 10.0).alias("b"), F.when(F.col("event_id") % 13 != 0, F.lit(0.3)).alias("c"), F.when(F.col("event_id") % 7 != 0, F.lit(0.1)).alias("other"))
    return spatial.call_layer(rows, {"A": ["a"], "B": ["b"], "C": ["c"]}, F.lit(True), 0.5, 0.1, ["other"]).select("event_id", "layer")


@query("WITH u AS (SELECT DISTINCT sample, grid_row FROM {spots}), g AS (SELECT sample, grid_row - lag(grid_row) OVER (PARTITION BY sample ORDER BY grid_row) AS g FROM u) SELECT sample, CAST(min(g) AS BIGINT) AS pitch FROM g GROUP BY sample")
def grid_pitch(spark, d):
    return spatial.grid_pitch(view(spark, d, "spots"), "sample", "grid_row")


KNN = """p AS (SELECT a.id, b.id AS other, list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS d2 FROM {vectors} a JOIN {vectors} b ON a.id <> b.id),
    knn AS (SELECT id, other, d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank FROM p) WHERE rank <= 5)"""


def _knn(spark, d, k: int = 5):
    return graph.knn(view(spark, d, "vectors").select("id", "vec"), k)


@query(f"WITH {KNN} SELECT id, other, round(d2, 6) AS d2, rank FROM knn")
def knn_exact(spark, d):
    return _knn(spark, d).withColumn("d2", F.round("d2", 6))


@query(f"""WITH {KNN}, m AS (SELECT id, other FROM knn UNION ALL SELECT DISTINCT id, id FROM knn), s AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM m x JOIN m y ON x.other = y.other AND x.id < y.id GROUP BY 1, 2)
    SELECT a, b, s / CAST(12 - s AS DOUBLE) AS weight FROM s WHERE s / CAST(12 - s AS DOUBLE) > 1.0 / 15""")
def snn_jaccard_incl_self(spark, d):
    return graph.shared_neighbors(_knn(spark, d), 5, True, 1 / 15)


@query(f"""WITH {KNN}, s AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM knn x JOIN knn y ON x.other = y.other AND x.id < y.id GROUP BY 1, 2) SELECT a, b, s / CAST(10 - s AS DOUBLE) AS weight FROM s""")
def snn_shared_excl_self(spark, d):
    return graph.shared_neighbors(_knn(spark, d), 5, False)


@query(f"WITH {KNN} SELECT least(id, other) AS a, greatest(id, other) AS b, round(sqrt(max(d2)), 6) AS distance FROM knn GROUP BY 1, 2")
def knn_distances(spark, d):
    return graph.distance_graph(_knn(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {KNN} SELECT k.id, v.label AS feature, CAST(count(*) AS DOUBLE) / 5 AS value FROM knn k JOIN vectors v ON k.other = v.id GROUP BY 1, 2")
def knn_smooth(spark, d):
    values = view(spark, d, "vectors").select("id", F.col("label").alias("feature"), F.lit(1.0).alias("value"))
    return graph.smooth(values, _knn(spark, d), 5)


@query(f"""WITH {KNN.replace("rank <= 5", "rank <= 15")}, b AS (SELECT id, sqrt(d2) AS b FROM knn WHERE rank = 5),
    a AS (SELECT knn.id, other, CASE WHEN d2 = 0 THEN 1 WHEN b > 0 THEN exp(-power(sqrt(d2) / b, 1.0)) ELSE 0 END AS a FROM knn JOIN b ON b.id = knn.id),
    y AS (SELECT id, other, sum(a) / 2 AS a FROM (SELECT * FROM a WHERE a >= 0.0001 UNION ALL SELECT other, id, a FROM a WHERE a >= 0.0001) GROUP BY 1, 2 UNION ALL SELECT id, id, 1.0 FROM vectors),
    w AS (SELECT id, other, a / sum(a) OVER (PARTITION BY id) AS w FROM y), s0 AS (SELECT id, CASE WHEN id % 3 = 0 THEN CAST(label AS DOUBLE) ELSE 0 END AS v, CASE WHEN id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS m FROM vectors),
    s1 AS (SELECT w.id, sum(w * v) AS v, sum(w * m) AS m FROM w JOIN s0 ON w.other = s0.id GROUP BY w.id), s2 AS (SELECT w.id, sum(w * v) AS v, sum(w * m) AS m FROM w JOIN s1 ON w.other = s1.id GROUP BY w.id)
    SELECT id, round(CASE WHEN m > 0 THEN v / m END, 6) AS value FROM s2""")
def masked_diffusion_t(spark, d):
    rows = view(spark, d, "vectors")
    operator = graph.diffusion_operator(staged(_knn(spark, d, 15), "near"), 5)
    out = graph.diffuse(rows.where("id % 3 = 0").select("id", F.col("label").cast("double").alias("value")), rows.select("id"), operator, 2)
    return out.withColumn("value", F.round("value", 6))


@query()
def leiden(spark, d):
    return graph.communities(graph.shared_neighbors(_knn(spark, d, 10), 10, False), repeats=2)


@query("""WITH v AS (SELECT m, id, CAST(CASE m WHEN 1 THEN vec[1:32] ELSE vec[33:64] END AS DOUBLE[]) AS vec FROM {vectors}, range(1, 3) t(m)),
    d AS (SELECT x.m, x.id, y.id AS other, list_distance(x.vec, y.vec) AS d FROM v x JOIN v y ON x.m = y.m AND x.id <> y.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY m, id ORDER BY d, other) AS k FROM d), f AS (SELECT m, id, d AS d1 FROM n WHERE k = 1),
    l AS (SELECT m, id, other FROM n WHERE k <= 5 UNION ALL SELECT m, id, id FROM v),
    s AS (SELECT a.m, a.id, b.id AS other, count(*) AS s FROM l a JOIN l b ON a.m = b.m AND a.other = b.other AND a.id <> b.id GROUP BY 1, 2, 3),
    h AS (SELECT m, id, avg(d) AS h FROM (SELECT m, id, d, row_number() OVER (PARTITION BY m, id ORDER BY s, d DESC, other) AS j FROM s JOIN d USING (m, id, other)) WHERE j <= 5 GROUP BY m, id),
    p AS (SELECT x.m, g.m AS g, g.id, i, avg(x.vec[i]) AS y FROM n g JOIN v x ON x.id = g.other, range(1, 33) t(i) WHERE g.k <= 5 GROUP BY 1, 2, 3, 4),
    q AS (SELECT m, g, id, sqrt(sum((vec[i] - y) * (vec[i] - y))) AS d FROM p JOIN v USING (m, id) GROUP BY 1, 2, 3),
    e AS (SELECT m, g, id, exp(-greatest(d - d1, 0) / greatest(h - d1, 1e-12)) AS e FROM q JOIN f USING (m, id) JOIN h USING (m, id)),
    r AS (SELECT m, id, max(CASE WHEN m = g THEN e END) / (max(CASE WHEN m <> g THEN e END) + 1e-4) AS r FROM e GROUP BY 1, 2), w AS (SELECT a.m, a.id, 1 / (1 + exp(b.r - a.r)) AS w FROM r a JOIN r b ON a.id = b.id AND a.m <> b.m),
    c AS (SELECT DISTINCT id, other FROM n WHERE k <= 20),
    z AS (SELECT id, other, sum(w * exp(-greatest(d - d1, 0) / greatest(h - d1, 1e-12))) AS weight, max(CASE WHEN m = 1 THEN w END) AS first_weight FROM c JOIN d USING (id, other) JOIN f USING (m, id) JOIN h USING (m, id) JOIN w USING (m, id) GROUP BY 1, 2)
    SELECT id, other, round(weight, 6) AS weight, k AS rank, round(first_weight, 6) AS first_weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) AS k FROM z) WHERE k <= 5""")
def wnn(spark, d):
    rows = view(spark, d, "vectors")
    half = lambda a: rows.select("id", F.slice("vec", a, 32).alias("vec"))
    return graph.weighted_neighbors(half(1), half(33), 5, 20).withColumns({c: F.round(c, 6) for c in ("weight", "first_weight")})


def _pair_inputs(spark, d):
    """Scaled values, spots in steps of 100 and the pairs of genes that lie 20 apart."""
    values = matrix.normalize(view(spark, d, "counts"), "spot", "n").select(F.col("spot").alias("id"), "gene", F.col("scaled").alias("value"))
    pairs = view(spark, d, "genes").select(F.col("gene").alias("pair"), F.col("gene").alias("ligand"), (F.col("gene") + 20).alias("receptor"))
    return values, _points(spark, d, "true").withColumns({"x": F.col("x") * 100, "y": F.col("y") * 100}), pairs


@query("""WITH v AS (SELECT spot, gene, n * 10000.0::DOUBLE / sum(n) OVER (PARTITION BY spot) AS v FROM {counts}), k AS (SELECT gene AS pair, gene AS ligand, gene + 20 AS receptor FROM {genes}),
    w AS (SELECT a.spot AS id, b.spot AS other, exp(-10000.0::DOUBLE * ((a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col)) / (2 * 125 * 125)) AS w
      FROM {spots} a JOIN spots b ON a.sample = b.sample AND (a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col) <= 6.25),
    t AS (SELECT id, sum(w) AS t FROM w GROUP BY id), g AS (SELECT w.id, k.pair, k.receptor, sum(w.w * v.v) AS g FROM w JOIN v ON v.spot = w.other JOIN k ON k.ligand = v.gene GROUP BY 1, 2, 3)
    SELECT g.id, g.pair, round(g.g / t.t * v.v, 6) AS score FROM g JOIN t ON t.id = g.id JOIN v ON v.spot = g.id AND v.gene = g.receptor""")
def lr_score(spark, d):
    return spatial.pair_scores(*_pair_inputs(spark, d)).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT spot, gene, n * 10000.0::DOUBLE / sum(n) OVER (PARTITION BY spot) AS v FROM {counts}), k AS (SELECT gene AS pair, gene AS ligand, gene + 20 AS receptor FROM {genes}),
    w AS (SELECT a.spot AS id, b.spot AS other, exp(-10000.0::DOUBLE * ((a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col)) / (2 * 125 * 125)) AS w
      FROM {spots} a JOIN spots b ON a.sample = b.sample AND a.spot <> b.spot AND (a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col) <= 6.25),
    t AS (SELECT id, sum(w) AS t FROM w GROUP BY id), g AS (SELECT w.id, k.pair, k.ligand, sum(w.w * v.v) AS g FROM w JOIN v ON v.spot = w.other JOIN k ON k.receptor = v.gene GROUP BY 1, 2, 3)
    SELECT g.id, g.pair, round(g.g / t.t * v.v, 6) AS score FROM g JOIN t ON t.id = g.id JOIN v ON v.spot = g.id AND v.gene = g.ligand""")
def lr_score_outgoing(spark, d):
    return spatial.pair_scores(*_pair_inputs(spark, d), include_self=False, direction="outgoing").withColumn("score", F.round("score", 6))


@query("""SELECT a.spot AS id, count(b.spot) > 0 AS score_available FROM {spots} a LEFT JOIN spots b ON a.sample = b.sample AND a.spot <> b.spot
    AND (a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col) <= 6.25 GROUP BY a.spot""")
def scored_spots(spark, d):
    return spatial.score_available(_pair_inputs(spark, d)[1], include_self=False).select("id", "score_available")


@query("""WITH c AS (SELECT * FROM {counts}), r AS (SELECT spot, CAST(sum(n) AS DOUBLE) AS r FROM c GROUP BY spot), g AS (SELECT gene, CAST(sum(n) AS DOUBLE) AS c FROM c GROUP BY gene), t AS (SELECT sum(r) AS t FROM r), k AS (SELECT count(*) AS m FROM {spots}),
    f AS (SELECT s.spot, g.gene, coalesce(r, 0) * g.c / t AS mu, coalesce(c.n, 0) AS n, sqrt(m) AS lim FROM spots s CROSS JOIN g CROSS JOIN t CROSS JOIN k LEFT JOIN r ON r.spot = s.spot LEFT JOIN c ON c.spot = s.spot AND c.gene = g.gene)
    SELECT gene, round(var_pop(greatest(-lim, least(lim, coalesce((n - mu) / nullif(sqrt(mu + mu * mu / 100), 0), 0)))), 6) AS variance FROM f GROUP BY gene""")
def pearson_hvg(spark, d):
    out = linalg.residual_variance(view(spark, d, "counts"), view(spark, d, "spots"))
    return out.withColumn("variance", F.round("variance", 6))


@query()
def pca_block(spark, d):
    rows = view(spark, d, "planted").groupBy(F.col("spot").alias("row"), (F.col("gene") % 110).alias("col")).agg(F.log1p(F.sum("n")).alias("value"))
    return linalg.pca(rows, view(spark, d, "spots").select(F.col("spot").alias("id")), 4)[0]


@query()
def iter_pca_impute(spark, d):
    rows = view(spark, d, "observed").select(F.col("spot").alias("row"), F.col("feature").alias("col"), (F.col("num") / (10 * F.col("den"))).alias("value"))
    return linalg.impute_pca(rows, 3, start_at_mean=True, bounds=(0.0, 1.0))[2]


@query()
def nmf_consensus(spark, d):
    counts, spots = view(spark, d, "planted"), view(spark, d, "spots")
    counted = spots.join(counts, "spot", "left_semi")
    entries = programs.program_input(counts, counted, programs.overdispersed_genes(counts, spots, 500), empty_spots=True)
    return programs.all_usages(mapping.consensus(entries, 5, runs=20)[1], counted, 5)


@query("""SELECT p_brand, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(DISTINCT l_suppkey) AS spots FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_discount >= 0.05 GROUP BY p_brand""")
def pruned_scan(spark, d):
    rows = table(spark, d, "lineitem").where("l_discount >= 0.05").select("l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rows.join(parts, "l_partkey").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.count_distinct("l_suppkey").alias("spots"))


@query("""WITH u AS (SELECT gene AS unit, gene AS a, gene + 3 AS b, symbol FROM {genes}),
    i AS (SELECT u.unit, count(*) AS n, min(g.gene) AS one, count(*) FILTER (g.symbol = u.symbol) AS m, min(g.gene) FILTER (g.symbol = u.symbol) AS hit FROM u JOIN genes g ON g.gene IN (a, b) AND g.gene % 4 <> 0 GROUP BY u.unit),
    s AS (SELECT symbol, count(*) AS k, min(gene) AS named FROM genes WHERE gene % 4 <> 0 GROUP BY symbol)
    SELECT u.unit, CAST(0 AS BIGINT) AS position, u.symbol, CASE WHEN n = 1 THEN one WHEN n > 1 THEN CASE WHEN m = 1 THEN hit END WHEN k = 1 THEN named END AS gene
    FROM u LEFT JOIN i ON u.unit = i.unit LEFT JOIN s ON u.symbol = s.symbol""")
def gene_resolution(spark, d):
    genes = view(spark, d, "genes").select(F.col("gene").cast("string").alias("gene"), "symbol")
    pairs = view(spark, d, "genes").select(F.col("gene").alias("unit"), F.concat_ws("|", F.col("gene").cast("string"), (F.col("gene") + 3).cast("string")).alias("ids"), F.col("symbol").alias("names"))
    found = mapping.resolve_genes(mapping.split_complexes(pairs, "unit", "ids", "names"), genes.where("CAST(gene AS BIGINT) % 4 <> 0"), "unit", "gene", "symbol")
    return found.select("unit", F.col("position").cast("long").alias("position"), "symbol", F.col("gene").cast("long").alias("gene"))


def _list_score(name: str, symbol: str, seed: int) -> str:
    return f"""{name}_l AS (SELECT b.gene, bin FROM b JOIN genes USING (gene) WHERE symbol = '{symbol}'),
    {name}_d AS (SELECT gene FROM (SELECT gene, row_number() OVER (PARTITION BY bin ORDER BY md5('{seed}:' || CAST(gene AS VARCHAR)), gene) AS r FROM b WHERE bin IN (SELECT bin FROM {name}_l) AND gene NOT IN (SELECT gene FROM {name}_l)) WHERE r <= 50),
    {name} AS (SELECT spot, coalesce(sum(v) FILTER (gene IN (SELECT gene FROM {name}_l)), 0) / (SELECT count(*) FROM {name}_l) - coalesce(sum(v) FILTER (gene IN (SELECT gene FROM {name}_d)), 0) / (SELECT count(*) FROM {name}_d) AS s FROM v GROUP BY spot)"""


@query(f"""WITH v AS (SELECT spot, gene, ln(1 + n * 10000.0::DOUBLE / sum(n) OVER (PARTITION BY spot)) AS v FROM {{counts}}), k AS (SELECT count(*) AS k FROM {{genes}}), m AS (SELECT gene, sum(v) / (SELECT count(*) FROM {{spots}}) AS m FROM v GROUP BY gene),
    b AS (SELECT gene, ntile(25) OVER (ORDER BY m, gene) AS bin FROM m), {_list_score("one", "SMALL", 0)}, {_list_score("two", "PROMO", 1)}
    SELECT s.spot, round(coalesce(one.s, 0), 6) + 0.0 AS s_score, round(coalesce(two.s, 0), 6) + 0.0 AS g2m_score, CASE WHEN one.s < 0 AND two.s < 0 THEN 'G1' WHEN two.s > one.s THEN 'G2M' ELSE 'S' END AS phase
    FROM spots s LEFT JOIN one ON one.spot = s.spot LEFT JOIN two ON two.spot = s.spot""")
def cell_cycle_phase(spark, d):
    values = matrix.normalize(view(spark, d, "counts"), "spot", "n").select("spot", "gene", F.log1p("scaled").alias("value"))
    lists = [view(spark, d, "genes").where(F.col("symbol") == s).select("gene") for s in ("SMALL", "PROMO")]
    return mapping.cell_cycle(values, view(spark, d, "spots"), *lists).withColumns({c: F.round(c, 6) + 0.0 for c in ("s_score", "g2m_score")})


@query()
def harmony(spark, d):
    return mapping.harmonize(view(spark, d, "vectors").select("id", F.pmod(F.col("id"), F.lit(3)).alias("batch"), "vec"))[0]


FANO = """t AS (SELECT spot, gene, n * 1000000.0::DOUBLE / sum(n) OVER (PARTITION BY spot) AS v FROM {planted}), m AS (SELECT count(*) AS m FROM {spots}),
    g AS (SELECT gene, sum(v) / m AS mean, greatest(0, sum(v * v) / m - (sum(v) / m) * (sum(v) / m)) AS var FROM t, m GROUP BY gene, m), f AS (SELECT *, var / mean AS fano FROM g),
    a AS (SELECT min(cv) AS a FROM (SELECT sqrt(var) / mean AS cv FROM f ORDER BY mean DESC, gene LIMIT 20)),
    q AS (SELECT quantile_cont(mean, 0.1) AS ml, quantile_cont(mean, 0.9) AS mh, quantile_cont(fano, 0.1) AS fl, quantile_cont(fano, 0.9) AS fh FROM f),
    b AS (SELECT median(fano) AS b2 FROM f, q WHERE mean > ml AND mean < mh AND fano > fl AND fano < fh),
    r AS (SELECT gene, round(fano / nullif(a * a * mean + b2, 0), 9) AS ratio FROM f, a, b)"""


@query(f"WITH {FANO} SELECT gene, round(ratio, 6) AS ratio, rank FROM (SELECT *, row_number() OVER (ORDER BY ratio DESC, gene) AS rank FROM r) WHERE rank <= 500")
def overdispersed_genes(spark, d):
    out = programs.overdispersed_genes(view(spark, d, "planted"), view(spark, d, "spots"), 500)
    return out.withColumn("ratio", F.round("ratio", 6))


@query()
def consensus_programs(spark, d):
    counts, spots = view(spark, d, "planted"), view(spark, d, "spots")
    return programs.programs(counts, spots.join(counts, "spot", "left_semi"), 5, new_folder(spark, "grid"), 500, runs=20, empty_spots=True)[0]


def _types(spark, d):
    cells = view(spark, d, "planted").withColumnRenamed("spot", "cell")
    return deconvolve.type_profiles(cells, view(spark, d, "spots").select(F.col("spot").alias("cell"), F.concat(F.lit("t"), "cluster").alias("type")))


@query()
def deconvolution(spark, d):
    counts, spots = view(spark, d, "planted"), view(spark, d, "spots")
    return mapping.expand_weights(spots, deconvolve.deconvolve(counts, _types(spark, d))[0], counts.select("spot").distinct())


@query()
def deconvolution_doublet(spark, d):
    return deconvolve.deconvolve(view(spark, d, "planted"), _types(spark, d), "doublet")[0].drop("weights")


@query()
def deconvolution_multi(spark, d):
    return deconvolve.deconvolve(view(spark, d, "planted"), _types(spark, d), "multi")[0].drop("weights")
