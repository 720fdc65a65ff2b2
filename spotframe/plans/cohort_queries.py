"""Queries on checked joins, alignment, summaries over fixed levels, wide tables and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import cohorts, spatial, tables

from .registry import query
from .views import table, view


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey")
def checked_lookup(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return cohorts.lookup(lines, table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@query("SELECT s.spot, s.cluster, r.n, v.label FROM {spots} s JOIN (SELECT spot, sum(n) AS n FROM {counts} GROUP BY spot) r ON s.spot = r.spot JOIN {vectors} v ON v.id = s.spot")
def one_to_one_chain(spark, d):
    sums = view(spark, d, "counts").groupBy("spot").agg(F.sum("n").alias("n"))
    return cohorts.one_to_one([view(spark, d, "spots").select("spot", "cluster"), sums, view(spark, d, "vectors").select(F.col("id").alias("spot"), "label")], "spot")


@query("SELECT spot, cluster FROM {spots} WHERE cluster IN (1, 3)")
def cluster_subset(spark, d):
    return cohorts.members_only(view(spark, d, "spots").select("spot", "cluster"), "cluster", [1, 3])


@query("""WITH p AS (SELECT spot AS ref, spot + 1 AS own FROM {spots} WHERE spot % 3 <> 0) SELECT p.ref, p.own AS source_own, o.grid_row AS source_grid_row, o.cluster, r.grid_row FROM p JOIN spots o ON o.spot = p.own JOIN spots r ON r.spot = p.ref""")
def align_modalities(spark, d):
    spots = view(spark, d, "spots")
    pairs = spots.where("spot % 3 <> 0").select((F.col("spot") + 1).alias("own"), F.col("spot").alias("ref"))
    out = cohorts.align(spots.select(F.col("spot").alias("own"), "grid_row", "cluster"), spots.select(F.col("spot").alias("ref"), "grid_row"), pairs, "own", "ref", ["grid_row"])
    return out.select("ref", "source_own", "source_grid_row", "cluster", "grid_row")


@query("SELECT s.spot, coalesce(n_name, 'none') AS n_name FROM {spots} s LEFT JOIN (SELECT n_nationkey, n_name FROM {nation} WHERE n_nationkey < 3) n ON s.cluster = n_nationkey")
def attach_annotation(spark, d):
    names = table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").cast("long").alias("cluster"), "n_name")
    return cohorts.attach(view(spark, d, "spots").select("spot", "cluster"), names, "cluster", n_name="none").select("spot", "n_name")


@query("SELECT s.spot, CASE WHEN s.spot % 4 = 0 THEN s.grid_col ELSE s.grid_row END AS grid_row FROM {spots} s")
def override_coordinates(spark, d):
    spots = view(spark, d, "spots")
    return cohorts.override(spots.select("spot", "grid_row"), spots.where("spot % 4 = 0").select("spot", F.col("grid_col").alias("grid_row")), "spot", ["grid_row"])


@query("SELECT c.spot, s.sample, c.n FROM (SELECT * FROM {spots} WHERE cluster < 2) s RIGHT JOIN (SELECT spot, CAST(sum(n) AS BIGINT) AS n FROM {counts} GROUP BY spot) c ON s.spot = c.spot")
def metadata_with_usage(spark, d):
    usage = view(spark, d, "counts").groupBy("spot").agg(F.sum("n").alias("n"))
    return cohorts.with_usage(view(spark, d, "spots").where("cluster < 2").select("spot", "sample"), usage, "spot")


@query("""WITH c AS (SELECT feature, count(*) AS covered FROM {observed} GROUP BY feature), t AS (SELECT count(*) AS total FROM {spots})
    SELECT feature, covered, CAST(covered AS DOUBLE) / total AS coverage_fraction, CASE WHEN CAST(covered AS DOUBLE) / total >= 0.5 THEN 'ok' ELSE 'low_coverage' END AS status FROM c, t""")
def coverage_status(spark, d):
    n = view(spark, d, "spots").agg(F.count("*").alias("total"))
    rows = view(spark, d, "observed").groupBy("feature").agg(F.count("*").alias("covered")).crossJoin(F.broadcast(n))
    return cohorts.coverage_status(rows, "covered", "total").drop("total")


@query("SELECT event_id FROM {event} WHERE value > 100")
def available_scores(spark, d):
    return cohorts.available(view(spark, d, "event").select("event_id", F.when(F.col("event_id") >= 0, F.col("value") > 100).alias("score_available"))).select("event_id")


@query("""SELECT position, level, (SELECT count(*) FROM {event} WHERE event_type = level) AS n, 100.0::DOUBLE * (SELECT count(*) FROM event WHERE event_type = level) / (SELECT count(*) FROM event) AS percent
    FROM (VALUES (0, 'view'), (1, 'none'), (2, 'click')) AS t(position, level)""")
def level_counts(spark, d):
    return cohorts.level_counts(view(spark, d, "event"), "event_type", ["view", "none", "click"])


@query("""WITH x AS (SELECT event_type, count(*) AS n_input, count(*) FILTER (value >= 200) AS n_umi_pass FROM {event} GROUP BY event_type)
    SELECT event_type, n_input, n_umi_pass, CASE WHEN n_umi_pass >= 25 THEN least(n_umi_pass, 500) ELSE 0 END AS n_used, CASE WHEN n_umi_pass >= 25 THEN 'retained' ELSE 'too_few_cells' END AS status FROM x""")
def reference_summary(spark, d):
    return cohorts.reference_summary(view(spark, d, "event"), "event_type", "value", 200, 25, 500)


@query("SELECT cluster, CAST(median(grid_row) AS DOUBLE) AS grid_row, CAST(median(grid_col) AS DOUBLE) AS grid_col FROM {spots} GROUP BY cluster")
def median_centroids(spark, d):
    return cohorts.median_centroids(view(spark, d, "spots"), "cluster", ["grid_row", "grid_col"])


@query("""WITH p AS (SELECT a.sample AS part, a.spot, min((a.grid_row - b.grid_row) * (a.grid_row - b.grid_row) + (a.grid_col - b.grid_col) * (a.grid_col - b.grid_col)) AS d2 FROM {spots} a JOIN {spots} b ON a.sample = b.sample AND a.spot <> b.spot GROUP BY 1, 2)
    SELECT s.sample AS part, count(d2) AS n, round(median(sqrt(d2)), 9) AS median_distance FROM spots s LEFT JOIN p ON p.spot = s.spot GROUP BY s.sample""")
def median_pitch(spark, d):
    points = view(spark, d, "spots").select(F.col("sample").alias("part"), F.col("spot").alias("id"), F.col("grid_col").cast("double").alias("x"), F.col("grid_row").cast("double").alias("y"))
    return spatial.nearest_median(points, points).withColumn("median_distance", F.round("median_distance", 9))


@query("SELECT cluster, gene, r AS rank FROM (SELECT cluster, gene, row_number() OVER (PARTITION BY cluster ORDER BY sum(n) DESC, gene) AS r FROM {counts} c JOIN {spots} s ON c.spot = s.spot GROUP BY 1, 2) WHERE r <= 10")
def top_program_genes(spark, d):
    sums = view(spark, d, "counts").join(view(spark, d, "spots").select("spot", "cluster"), "spot").groupBy("cluster", "gene").agg(F.sum("n").alias("n"))
    return tables.top_k(sums, ["cluster"], [F.desc("n"), F.col("gene")], 10).select("cluster", "gene", "rank")


@query("SELECT spot, CAST(row_number() OVER (ORDER BY cluster, spot) - 1 AS BIGINT) AS place FROM {spots}")
def order_by_cluster(spark, d):
    return cohorts.by_code(view(spark, d, "spots").select("spot", "cluster"), "cluster", "spot").select("spot", "place")


@query("""WITH c AS (SELECT event_type AS category, min(event_id) AS m FROM {event} GROUP BY 1)
    SELECT category, row_number() OVER (ORDER BY CASE category WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, m) - 1 AS place FROM c""")
def category_order(spark, d):
    return cohorts.category_order(view(spark, d, "event"), "event_type", "event_id", ["view", "absent", "purchase"])


@query("""SELECT user_id, CAST(sum(value) FILTER (event_type = 'view') AS DOUBLE) AS view, CAST(sum(value) FILTER (event_type = 'click') AS DOUBLE) AS click FROM {event} GROUP BY user_id""")
def wide_table(spark, d):
    out = cohorts.to_wide(view(spark, d, "event"), "user_id", "event_type", "value", ["view", "click"])
    return out.select("user_id", F.col("view").cast("double").alias("view"), F.col("click").cast("double").alias("click"))


@query("SELECT id, len(vec) * 2 AS n, round(2 * list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE) * x)), 5) AS square FROM {vectors}")
def stacked_embeddings(spark, d):
    rows = view(spark, d, "vectors").select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    out = cohorts.stack_vectors([rows, rows], "id", "vec")
    return out.select("id", F.size("vec").cast("long").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 5).alias("square"))


@query("SELECT gene, CASE WHEN count(*) OVER (PARTITION BY symbol, chrom) > 1 THEN concat(symbol, chrom, ' [', gene, ']') ELSE concat(symbol, chrom) END AS label FROM {genes}")
def name_labels(spark, d):
    rows = view(spark, d, "genes").select("gene", F.concat("symbol", "chrom").alias("name"))
    return cohorts.disambiguated(rows, "name", "gene").select("gene", "label")


@query("""WITH b AS (SELECT gene, regexp_replace(symbol || '#' || chrom, '[^A-Za-z0-9._-]+', '-', 'g') AS s FROM {genes}), k AS (SELECT gene, s, row_number() OVER (PARTITION BY s ORDER BY gene) AS k FROM b)
    SELECT gene, CASE WHEN k = 1 THEN s ELSE concat(s, '-', k) END AS slug FROM k""")
def file_slugs(spark, d):
    rows = view(spark, d, "genes").select("gene", F.concat("symbol", F.lit("#"), "chrom").alias("name"))
    return cohorts.file_slugs(rows, "name", "gene").select("gene", "slug")


@query("SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS whole, abs(value - round_even(value, 0)) <= 0.1 + 0.00001 * abs(round_even(value, 0)) AS near FROM {event}")
def whole_numbers(spark, d):
    whole = cohorts.round_half_even(F.col("value"))
    return view(spark, d, "event").select("event_id", whole.alias("whole"), cohorts.is_close(F.col("value"), whole, absolute=0.1).alias("near"))


@query("""WITH t AS (SELECT gene, chrom, strand, CASE WHEN strand = '+' THEN lo ELSE hi - 1 END AS tss FROM {genes}),
    p AS (SELECT r.region, t.gene, t.tss, t.strand, CASE WHEN r.lo <= tss AND tss < r.hi THEN 0 WHEN r.lo > tss THEN r.lo - tss ELSE tss - r.hi + 1 END AS gap, r.lo > tss AS rt FROM {regions} r JOIN t ON r.chrom = t.chrom),
    k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY gap, tss, gene) AS k FROM p)
    SELECT region, gene, CAST(CASE WHEN gap = 0 THEN 0 WHEN rt = (strand = '+') THEN gap ELSE -gap END AS BIGINT) AS distance FROM k WHERE k = 1""")
def signed_tss_distance(spark, d):
    return cohorts.signed_tss_distance(view(spark, d, "regions"), view(spark, d, "genes"), "region", "gene")


@query("""SELECT l_orderkey, l_linenumber, spot, cluster FROM {lineitem} JOIN {spots} s ON CAST(floor(l_suppkey / 10) AS BIGINT) = s.grid_row AND l_suppkey % 10 = s.grid_col""")
def composite_lookup(spark, d):
    place = [F.floor(F.col("l_suppkey") / 10).cast("long").alias("grid_row"), (F.col("l_suppkey") % 10).cast("long").alias("grid_col")]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *place)
    spots = view(spark, d, "spots").select("grid_row", "grid_col", "spot", "cluster")
    return cohorts.lookup(lines, spots, ["grid_row", "grid_col"]).select("l_orderkey", "l_linenumber", "spot", "cluster")


@query("""WITH c AS (SELECT spot, CAST(sum(n) AS BIGINT) AS n FROM {counts} GROUP BY spot) SELECT CASE WHEN s.grid_row > 99 THEN printf('%d_%02d', s.grid_row, s.grid_col) ELSE printf('%02d%02d', s.grid_row, s.grid_col) END AS key, s.spot, c.n FROM {spots} s JOIN c ON c.spot = s.spot""")
def spot_keys(spark, d):
    spots = view(spark, d, "spots").select("spot", F.format_string("%02d_%02d", "grid_row", "grid_col").alias("barcode"))
    wide = F.when(F.col("grid_row") > 99, F.format_string("%d_%02d", "grid_row", "grid_col")).otherwise(F.format_string("%02d%02d", "grid_row", "grid_col"))
    keys = view(spark, d, "spots").select("spot", wide.alias("key"))
    found = keys.join(view(spark, d, "counts").groupBy("spot").agg(F.sum("n").alias("n")), "spot").select("key", "n")
    return cohorts.spot_keys(spots, keys).join(found, "key").select("key", "spot", "n")


@query("""WITH c AS (SELECT DISTINCT s.sample, c.gene FROM {counts} c JOIN {spots} s ON c.spot = s.spot), k AS (SELECT gene FROM c GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample) FROM c))
    SELECT gene, symbol, chrom FROM {genes} JOIN k USING (gene)""")
def shared_pairs(spark, d):
    rows = view(spark, d, "counts").join(view(spark, d, "spots").select("spot", "sample"), "spot").join(view(spark, d, "genes").select("gene", "symbol", "chrom"), "gene")
    return tables.shared_rows(rows, "gene", "sample", ["symbol", "chrom"])
