"""Queries on bins, states, sets, lists and ladders."""

from __future__ import annotations

from pyspark.sql import functions as F


from spotframe.operators import tables

from .registry import query
from .views import table, view


@query("""SELECT chrom, CAST(floor(pos / 500) * 500 AS BIGINT) AS bin, count(*) AS n_sites, CAST(sum(meth) AS BIGINT) AS meth, CAST(sum(unmeth) AS BIGINT) AS unmeth,
    CAST(sum(pct) AS DOUBLE) / (count(*) * 100) AS mean_rate, CAST(sum(meth) AS DOUBLE) / (sum(meth) + sum(unmeth)) AS weighted_rate FROM {sites} GROUP BY 1, 2""")
def bin_agg_two_rates(spark, d):
    return tables.bin_rates(view(spark, d, "sites"), 500)


@query("""WITH a AS (SELECT chrom, CAST(floor(pos / 50) * 50 AS BIGINT) AS bin, count(*) AS n FROM {sites} WHERE spot % 2 = 0 GROUP BY 1, 2),
    b AS (SELECT chrom, CAST(floor(pos / 50) * 50 AS BIGINT) AS bin, count(*) AS n FROM {sites} WHERE spot % 2 = 1 GROUP BY 1, 2)
    SELECT chrom, bin, a.n AS n_1, b.n AS n_2 FROM a FULL OUTER JOIN b USING (chrom, bin)""")
def bin_full_outer_pair(spark, d):
    sites = view(spark, d, "sites")
    a, b = (tables.bin_rates(sites.where(F.col("spot") % 2 == k), 50).select("chrom", "bin", F.col("n_sites").alias("n")) for k in (0, 1))
    return tables.outer_pair(a, b, ["chrom", "bin"])


STATES = "states AS (SELECT DISTINCT chrom, pos, CAST(pos % 5 AS BIGINT) AS state FROM {sites} WHERE pos % 7 <> 0)"
DETAIL = f"""WITH {STATES}, m AS (SELECT s.spot, t.state, count(*) AS n, sum(s.pct) AS p FROM {{sites}} s JOIN states t ON s.chrom = t.chrom AND s.pos = t.pos GROUP BY 1, 2),
    dims AS (SELECT spot, state FROM (SELECT DISTINCT spot FROM {{spots}}) CROSS JOIN (SELECT DISTINCT state FROM states)),
    detail AS (SELECT dims.spot, dims.state, coalesce(n, 0) AS site_count, CASE WHEN n > 0 THEN CAST(p AS DOUBLE) / (n * 100) END AS rate, CAST(coalesce(p, 0) AS BIGINT) AS pct_sum FROM dims LEFT JOIN m ON dims.spot = m.spot AND dims.state = m.state)"""


def _detail(spark, d):
    sites = view(spark, d, "sites")
    states = sites.where(F.col("pos") % 7 != 0).select("chrom", "pos", (F.col("pos") % 5).alias("state")).distinct()
    return tables.state_detail(sites, states, view(spark, d, "spots"))


@query(f"{DETAIL} SELECT * FROM detail")
def state_detail(spark, d):
    return _detail(spark, d)


@query(f"""{DETAIL}, z AS (SELECT cluster, state FROM (SELECT DISTINCT cluster FROM spots) CROSS JOIN (SELECT DISTINCT state FROM detail)),
    f AS (SELECT s.cluster, t.state, count(*) AS k, sum(site_count) AS c, sum(pct_sum) AS p FROM detail t JOIN spots s ON t.spot = s.spot WHERE site_count >= 100 GROUP BY 1, 2)
    SELECT z.cluster, z.state, coalesce(k, 0) AS n_spots, CAST(coalesce(c, 0) AS BIGINT) AS n_sites, CASE WHEN c > 0 THEN CAST(p AS DOUBLE) / (c * 100) END AS pooled_rate FROM z LEFT JOIN f ON z.cluster = f.cluster AND z.state = f.state""")
def state_summary_dense(spark, d):
    return tables.state_summary(_detail(spark, d), view(spark, d, "spots"), "spot", "cluster", 100)


@query(f"""{DETAIL}, t AS (SELECT *, CAST(sum(site_count) OVER (PARTITION BY spot) AS BIGINT) AS total_sites FROM detail) SELECT * FROM t WHERE total_sites >= 500 AND site_count >= 100""")
def support_threshold(spark, d):
    return tables.support_threshold(_detail(spark, d), "spot", 500, 100)


@query("""WITH w AS (SELECT l_orderkey AS spot, l_suppkey AS part, l_discount AS ca, l_tax AS cc, CAST(l_linenumber AS DOUBLE) AS ct FROM {lineitem})
    SELECT spot, part, context, rate FROM w UNPIVOT (rate FOR context IN (ca, cc, ct))""")
def contexts_unpivot(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spot"), F.col("l_suppkey").alias("part"), F.col("l_discount").alias("ca"), F.col("l_tax").alias("cc"), F.col("l_linenumber").cast("double").alias("ct"))
    return tables.unpivot_rates(rows, ["spot", "part"], ["ca", "cc", "ct"])


@query("""WITH w AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS a, CASE WHEN event_id % 7 <> 0 THEN value * 2 END AS b, user_id AS reads FROM {event})
    SELECT event_id, user_id, a, b FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND reads >= 20""")
def complete_cases(spark, d):
    rows = view(spark, d, "event").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 7 != 0, F.col("value") * 2).alias("b"))
    return tables.complete_cases(rows, ["a", "b"], "user_id", 20)


@query("SELECT event_type, round(median(value), 6) AS middle, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.99), 6) AS cap FROM {event} GROUP BY event_type")
def context_quantiles(spark, d):
    return view(spark, d, "event").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("middle"), *[F.round(F.percentile("value", q), 6).alias(n) for n, q in (("q25", 0.25), ("q75", 0.75), ("cap", 0.99))])


@query("SELECT event_id, user_id FROM {event} WHERE user_id IN (SELECT spot FROM {spots} WHERE cluster = 1)")
def tissue_semi(spark, d):
    inside = view(spark, d, "spots").where("cluster = 1").select(F.col("spot").alias("user_id"))
    return view(spark, d, "event").select("event_id", "user_id").join(inside, "user_id", "left_semi")


@query("SELECT s.spot, s.grid_row, s.grid_col, coalesce(n, 0) AS sites FROM {spots} s LEFT JOIN (SELECT spot, count(*) AS n FROM {sites} GROUP BY spot) c ON s.spot = c.spot")
def coord_lookup(spark, d):
    found = view(spark, d, "sites").groupBy("spot").agg(F.count("*").alias("n"))
    return view(spark, d, "spots").join(found, "spot", "left").select("spot", "grid_row", "grid_col", F.coalesce("n", F.lit(0)).alias("sites"))


@query("""SELECT o_orderkey FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_linestatus = 'O')
    AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0)""")
def multi_semi(spark, d):
    rows, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    rich = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return rows.join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(lines.where("l_linestatus = 'O'"), "o_orderkey", "left_semi").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("""SELECT a.spot AS beta, b.spot AS mrna, c.spot AS taps FROM {spots} a JOIN {spots} b ON a.grid_row = b.grid_row AND b.grid_col = (a.grid_col + 1) % 10
    JOIN {spots} c ON a.grid_col = c.grid_col AND c.grid_row = (a.grid_row + 1) % 10""")
def three_way_overlap(spark, d):
    s = view(spark, d, "spots")
    b = s.select("grid_row", F.col("spot").alias("mrna"), F.col("grid_col").alias("bc"))
    c = s.select("grid_col", F.col("spot").alias("taps"), F.col("grid_row").alias("cr"))
    return s.join(b, "grid_row").where(F.col("bc") == (F.col("grid_col") + 1) % 10).join(c, "grid_col").where(F.col("cr") == (F.col("grid_row") + 1) % 10).select(F.col("spot").alias("beta"), "mrna", "taps")


@query("SELECT gene FROM {counts} c JOIN {spots} s ON c.spot = s.spot GROUP BY gene HAVING count(DISTINCT sample) = (SELECT count(DISTINCT sample) FROM spots)")
def set_intersect_n(spark, d):
    return tables.in_all(view(spark, d, "counts").join(view(spark, d, "spots").select("spot", "sample"), "spot"), "gene", "sample")


UNION_ROWS = """r AS (SELECT s.sample, c.gene, g.symbol, c.n FROM {counts} c JOIN {spots} s ON c.spot = s.spot JOIN {genes} g ON c.gene = g.gene WHERE c.n > 45)"""


def _annotated(spark, d):
    return view(spark, d, "counts").where("n > 45").join(view(spark, d, "spots").select("spot", "sample"), "spot").join(view(spark, d, "genes").select("gene", "symbol"), "gene")


@query(f"""WITH {UNION_ROWS}, k AS (SELECT gene, min(symbol) AS symbol FROM r GROUP BY gene), d AS (SELECT DISTINCT sample FROM r), t AS (SELECT sample, gene, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2)
    SELECT d.sample, k.gene, k.symbol, coalesce(t.n, 0) AS n FROM k CROSS JOIN d LEFT JOIN t ON t.sample = d.sample AND t.gene = k.gene""")
def outer_union_fill0(spark, d):
    return tables.outer_union(_annotated(spark, d), "gene", "sample", "symbol", "n")


@query(f"""WITH {UNION_ROWS}, k AS (SELECT gene FROM r GROUP BY gene HAVING count(DISTINCT sample) = (SELECT count(DISTINCT sample) FROM r))
    SELECT sample, gene, symbol, CAST(sum(n) AS BIGINT) AS n FROM r JOIN k USING (gene) GROUP BY 1, 2, 3""")
def inner_concat(spark, d):
    rows = tables.inner_concat(_annotated(spark, d), "gene", "sample", "symbol")
    return rows.groupBy("sample", "gene", "symbol").agg(F.sum("n").alias("n"))


@query("""WITH m AS (SELECT gene, bit_or(CASE WHEN cluster = 0 AND n > 20 THEN 1 ELSE 0 END | CASE WHEN cluster = 1 AND n > 20 THEN 2 ELSE 0 END | CASE WHEN cluster = 2 AND n > 20 THEN 4 ELSE 0 END) AS mask
    FROM {counts} c JOIN {spots} s ON c.spot = s.spot GROUP BY gene) SELECT CAST(mask AS BIGINT) AS mask, count(*) AS n FROM m GROUP BY 1""")
def venn_bitmask(spark, d):
    rows = view(spark, d, "counts").join(view(spark, d, "spots").select("spot", "cluster"), "spot")
    return tables.membership_counts(rows, "gene", [(F.col("cluster") == k) & (F.col("n") > 20) for k in range(3)])


@query("""SELECT sample, count(*) FILTER (cluster = 0) AS n_0, count(*) FILTER (cluster = 1) AS n_1, count(*) FILTER (cluster = 2) AS n_2, count(*) FILTER (cluster = 3) AS n_3, count(*) FILTER (cluster = 4) AS n_4 FROM {spots} GROUP BY sample""")
def crosstab_sample_cluster(spark, d):
    return tables.cross_table(view(spark, d, "spots"), "sample", "cluster", list(range(5)))


@query("""WITH d AS (SELECT cluster, sample FROM (SELECT DISTINCT cluster FROM {spots}) CROSS JOIN (SELECT DISTINCT sample FROM spots)),
    f AS (SELECT cluster, sample, count(*) AS n, sum(c.n) AS s FROM {counts} c JOIN spots USING (spot) WHERE c.n > 40 GROUP BY 1, 2)
    SELECT d.cluster, d.sample, coalesce(f.n, 0) AS n, CASE WHEN f.n > 0 THEN CAST(s AS DOUBLE) / f.n END AS mean FROM d LEFT JOIN f ON d.cluster = f.cluster AND d.sample = f.sample""")
def group_mean_dense(spark, d):
    spots = view(spark, d, "spots")
    rows = view(spark, d, "counts").where("n > 40").join(spots.select("spot", "cluster", "sample"), "spot")
    return tables.dense_means(rows, {"cluster": spots, "sample": spots}, "n")


@query("""WITH m AS (SELECT gene, symbol, CASE WHEN gene % 11 = 0 THEN NULL ELSE gene END AS g FROM {genes}), e AS (SELECT gene, count(*) AS k FROM {counts} WHERE n > 0 GROUP BY gene)
    SELECT symbol, min(CASE WHEN g IS NULL THEN 0.0::DOUBLE ELSE coalesce(100.0::DOUBLE * k / (SELECT count(*) FROM {spots}), 0.0::DOUBLE) END) AS percent FROM m LEFT JOIN e ON m.g = e.gene GROUP BY symbol""")
def lr_filter_complex(spark, d):
    members = view(spark, d, "genes").select("symbol", F.when(F.col("gene") % 11 != 0, F.col("gene")).alias("gene"))
    return tables.complex_percent(view(spark, d, "counts"), view(spark, d, "spots").count(), "gene", members, "symbol")


@query("""WITH l AS (SELECT o_orderkey AS region, concat(CAST(o_custkey AS VARCHAR), ';', CAST(o_custkey * 3 AS VARCHAR), ';') AS ids FROM {orders}),
    x AS (SELECT region, unnest([split_part(ids, ';', 1), split_part(ids, ';', 2)]) AS gene_id, unnest([0, 1]) AS position FROM l)
    SELECT region, position, gene_id, CASE WHEN EXISTS (SELECT 1 FROM {genes} g WHERE CAST(g.gene AS VARCHAR) = gene_id) THEN 'linked' ELSE 'missing' END AS status FROM x""")
def list_fk_explode(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("region"), F.concat(F.col("o_custkey").cast("string"), F.lit(";"), (F.col("o_custkey") * 3).cast("string"), F.lit(";")).alias("ids"))
    genes = view(spark, d, "genes").select(F.col("gene").cast("string").alias("gene"))
    return tables.linked_status(tables.explode_list(rows, "ids", "gene_id").drop("ids"), genes, "gene_id", "gene")


@query("""SELECT event_id, CASE WHEN value > 450 THEN 'invalid' WHEN user_id % 4 = 0 THEN 'not_converged' WHEN value > 100 THEN 'fitted' WHEN event_type = 'click' THEN 'filtered' ELSE 'new' END AS status FROM {event}""")
def status_ladder(spark, d):
    rungs = [(F.col("event_type") == "click", "filtered"), (F.col("value") > 100, "fitted"), (F.col("user_id") % 4 == 0, "not_converged"), (F.col("value") > 450, "invalid")]
    return tables.status_ladder(view(spark, d, "event"), rungs, "new").select("event_id", "status")


@query("""WITH r AS (SELECT label, count(*) AS n, min(id) AS m FROM {vectors} GROUP BY label) SELECT id, CAST(c AS BIGINT) AS cluster FROM vectors JOIN (SELECT label, row_number() OVER (ORDER BY n DESC, m) - 1 AS c FROM r) USING (label)""")
def relabel_by_size(spark, d):
    return tables.relabel_by_size(view(spark, d, "vectors").select("id", "label"), "id", "label")


@query("WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 250) DESC, event_id) AS r FROM {event}) SELECT user_id, event_id, value, r AS rank FROM x WHERE r <= 5")
def topk_stable(spark, d):
    rows = view(spark, d, "event").select("user_id", "event_id", "value")
    return tables.top_k(rows, ["user_id"], [F.desc(F.abs(F.col("value") - 250)), F.col("event_id")], 5)


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM {lineitem}) SELECT l_orderkey, l_linenumber, l_partkey FROM x WHERE r = 1")
def keep_first(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return tables.keep_first(rows, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")]).drop("l_suppkey", "l_quantity")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {event}")
def json_scalar(spark, d):
    return view(spark, d, "event").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, event_type, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) AS DOUBLE) / sum(sum(c)) OVER (PARTITION BY user_id) AS fraction FROM (SELECT user_id, event_type, 1 AS c FROM {event}) GROUP BY 1, 2")
def row_fractions(spark, d):
    counts = view(spark, d, "event").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return tables.row_fractions(counts, ["user_id"], "n")


@query("WITH x AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || CAST(event_id AS VARCHAR)), event_id) AS r FROM {event}) SELECT event_id, event_type FROM x WHERE r <= 100")
def hash_downsample(spark, d):
    return tables.downsample(view(spark, d, "event").select("event_id", "event_type"), "event_type", "event_id", 100)


@query("""SELECT user_id, CAST(least(19, floor(coalesce((value - lo) / nullif(hi - lo, 0) * 20, 0))) AS BIGINT) AS bin, count(*) AS n FROM {event}, (SELECT min(value) AS lo, max(value) AS hi FROM event) GROUP BY 1, 2""")
def shared_histogram(spark, d):
    from spotframe.functions.columns import width_bin

    rows = view(spark, d, "event")
    span = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rows.crossJoin(F.broadcast(span)).groupBy("user_id", width_bin(F.col("value"), F.col("lo"), F.col("hi"), 20).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT user_id, n, CAST(row_number() OVER (ORDER BY n DESC, user_id) AS BIGINT) AS rank FROM (SELECT user_id, count(*) AS n FROM {event} GROUP BY user_id)")
def rank_plot(spark, d):
    from pyspark.sql import Window

    counts = view(spark, d, "event").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).cast("long"))


@query("""WITH h AS (SELECT feature AS pattern, spot AS feature, CAST(num AS DOUBLE) AS value FROM {observed}), t AS (SELECT pattern, sum(value) AS s FROM h GROUP BY pattern)
    SELECT h.pattern, h.feature, value / CASE WHEN s > 0 THEN s ELSE 1.0::DOUBLE END AS value FROM h JOIN t USING (pattern)""")
def factor_rescale(spark, d):
    from spotframe.operators.linalg import rescale_factors

    h = view(spark, d, "observed").select(F.col("feature").alias("pattern"), F.col("spot").alias("feature"), F.col("num").cast("double").alias("value"))
    w = h.select(F.col("feature").alias("id"), "pattern", "value")
    return rescale_factors(w, h)[1]


@query("""SELECT user_id, CAST(sum(value) AS DOUBLE) >= 0 AS positive, count(*) AS n FROM {event} WHERE value BETWEEN 50 AND 400 AND event_type IN ('click', 'view') GROUP BY user_id""")
def range_and_label_filter(spark, d):
    rows = view(spark, d, "event").where(F.col("value").between(50, 400) & F.col("event_type").isin("click", "view"))
    return rows.groupBy("user_id").agg((F.sum("value") >= 0).alias("positive"), F.count("*").alias("n"))


