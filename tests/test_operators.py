"""Edge rules by hand-made tables, and numerical operators against NumPy."""

import math
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from spotframe.expect import Violation, expect, require_same_ids
from spotframe.functions import columns as C
from spotframe.operators import graph, intervals, linalg, matrix, spatial, stats, tables


def test_support_is_counted_before_rows_go(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)], "spot string, feature int")
    got = matrix.support_filter(rows, "spot", "feature", 2, 3)
    assert got.count() == 0  # feature 1 had three spots, but one of them went first


def test_interval_touch_is_no_overlap(spark):
    a = spark.createDataFrame([("c", 10, 20, 1)], "chrom string, lo long, hi long, id int")
    b = spark.createDataFrame([("c", 20, 30, 1), ("c", 0, 10, 2), ("c", 19, 21, 3), ("d", 10, 20, 4)], "chrom string, lo long, hi long, id int")
    assert [r["r_id"] for r in intervals.overlap_join(a, b, 7).collect()] == [3]


def test_promoter_of_minus_strand_starts_at_zero(spark):
    genes = spark.createDataFrame([("c", 100, 300, "-"), ("c", 100, 300, "+")], "chrom string, lo long, hi long, strand string")
    assert [(r["lo"], r["hi"]) for r in intervals.promoters(genes).collect()] == [(0, 2299), (0, 600)]


def test_overlap_against_nested_loop(spark):
    rng = np.random.default_rng(0)
    make = lambda n, s: [("xy"[rng.integers(2)], int(lo), int(lo + rng.integers(1, s)), i) for i, lo in enumerate(rng.integers(0, 3000, n))]
    x, y = make(200, 400), make(200, 60)
    schema = "chrom string, lo long, hi long, id int"
    got = sorted((r["id"], r["r_id"]) for r in intervals.overlap_join(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), 100).collect())
    assert got == sorted((a[3], b[3]) for a in x for b in y if a[0] == b[0] and a[1] < b[2] and a[2] > b[1])


def test_body_bins_of_both_tools_differ_on_minus(spark):
    gene = spark.createDataFrame([(p, 0, 50, "-") for p in range(50)], "pos long, lo long, hi long, strand string")
    edges = [r["at"] for r in gene.limit(1).select(F.inline(intervals.profile_edges())).orderBy("edge").collect()]
    assert len(edges) == 161 and edges[30] == 50 and edges[130] == 0 and edges[0] == 3050 and edges[160] == -3000
    for r in gene.select("pos", intervals.gene_bin(F.col("pos")).alias("a")).collect():
        b = [i for i in range(160) if edges[i + 1] <= r["pos"] < edges[i]]
        assert len(b) == 1 and b[0] - 30 == 2 * (49 - r["pos"]) != r["a"] - 20


def test_profile_equals_a_loop_over_genes_and_sites(spark):
    rng = np.random.default_rng(8)
    sites = [("xy"[rng.integers(2)], int(p), float(rng.integers(0, 1001)) / 7) for p in rng.integers(0, 9000, 300)] + [("x", 0, 100.0), ("x", 0, 50.0)]
    genes = [(i, "xyz"[i % 3], int(lo), int(lo + rng.integers(1, 900)), "+-"[i % 2]) for i, lo in enumerate(rng.integers(0, 8000, 30))]
    got = {r["bin"]: r for r in intervals.metagene_profile(spark.createDataFrame(sites, "chrom string, pos long, pct double"), spark.createDataFrame(genes, "gene int, chrom string, lo long, hi long, strand string")).collect()}
    held = {}
    for i, chrom, lo, hi, strand in genes:
        for c, pos, pct in sites:
            offset = pos - lo if strand == "+" else hi - 1 - pos
            if c == chrom and -3000 <= offset < hi - lo + 3000:
                b = (offset + 3000) // 100 if offset < 0 else 30 + offset * 100 // (hi - lo) if offset < hi - lo else 130 + (offset - hi + lo) // 100
                held.setdefault(b, {}).setdefault(i, []).append(pct)
    assert len(got) == 160
    for b, r in got.items():
        means = [sum(v) / len(v) for v in held.get(b, {}).values()]
        assert (r["covered_genes"], r["observations"]) == (len(means), sum(map(len, held.get(b, {}).values())))
        assert r["mean_percent"] == (pytest.approx(sum(means) / len(means), abs=1e-5) if means else None)


def test_duplicate_sites_are_averaged_first(spark):
    sites = spark.createDataFrame([("c", 5, 0, "s"), ("c", 5, 100, "s"), ("c", 5, 100, "s"), ("c", 6, 0, "s")], "chrom string, pos long, pct long, spot string")
    gene = spark.createDataFrame([(1, "c", 0, 10, "+")], "gene int, chrom string, lo long, hi long, strand string")
    got = {r["bin"]: r["rate"] for r in intervals.gene_bin_rates(sites, gene).collect()}
    assert got == {70: pytest.approx(2 / 3), 80: 0.0}


def test_correlation_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert stats.guarded_correlation(rows, "x", "y").first()["pearson"] is None


def test_unseen_share_at_one(spark):
    row = spark.range(1).select(C.unseen_share(F.lit(1.0), F.lit(3)).alias("a"), C.unseen_share(F.lit(0.5), F.lit(2)).alias("b")).first()
    assert row["a"] == 1.0 and row["b"] == pytest.approx(0.75)


def test_bh_by_hand(spark):
    rows = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.01, 0.02, 0.02, None, 1.0])], "g string, i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in stats.adjust_bh(rows, ["g"], "p", ["i"]).collect()}
    assert got == {0: pytest.approx(0.08 / 3), 1: pytest.approx(0.08 / 3), 2: pytest.approx(0.08 / 3), 3: None, 4: 1.0}


def test_t_survival_against_known_values():
    t, df = np.array([2.228, 1.96, 12.706, 0.5, 3.0, 0.1]), np.array([10, 1e6, 1, 5, 30.5, 2.5])
    assert stats.t_two_sided(t[:3], df[:3]) == pytest.approx([0.05, 0.05, 0.05], rel=2e-3)
    x = np.linspace(0, 400, 4_000_001)
    for a, d in zip(t[3:], df[3:], strict=True):
        f = (1 + x * x / d) ** (-(d + 1) / 2)
        assert stats.t_two_sided(np.array([a]), np.array([d]))[0] == pytest.approx(f[x >= a].sum() / f.sum(), abs=2e-3)


def test_normal_p(spark):
    row = spark.range(1).select(stats.normal_p_value(F.lit(1.959964)).alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=1e-6)


def test_welch_without_spread(spark):
    rows = [(1, "a", 2, 4.0, 8.0, 2, 4.0, 8.0), (2, "a", 2, 4.0, 8.0, 2, 2.0, 2.0)]
    m = spark.createDataFrame(rows, "f int, g string, n1 long, s1 double, q1 double, n0 long, s0 double, q0 double")
    got = {r["f"]: (r["t"], r["p"]) for r in stats.welch_p(stats.welch(m)).collect()}
    assert got == {1: (0.0, 1.0), 2: (float("inf"), 0.0)}


def test_rank_sums_with_zeros(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (40, 3))
    counts = spark.createDataFrame([(i, g, int(x[i, g])) for i in range(40) for g in range(3) if x[i, g]], "spot int, gene int, n int")
    spots = spark.createDataFrame([(i, i % 2) for i in range(40)], "spot int, cluster int")
    for r in stats.rank_sums(counts, spots, "spot", "gene", "cluster", "n").collect():
        v = x[:, r["gene"]]
        rank = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert r["rank_sum_x2"] == 2 * rank[np.arange(40) % 2 == r["cluster"]].sum()
        assert r["ties"] == sum(c**3 - c for c in np.unique(v, return_counts=True)[1])


def test_additive_r2_and_partition(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), float(a + 2 * b + rng.normal())) for a, b in rng.integers(0, 3, (200, 2))]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    y = np.array([r[2] for r in rows])
    x = np.column_stack([np.ones(len(rows)), *[[r[k] == v for r in rows] for k in (0, 1) for v in range(3)]]).astype(float)
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = stats.additive_r2(df, "a", "b", "y").first()
    assert got["r2"] == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and got["rank"] == 5
    part = stats.variance_partition(spark.createDataFrame([(0.2, 0.5, 0.6, 0.7)], "r2_first double, r2_second double, r2_additive double, r2_interaction double")).first()
    assert sum(part[c] for c in ("unique_first", "unique_second", "shared", "interaction_gain", "residual")) == pytest.approx(1)


def test_knn_ties_and_self(spark):
    rows = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(6)], "id long, vec array<double>")
    got = {(r["id"], r["rank"]): r["other"] for r in graph.knn(rows, 2, block=2).collect()}
    assert got[0, 1] == 1 and got[0, 2] == 2 and got[2, 1] == 3 and got[2, 2] == 0
    assert all(k[0] != v for k, v in got.items())


def test_diffusion_without_support_is_null(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "id long, other long, w double")
    values = spark.createDataFrame([(0, 0.0), (1, 4.0)], "id long, value double")
    got = {r["id"]: r["value"] for r in graph.diffuse(values, nodes, edges, 1).collect()}
    assert got == {0: 4.0, 1: 0.0, 2: None, 3: None}
    assert {r["id"]: r["value"] for r in graph.diffuse(values, nodes, edges, 0).collect()} == {0: 0.0, 1: 4.0, 2: None, 3: None}


@pytest.mark.parametrize("decay", [1.0, 6.0])
def test_diffusion_operator_against_dense(spark, decay):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(30, 3)), np.zeros((8, 3))])  # eight equal vectors: no bandwidth
    near = graph.knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), 12).cache()
    got = np.zeros((38, 38))
    for r in graph.diffusion_operator(near, 4, decay).collect():
        got[r["id"], r["other"]] = r["w"]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    kernel = np.eye(38)
    for r in near.collect():
        i, j = r["id"], r["other"]
        b = np.sort(far[i])[4]
        a = 1.0 if far[i, j] == 0 else np.exp(-((far[i, j] / b) ** decay)) if b > 0 else 0.0
        kernel[i, j] = a if a >= 1e-4 else 0.0
    kernel = (kernel + kernel.T) / 2
    assert got == pytest.approx(kernel / kernel.sum(1, keepdims=True), abs=1e-9) and got.sum(1) == pytest.approx(np.ones(38))


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for k in (0, 10) for a in range(k, k + 6) for b in range(a + 1, k + 6)] + [(5, 10, 0.1)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    got = graph.communities(df, rounds=6, levels=2)
    label = {r["id"]: r["cluster"] for r in got.collect()}
    assert len({label[i] for i in range(6)}) == 1 and len({label[i] for i in range(10, 16)}) == 1 and label[0] != label[10]
    assert graph.modularity(df, got).first()["modularity"] > 0.4


def test_communities_end_without_gain_and_connected(spark):
    rng = np.random.default_rng(9)
    edges = [(a, a + 1, 1.0) for a in range(31)] + [(a, b, 0.5) for a in range(0, 32, 8) for b in range(a + 2, a + 8) if rng.random() < 0.5]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    got = {r["id"]: r["cluster"] for r in graph.communities(df).collect()}
    w = np.zeros((32, 32))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    label, degree = np.array([got[i] for i in range(32)]), w.sum(0)
    for i in range(32):
        other = [w[i, label == c].sum() - degree[i] * (degree[label == c].sum() - degree[i] * (c == label[i])) / w.sum() for c in range(label.max() + 1)]
        assert max(other) <= other[label[i]] + 1e-8
    for c in range(label.max() + 1):
        reach, inside = {int(np.flatnonzero(label == c)[0])}, set(np.flatnonzero(label == c).tolist())
        while more := {j for i in reach for j in np.flatnonzero(w[i]).tolist() if j in inside} - reach:
            reach |= more
        assert reach == inside


def test_pca_against_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 12)) + 0.01 * rng.normal(size=(30, 12)) + 5
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(12)], "row long, col long, value double")
    rows = spark.createDataFrame([(i,) for i in range(30)], "id long")
    scores, loadings, sd = linalg.pca(cells, rows, 3)
    s, v = (np.array([r["vec"] for r in t.orderBy("id").collect()]) for t in (scores, loadings))
    c = x - x.mean(0)
    assert sd == pytest.approx(np.linalg.svd(c)[1][:3] / np.sqrt(29), rel=1e-6)
    assert np.abs(s @ s.T) == pytest.approx(np.abs(c @ c.T), abs=0.5)
    assert v.T @ v == pytest.approx(np.eye(3), abs=1e-6) and c @ v == pytest.approx(s, abs=1e-6)


def test_pca_settles_or_raises(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 60))  # no gap anywhere
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(60)], "row long, col long, value double")
    rows = spark.createDataFrame([(i,) for i in range(40)], "id long")
    want = np.linalg.svd(x - x.mean(0))[1][:4] / np.sqrt(39)
    assert linalg.pca(cells, rows, 4)[2] == pytest.approx(want, rel=1e-6)
    with pytest.raises(Violation):
        linalg.pca(cells, rows, 4, iterations=3)


def test_imputation_recovers_low_rank(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 1)) @ rng.normal(size=(1, 14))
    seen = rng.random(x.shape) < 0.8
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(25) for j in range(14) if seen[i, j]], "row long, col long, value double")
    history = linalg.impute_pca(cells, 1, 12, gain=0.0)[3].orderBy("round").collect()
    assert history[-1]["mse"] < 0.1 * history[0]["mse"]


def test_imputed_cells_against_dense_rounds(spark):
    rng = np.random.default_rng(8)
    x = np.clip(0.5 + rng.normal(size=(20, 2)) @ rng.normal(size=(2, 12)) * 0.3, 0, 1)
    seen = rng.random(x.shape) < 0.7
    want, largest = np.where(seen, x, np.where(seen, x, 0).sum(0) / seen.sum(0)), 0.0
    for r in range(1, 101):
        mean = want.mean(0)
        u, s, v = np.linalg.svd(want - mean, full_matrices=False)
        new = np.where(seen, x, np.clip(u[:, :2] * s[:2] @ v[:2] + mean, 0, 1))
        mse = ((new - want) ** 2).sum() / (~seen).sum()
        want, largest = new, max(largest, mse)
        if r > 1 and mse < 1e-3 * largest:
            break
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(20) for j in range(12) if seen[i, j]], "row long, col long, value double")
    _, _, imputed, history = linalg.impute_pca(cells, 2, start_at_mean=True, bounds=(0.0, 1.0))
    got = {(c["row"], c["col"]): c["value"] for c in imputed.collect()}
    assert set(got) == set(zip(*np.nonzero(~seen), strict=True)) and history.count() == r
    assert [got[c] for c in sorted(got)] == pytest.approx(want[~seen], abs=1e-6)


def test_nmf_error_falls(spark):
    rng = np.random.default_rng(6)
    x = rng.random((12, 2)) @ rng.random((2, 9))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(9)], "row long, col long, value double")
    errors = linalg.nmf(cells, 2, 6)[2]
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < 0.8 * errors[0]


def test_rescaling_keeps_the_product(spark):
    w = spark.createDataFrame([("s", 0, 2.0), ("s", 1, 3.0)], "id string, pattern int, value double")
    h = spark.createDataFrame([(0, "f", 2.0), (0, "g", 2.0), (1, "f", 0.0), (1, "g", 0.0)], "pattern int, feature string, value double")
    a, b = linalg.rescale_factors(w, h)
    assert {r["pattern"]: r["value"] for r in a.collect()} == {0: 8.0, 1: 3.0}
    assert {(r["pattern"], r["feature"]): r["value"] for r in b.collect()} == {(0, "f"): 0.5, (0, "g"): 0.5, (1, "f"): 0.0, (1, "g"): 0.0}


def test_layer_ties_and_isolated_spots(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0.6, 0.3), (1, 0, 1, 0.6, 0.3), (2, 5, 5, 0.6, 0.3), (3, 0, 2, 0.5, 0.5), (4, 1, 1, None, 0.9)], "id int, r int, c int, a double, b double")
    called = spatial.call_layer(rows, {"A": ["a"], "B": ["b"]}, F.lit(True))
    assert [r["layer"] for r in called.orderBy("id").collect()] == ["A", "A", "A", "none", "none"]
    others = rows.withColumn("other", F.when(F.col("id") != 1, F.lit(0.1)))
    assert [r["layer"] for r in spatial.call_layer(others, {"A": ["a"], "B": ["b"]}, F.lit(True), types=["other"]).orderBy("id").collect()] == ["A", "none", "A", "none", "none"]
    for bad in (-0.1, float("inf")):
        with pytest.raises(Exception, match="nonnegative finite"):
            spatial.call_layer(rows.withColumn("other", F.lit(bad)), {"A": ["a"], "B": ["b"]}, F.lit(True), types=["other"]).collect()
    kept = spatial.drop_isolated(called, [], "id", "r", "c", "layer")
    assert [r["layer"] for r in kept.orderBy("id").collect()] == ["A", "A", "none", "none", "none"]


def test_square_overlap_is_injective(spark):
    point = "part int, id int, x double, y double"
    ref = spark.createDataFrame([(0, 9, 0.0, 0.0)], point)
    assert spatial.square_overlap(spark.createDataFrame([(0, 1, 0.5, 0.5), (0, 2, 1.0, 0.2)], point).where("id = 1"), ref, 1.0).count() == 1
    with pytest.raises(Violation):
        spatial.square_overlap(spark.createDataFrame([(0, 1, 0.5, 0.5), (0, 2, 0.4, 0.2)], point), ref, 1.0)


def test_expectations(spark):
    rows = spark.createDataFrame([(1, 2.5), (1, 3.0)], "id int, x double")
    with pytest.raises(Violation):
        expect(rows, unique=[["id"]])
    with pytest.raises(Violation):
        matrix.check_counts(rows, "x")
    with pytest.raises(Violation):
        require_same_ids(rows, rows.withColumn("id", F.lit(2)), "id")
    with pytest.raises(Violation):
        tables.one_annotation(spark.createDataFrame([(1, "s", "a"), (1, "t", "b")], "k int, s string, a string"), "k", "s", "a")


def test_names_and_keys(spark):
    row = spark.range(1).select(C.pad_pair(F.lit(3), F.lit(100)).alias("p"), C.slug(F.lit(" L2/3 IT! ")).alias("s"), C.split_pair(F.lit("0712")).alias("q")).first()
    assert row["p"] == "03_100" and row["s"] == "l2-3-it" and tuple(row["q"]) == (7, 12)
    names = spark.createDataFrame([("s10",), ("S2",), ("s1",)], "x string")
    assert [r["x"] for r in names.orderBy(C.natural_key(F.col("x"))).collect()] == ["s1", "S2", "s10"]


def test_fixed_point_genes(spark):
    counts = spark.createDataFrame([(s, g, (s * g) % 5 + 1) for s in range(8) for g in range(6)], "spot long, gene long, n long")
    spots = spark.createDataFrame([(s,) for s in range(8)], "spot long")
    genes, kept = linalg.variable_fixed_point(counts, spots, 3)
    assert genes.count() == 3 and kept.count() == 8


def test_nearest_spot_without_a_radius(spark):
    rng = np.random.default_rng(4)
    pts = lambda n, part, x0: [(part, int(i), float(x0 + x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (n, 2)))]
    a = pts(150, "p", 0) + pts(20, "q", 0) + pts(3, "none", 0) + [("one", 7, 0.0, 0.0), ("far", 1, -1e6, 5.0)]
    b = pts(200, "p", 500) + pts(30, "p", 0) + pts(1, "q", 9) + [("one", 7, 0.0, 0.0), ("far", 3, 1e6, 5.0), ("far", 2, 1e6, 5.0)]
    b = [(p, 1000 + k if p == "p" else i, x, y) for k, (p, i, x, y) in enumerate(b)] + [x for x in a if x[0] == "p"][:40]
    schema = "part string, id long, x double, y double"
    for exclude in (False, True):
        got = {(r["part"], r["id"]): (r["other"], r["d2"]) for r in spatial.nearest_spot(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), exclude).collect()}
        for p, i, x, y in a:
            others = sorted(((x - u) ** 2 + (y - v) ** 2, j) for q, j, u, v in b if q == p and not (exclude and i == j))
            assert got[p, i] == ((others[0][1], others[0][0]) if others else (None, None))
        assert len(got) == len(a)


def test_nearest_leaves_stay_few_with_a_far_spot_and_dense_clusters(spark):
    rng = np.random.default_rng(5)
    near = [("p", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1e-3, (600, 2)))]
    spread = [("p", 600 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1e3, (600, 2)))]
    stacked = [("p", 1200 + i, 5.0, 5.0) for i in range(300)]
    rows = spark.createDataFrame([*near, *spread, *stacked, ("p", 1500, 1e12, -1e12), ("p", 1501, None, 1.0), ("p", 1502, float("nan"), 1.0)], "part string, id long, x double, y double")
    tree = spatial.reference_tree(rows)
    assert tree.groupBy("path").count().agg({"count": "max"}).first()[0] <= spatial.LEAF and tree.count() == 1202
    assert spatial.leaf_pairs(rows, tree, True).count() <= 8 * 1501  # a few leaves a spot, wherever it lies
    got = {r["id"]: (r["other"], r["d2"]) for r in spatial.nearest_spot(rows, rows, True).collect()}
    assert len(got) == 1503 and got[1501] == got[1502] == (None, None)
    assert got[1200] == (1201, 0.0) and all(got[i] == (1200, 0.0) for i in range(1201, 1500)) and got[1500][1] > 1e23
    pts = np.array([x[2:] for x in [*near, *spread, *stacked]])
    for i in (0, 17, 599, 600, 1100):
        d = (pts[i, 0] - pts[:, 0]) ** 2 + (pts[i, 1] - pts[:, 1]) ** 2
        d[i] = np.inf
        assert got[i] == (int(d.argmin()), float(d.min()))


def test_pair_scores_in_both_directions(spark):
    spots = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 100.0, 0.0, "a"), (3, 900.0, 0.0, "a"), (4, 0.0, 0.0, "b")], "id long, x double, y double, part string")
    values = spark.createDataFrame([(1, "l", 2.0), (2, "r", 3.0), (1, "r", 5.0), (3, "l", 7.0), (3, "r", 1.0)], "id long, gene string, value double")
    pairs = spark.createDataFrame([("l r", "l", "r")], "pair string, ligand string, receptor string")
    score = lambda **more: {r["id"]: r["score"] for r in spatial.pair_scores(values, spots, pairs, **more).collect()}
    w = math.exp(-(100.0**2) / (2 * 125.0**2))
    assert score() == pytest.approx({1: 5 * 2 / (1 + w), 2: 3 * w * 2 / (1 + w), 3: 7.0})
    assert score(direction="outgoing") == pytest.approx({1: 2 * (5 + w * 3) / (1 + w), 3: 7.0})
    assert score(include_self=False) == pytest.approx({2: 6.0}) and score(include_self=False, direction="outgoing") == pytest.approx({1: 6.0})
    flags = lambda own: {r["id"]: r["score_available"] for r in spatial.score_available(spots, include_self=own).collect()}
    assert flags(False) == {1: True, 2: True, 3: False, 4: False} and all(flags(True).values())
    with pytest.raises(ValueError):
        spatial.pair_scores(values, spots, pairs, direction="both")


@pytest.mark.parametrize("direction, own", [("incoming", True), ("outgoing", False)])
def test_pair_scores_of_scattered_spots_against_a_loop(spark, monkeypatch, direction, own):
    rng = np.random.default_rng(5)
    at = {i: ("ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-12, 13, (60, 2)) * 125)}
    value = {(i, g): float(rng.integers(1, 9)) for i in at for g in "lmrs" if rng.random() < 0.6}
    pairs = [("p", "l", "r"), ("p", "m", "r"), ("p", "l", "s"), ("q", "l", "r"), ("q", "l", "r"), ("z", "none", "r")]
    want = {}
    for i, (part, x, y) in at.items():
        w = {o: math.exp(-((x - u) ** 2 + (y - v) ** 2) / (2 * 125**2)) for o, (b, u, v) in at.items() if b == part and (x - u) ** 2 + (y - v) ** 2 <= 250**2 and (own or o != i)}
        for pair, ligand, receptor in pairs:
            here, there = (receptor, ligand) if direction == "incoming" else (ligand, receptor)
            if (i, here) in value and any((o, there) in value for o in w):
                held = want.setdefault((i, pair, here), 0.0)
                want[i, pair, here] = held + sum(w[o] * value.get((o, there), 0.0) for o in w) / sum(w.values()) * value[i, here]
    spots = spark.createDataFrame([(i, x, y, b) for i, (b, x, y) in at.items()] + [(90, None, 0.0, "a"), (91, float("nan"), 0.0, "a"), (92, 0.0, 0.0, None)], "id long, x double, y double, part string")
    values = spark.createDataFrame([(i, g, v) for (i, g), v in value.items()] + [(i, g, 5.0) for i in (90, 91, 92, 93) for g in "lr"], "id long, gene string, value double")
    for limit in (100_000, 2):  # few pairs, and pairs that are shuffled
        monkeypatch.setattr(spatial, "BROADCAST_ROWS", limit)
        got = spatial.pair_scores(values, spots, spark.createDataFrame(pairs, "pair string, ligand string, receptor string"), include_self=own, direction=direction).where("id < 90").collect()
        got, all_wanted = sorted((r["id"], r["pair"], r["score"]) for r in got), sorted((i, p, x) for (i, p, _), x in want.items())
        assert [r[:2] for r in got] == [r[:2] for r in all_wanted] and [r[2] for r in got] == pytest.approx([r[2] for r in all_wanted])


def test_pair_scores_send_no_value_to_each_spot_around(spark):
    n = 300
    spots = spark.range(n).selectExpr("id", "CAST(id AS double) / 10 AS x", "0D AS y", "'a' AS part")
    values = spark.range(n).selectExpr("id", "'l' AS gene", "1D AS value").union(spark.createDataFrame([(7, "r", 2.0)], "id long, gene string, value double"))
    pairs = spark.createDataFrame([("l r", "l", "r")], "pair string, ligand string, receptor string")
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [tuple(r) for r in spatial.pair_scores(values, spots, pairs).collect()] == [(7, "l r", pytest.approx(2.0))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(k for i, k in shuffled().items() if i not in before) < 30 * n  # all of them lie within reach of each other


def test_saturation_and_threshold_errors(spark):
    rows = [("s", "a", 10, 1, 5), ("s", "a", 10, 3, 2), ("s", "b", 2, 1, 9), ("s", "c", 8, 2, 4)]
    schema = "sample string, spot string, reads int, depth int, site_count int"
    samples = spark.createDataFrame([("s", 1.0, 3.0)], "sample string, source double, threshold double")
    got = {r["target"]: r for r in stats.saturation_curve(spark.createDataFrame(rows, schema), samples, 0.5).collect()}
    assert set(got) == {0.5, 1.0} and got[0.5]["n_spots"] == 2 and got[1.0]["q50"] == pytest.approx((7 + 4) / 2)
    assert got[0.5]["q50"] == pytest.approx((5 * 0.5 + 2 * 0.875 + 4 * 0.75) / 2)
    for bad in ([("s", "a", 1, 1, 5)], [*rows, ("s", "a", 11, 1, 1)], [*rows, ("s", "d", 9, 0, 1)], []):
        with pytest.raises(Violation):
            stats.saturation_curve(spark.createDataFrame(bad, schema), samples, 0.5)
    with pytest.raises(Violation):
        stats.saturation_curve(spark.createDataFrame(rows, schema), samples, 2.0)
    for levels in ([], [5, 5, 0]):
        with pytest.raises(Exception, match="two positive levels"):
            stats.otsu_threshold(spark.createDataFrame([(x,) for x in levels], "reads int"), "reads").collect()


def test_complexes_take_the_least_gene(spark):
    counts = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, "a", 9), (3, "a", 4), (3, "b", 8), (3, "c", 88)], "spot int, gene string, n int")
    members = spark.createDataFrame([("ab", "a"), ("ab", "b"), ("a", "a"), ("ax", "a"), ("ax", "x")], "unit string, gene string")
    got = {(r["spot"], r["unit"]): r["n"] for r in matrix.complex_counts(counts, members, "spot", "gene", "unit", "n").collect()}
    assert got == {(1, "ab"): 3, (3, "ab"): 4, (1, "a"): 5, (2, "a"): 9, (3, "a"): 4}
    high = matrix.high_complexes(counts, members, "spot", "gene", "unit", "n", 3, 0.5)
    assert {(r["spot"], r["unit"]) for r in high.collect()} == {(1, "ab"), (2, "a"), (1, "a")}


def test_unions_check_annotations(spark):
    rows = [("g1", "s1", "x", 2), ("g1", "s2", "x", 3), ("g2", "s1", "y", 4)]
    df = spark.createDataFrame(rows, "gene string, sample string, symbol string, n long")
    assert {(r["sample"], r["gene"]): r["n"] for r in tables.outer_union(df, "gene", "sample", "symbol", "n").collect()} == {("s1", "g1"): 2, ("s2", "g1"): 3, ("s1", "g2"): 4, ("s2", "g2"): 0}
    assert {r["gene"] for r in tables.inner_concat(df, "gene", "sample", "symbol").collect()} == {"g1"}
    other = spark.createDataFrame([*rows, ("g1", "s3", "z", 1)], df.schema)
    for f in (lambda x: tables.outer_union(x, "gene", "sample", "symbol", "n"), lambda x: tables.inner_concat(x, "gene", "sample", "symbol")):
        with pytest.raises(Violation):
            f(other)


def test_residual_variance_and_pca_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(1.2, (40, 12)).astype(float)
    x[5] = 0
    part = np.arange(40) % 2
    counts = spark.createDataFrame([(i, j, int(v)) for (i, j), v in np.ndenumerate(x) if v], "spot long, gene long, n long")
    spots = spark.createDataFrame([(i, int(p)) for i, p in enumerate(part)], "spot long, sample long")

    def residuals(x):
        mu = x.sum(1)[:, None] * x.sum(0) / x.sum()
        with np.errstate(invalid="ignore"):
            return np.clip(np.nan_to_num((x - mu) / np.sqrt(mu + mu * mu / 100)), -np.sqrt(len(x)), np.sqrt(len(x)))

    got = {r["gene"]: r["variance"] for r in linalg.residual_variance(counts, spots).collect()}
    assert [got[j] for j in range(12)] == pytest.approx(residuals(x).var(0))
    got = {(r["sample"], r["gene"]): r["variance"] for r in linalg.residual_variance(counts, spots, part=["sample"]).collect()}
    for p in (0, 1):
        assert [got[p, j] for j in range(12)] == pytest.approx(residuals(x[part == p]).var(0))
    genes = spark.createDataFrame([(j,) for j in range(8)], "gene long")
    scores, _, deviations = linalg.residual_pca(counts, spots, genes, 3)
    r = residuals(x[:, :8])
    exact = np.linalg.svd(r - r.mean(0))[1][:3] / np.sqrt(39)
    assert deviations == pytest.approx(exact, rel=2e-2) and scores.count() == 40


def test_average_ranks_over_ranges(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 40, 300), rng.integers(0, 300, 300)
    got = stats.spearman(spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x int, y int"), "x", "y").first()
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_cohort_errors_and_edges(spark):
    from spotframe.operators import cohorts

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    one = spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    assert cohorts.lookup(rows, one, "k").count() == 3
    for bad in (lambda: cohorts.lookup(rows, one.where("k = 1"), "k"), lambda: cohorts.lookup(one, rows, "k"), lambda: cohorts.one_to_one([one, rows], "k"), lambda: cohorts.members_only(one, "k", [1, 7])):
        with pytest.raises(Violation):
            bad()
    vec = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k int, vec array<double>")
    assert {r["k"]: r["vec"] for r in cohorts.stack_vectors([vec, vec], "k", "vec").collect()} == {1: [1.0, 1.0], 2: [2.0, 2.0]}
    with pytest.raises(Violation):
        cohorts.stack_vectors([vec, vec.where("k = 1")], "k", "vec")
    with pytest.raises(Violation):
        cohorts.reference_summary(spark.createDataFrame([("a", 1), (" ", 2)], "label string, umi int"), "label", "umi", 1, 1, 1)
    numbers = spark.createDataFrame([(0.5, 0.5), (1.5, 2.0), (-2.5, float("inf")), (float("nan"), 1.0), (None, 1.0)], "x double, y double")
    got = numbers.select(cohorts.round_half_even(F.when(~F.isnan("x"), F.col("x"))).alias("r"), cohorts.is_close(F.col("x"), F.col("y"), absolute=0.6).alias("c")).collect()
    assert [r["r"] for r in got] == [0, 2, -2, None, None] and [r["c"] for r in got] == [True, True, False, False, False]
    names = spark.createDataFrame([(1, "A b"), (2, "A?b"), (3, "***")], "k int, name string")
    assert [r["slug"] for r in cohorts.file_slugs(names, "name", "k").orderBy("k").collect()] == ["A-b", "A-b-2", "annotation"]
    more = names.union(spark.createDataFrame([(0, "A-b-2"), (4, "A-b"), (5, "A-b-2"), (6, "overview"), (7, "A b-3")], names.schema))
    assert [r["slug"] for r in cohorts.file_slugs(more, "name", "k").orderBy("k").collect()] == ["A-b-2", "A-b", "A-b-3", "annotation", "A-b-4", "A-b-2-2", "overview-2", "A-b-3-2"]
    genes = spark.createDataFrame([(1, "c", 100, 200, "+"), (2, "c", 300, 400, "-")], "gene int, chrom string, lo long, hi long, strand string")
    regions = spark.createDataFrame([(i, "c", a, b) for i, (a, b) in enumerate([(90, 100), (90, 101), (101, 110), (400, 410), (390, 399)])], "region int, chrom string, lo long, hi long")
    got = {r["region"]: (r["gene"], r["distance"]) for r in cohorts.signed_tss_distance(regions, genes, "region", "gene").collect()}
    assert got == {0: (1, -1), 1: (1, 0), 2: (1, 1), 3: (2, -1), 4: (2, 1)}


def test_nearest_and_classes_form_no_pairs(spark):
    """Regions and genes all in one place: as many pairs as regions times genes, none of which may be formed."""
    from spotframe.operators import intervals

    n = 3000
    regions = spark.range(n).select("id", F.lit("c").alias("chrom"), (F.col("id") % 7).alias("lo"), (F.col("id") % 7 + 20).alias("hi"))
    genes = spark.range(n).select(F.col("id").alias("gene"), F.lit("c").alias("chrom"), (F.col("id") % 5 + 3).alias("lo"), (F.col("id") % 5 + 30).alias("hi"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    empty = spark.createDataFrame([(n, "c", 5, 5), (n + 1, "c", 90, 95), (n + 2, "d", 1, 2)], "id long, chrom string, lo long, hi long")
    near = intervals.nearest(regions.union(empty), genes, "id", "gene")
    kinds = intervals.priority_annotation(regions.union(empty), genes, "id", ["odd", "even"], "none")
    for df in (near, kinds):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan  # no buckets in which every region meets every gene
    got = {r["id"]: (r["gene"], r["distance"]) for r in near.collect()}
    assert len(got) == n + 2 and all(got[i] == (0, 0) for i in range(n + 1)) and got[n + 1] == (4, 56)
    found = {r["id"]: r["kind"] for r in kinds.collect()}
    assert len(found) == n + 3 and all(found[i] == "odd" for i in range(n + 1)) and found[n + 1] == found[n + 2] == "none"


def test_annotation_lists_form_no_pairs(spark):
    """Crowded places, long regions, promoters, a distant and a foreign region: lists equal a plain reference, without a join by bucket."""
    rng = np.random.default_rng(5)
    genes = [(g, "ab"[g % 2], int(lo), int(lo + rng.integers(1, 60)), "+-"[int(rng.integers(2))]) for g, lo in enumerate(rng.integers(3000, 3400, 80))]
    regions = [(i, "ab"[i % 2], int(lo), int(lo + n)) for i, (lo, n) in enumerate(zip(rng.integers(2900, 3500, 300), rng.choice([5, 40, 300], 300)))]
    regions += [(300, "a", 0, 9000), (301, "a", 90000, 90010), (302, "c", 1, 5), (303, "b", 5300, 5310), (304, None, 1, 5)]
    r = spark.createDataFrame(regions, "region long, chrom string, lo long, hi long")
    g = spark.createDataFrame(genes, "gene long, chrom string, lo long, hi long, strand string")
    got = {x["region"]: (x["relation"], x["gene_ids"], x["n_genes"]) for x in intervals.annotate(r, g, "region", "gene", width=50).collect()}
    bounds = {k: (lo - 2000, lo + 500) if strand == "+" else (hi - 501, hi + 1999) for k, _, lo, hi, strand in genes}
    for i, chrom, lo, hi in regions:
        on = [x for x in genes if x[1] == chrom]
        body = [k for k, _, a, b, _ in on if lo < b and hi > a]
        near = [k for k, *_ in on if lo < bounds[k][1] and hi > max(0, bounds[k][0])]
        far = [min(((lo - b if b <= lo else a - hi), a, k) for k, _, a, b, _ in on)[2]] if on and not body else []
        relation, ids = next(((n, x) for n, x in (("gene", body), ("promoter", near), ("intergenic", far)) if x), ("", []))
        assert got[i] == (relation, ";".join(map(str, sorted(ids))), len(ids))
    assert len(got) == len(regions)
    plan = intervals.annotate(r, g, "region", "gene", width=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "collect_set" not in plan


def test_genes_of_one_place_are_sorted_once_and_all_count(spark, monkeypatch):
    genes = spark.range(100).selectExpr("id AS gene", "'c' AS chrom", "100L AS lo", "200L AS hi", "CASE WHEN id < 60 THEN '+' ELSE '-' END AS strand")
    sites = spark.createDataFrame([("c", 110, 20), ("c", 110, 40), ("c", 150, 60)], "chrom string, pos long, pct long")
    seen, plain = [], intervals.range_sums
    monkeypatch.setattr(intervals, "range_sums", lambda points, edges, values: seen.append(edges.count()) or plain(points, edges, values))
    got = {r["bin"]: (r["mean_percent"], r["covered_genes"], r["observations"]) for r in intervals.metagene_profile(sites, genes, 100, 10, 10).collect() if r["covered_genes"]}
    assert seen == [2 * 31]
    assert got == {11: (30.0, 60, 120), 15: (60.0, 60, 60), 18: (30.0, 40, 80), 14: (60.0, 40, 40)}


def test_regions_of_one_place_make_one_list(spark, monkeypatch):
    regions = spark.range(300).selectExpr("id AS region", "CASE WHEN id < 290 THEN 'c' END AS chrom", "5 * (id % 2) AS lo", "5 * (id % 2) + 10L AS hi")
    genes = spark.createDataFrame([(1, "c", 0, 4, "+", "x"), (2, "c", 2, 20, "-", None)], "gene long, chrom string, lo long, hi long, strand string, symbol string")
    asked, plain = [], intervals.overlapping_lists
    monkeypatch.setattr(intervals, "overlapping_lists", lambda r, *more: asked.append(r.count()) or plain(r, *more))
    got = {r["region"]: tuple(r)[1:] for r in intervals.annotate_columns(regions, genes, "region", "gene", ["symbol"]).collect()}
    assert asked[0] == 2
    assert got == {i: ("", "", "") if i >= 290 else ("2", "", "gene") if i % 2 else ("1;2", "x;", "gene;gene") for i in range(300)}
    monkeypatch.setattr(intervals, "HELD", 20)
    held = intervals.at_places(regions, ["chrom", "lo", "hi"], "at").selectExpr("chrom", "lo", "inline(at)", "size(at) AS n").collect()
    assert sorted(r["region"] for r in held) == list(range(300)) and max(r["n"] for r in held) < 60


def test_overlap_join_shuffles_places_and_pairs_all_rows_there(spark):
    left = spark.range(200).selectExpr("id", "CASE WHEN id < 190 THEN 'c' END AS chrom", "5 * (id % 2) AS lo", "5 * (id % 2) + 4L AS hi")
    right = spark.range(100).selectExpr("10L AS hi", "id", "'c' AS chrom", "4 * (id % 2) AS lo")
    pairs = intervals.overlap_join(left, right, 3)
    assert pairs.columns == ["id", "chrom", "lo", "hi", "r_hi", "r_id", "r_lo"]
    got = sorted((r["id"], r["r_id"]) for r in pairs.collect())
    assert got == [(i, j) for i in range(190) for j in range(100) if i % 2 or j % 2 == 0]
    # pairs are made after the join, from the arrays of two places
    assert pairs._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0].count("explode") == 2


def test_gene_bins_in_dealt_blocks_against_a_loop(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sites = [(("s", "t", None)[rng.integers(3)], "xy"[rng.integers(2)], int(p), int(rng.integers(0, 101))) for p in rng.integers(0, 9000, 250)] + [("u", "x", 40, None)]
    genes = [(i, "xyz"[i % 3], int(lo), int(lo + rng.integers(1, 90)), "+-"[i % 2]) for i, lo in enumerate(rng.integers(0, 8000, 20))] + [(30, "x", 10, 7000, "-"), (31, "x", 10, 7000, "-"), (32, "y", 50, 900, None)]
    monkeypatch.setattr(intervals, "PAIRING", 60)
    held, want = {}, {}
    for spot, chrom, pos, pct in sites:
        held.setdefault((spot, chrom, pos), []).append(pct)
    for (spot, chrom, pos), v in held.items():
        for gene, c, lo, hi, strand in genes:
            if c == chrom and lo - 2000 <= pos < hi + 2000:
                b = 20 + (pos - lo) * 100 // (hi - lo) if lo <= pos < hi else (pos - lo + 2000) // 100 if pos < lo else 120 + (pos - hi) // 100
                b = b if strand == "+" else 139 - b
                want.setdefault((spot, gene, b), []).append(None if v == [None] else sum(v) / len(v) / 100)
    df = intervals.gene_bin_rates(spark.createDataFrame(sites, "spot string, chrom string, pos long, pct long"), spark.createDataFrame(genes, "gene int, chrom string, lo long, hi long, strand string"), width=100)
    got = {(r["spot"], r["gene"], r["bin"]): (r["n_sites"], r["rate"]) for r in df.collect()}
    assert got == {k: (len(v), None if v[0] is None else pytest.approx(sum(v) / len(v))) for k, v in want.items()}
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("CoGroup")[0]  # no table of all bins


def test_imputed_cells_where_many_are_clipped(spark):
    rng = np.random.default_rng(9)
    x = np.clip(0.5 + rng.normal(size=(30, 2)) @ rng.normal(size=(2, 12)), 0, 1)
    seen = rng.random(x.shape) < 0.7
    want = np.where(seen, x, np.where(seen, x, 0).sum(0) / seen.sum(0))
    for _ in range(5):
        mean = want.mean(0)
        u, s, v = np.linalg.svd(want - mean, full_matrices=False)
        plain = u[:, :2] * s[:2] @ v[:2] + mean
        want = np.where(seen, x, np.clip(plain, 0, 1))
    assert ((plain < 0) | (plain > 1))[~seen].mean() > 0.1
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(12) if seen[i, j]], "row long, col long, value double")
    got = {(c["row"], c["col"]): c["value"] for c in linalg.impute_pca(cells, 2, 5, gain=0.0, start_at_mean=True, bounds=(0.0, 1.0))[2].collect()}
    assert [got[c] for c in sorted(got)] == pytest.approx(want[~seen], abs=1e-6)


def test_positions_without_a_rate_count_as_sites_but_not_in_the_mean(spark):
    sites = spark.createDataFrame([("s", "c", 5, 100), ("s", "c", 5, 0), ("s", "c", 7, None), ("s", "c", 8, 25), ("t", "c", 7, None)], "spot string, chrom string, pos long, pct long")
    genes = spark.createDataFrame([(1, "c", 3000, 3100, "+"), (2, "c", 1000, 1100, "-"), (3, "c", 1000, 1100, "-")], "gene int, chrom string, lo long, hi long, strand string")
    df = intervals.gene_bin_rates(sites, genes, digits=2)
    want = {(spot, gene): (139 - 10, n, rate) for gene in (2, 3) for spot, n, rate in (("s", 3, 0.38), ("t", 1, None))}
    assert {(r["spot"], r["gene"]): (r["bin"], r["n_sites"], r["rate"]) for r in df.collect()} == want


def test_change_of_a_round_is_that_of_all_missing_cells_where_some_are_clipped(spark):
    rng = np.random.default_rng(11)
    x = np.clip(0.5 + rng.normal(size=(25, 2)) @ rng.normal(size=(2, 12)), 0, 1)
    seen = rng.random(x.shape) < 0.6
    want, mse = np.where(seen, x, np.where(seen, x, 0).sum(0) / seen.sum(0)), []
    for _ in range(4):
        mean = want.mean(0)
        u, s, v = np.linalg.svd(want - mean, full_matrices=False)
        new = np.where(seen, x, np.clip(u[:, :2] * s[:2] @ v[:2] + mean, 0, 1))
        mse.append(((new - want) ** 2).sum() / (~seen).sum())
        want = new
    cells = spark.createDataFrame([(f"r{i}", f"c{j:02}", float(x[i, j])) for i in range(25) for j in range(12) if seen[i, j]], "row string, col string, value double")
    _, _, imputed, history = linalg.impute_pca(cells, 2, 4, gain=0.0, start_at_mean=True, bounds=(0.0, 1.0))
    assert [r["mse"] for r in history.orderBy("round").collect()] == pytest.approx(mse, rel=1e-6)


def test_rounds_of_moves_shuffle_no_edges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(i, j, 1.0) for i in range(40) for j in range(i + 1, 40) if rng.random() < (0.6 if i // 10 == j // 10 else 0.05)]
    seen, kept = [], graph.staged

    def staged(df, name):
        if "wants" in df.columns and len(seen) < 2:
            df.collect()
            seen.append(df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0])
        return kept(df, name)

    monkeypatch.setattr(graph, "staged", staged)
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    got = {r["id"]: r["cluster"] for r in graph.communities(df, repeats=1, levels=1).collect()}
    assert len(set(got.values())) == 4 and all(len({got[i] for i in range(g, g + 10)}) == 1 for g in range(0, 40, 10))
    assert seen and all("sum(weight" in p and not re.search(r"Exchange hashpartitioning\(x#\d+L, c#\d+L", p) for p in seen)


def test_region_bin_rates_equal_the_means_of_spots(spark):
    rng = np.random.default_rng(12)
    sites = [(int(rng.integers(0, 6)), "xy"[rng.integers(2)], int(p), int(rng.integers(0, 101))) for p in rng.integers(0, 900, 400)]
    genes = [(i, "xyz"[i % 3], int(lo), int(lo + rng.integers(0, 400)), "+-"[i % 2]) for i, lo in enumerate(rng.integers(0, 800, 20))] + [(50, "x", 100, 60_000, "-")]
    sites = spark.createDataFrame(sites, "spot int, chrom string, pos long, pct long")
    genes = spark.createDataFrame(genes, "gene int, chrom string, lo long, hi long, strand string")
    spots = spark.createDataFrame([(s, "abc"[s % 3]) for s in range(5)], "spot int, region string")
    for flank, flank_bins, body_bins in ((60, 3, 4), (1000, 2, 1)):
        want = intervals.region_bin_means(intervals.gene_bin_rates(sites, genes, flank, flank_bins, body_bins), spots, 2 * flank_bins + body_bins)
        want = {(r["region"], r["gene"], r["bin"]): (r["n"], pytest.approx(r["rate"], abs=1e-12)) for r in want.collect()}
        df = intervals.region_bin_rates(sites, genes, spots, flank, flank_bins, body_bins)
        assert {(r["region"], r["gene"], r["bin"]): (r["n"], r["rate"]) for r in df.collect()} == want
    bad = sites.withColumn("pct", F.when(F.col("spot") < 5, 101).otherwise(0))
    with pytest.raises(Violation):
        intervals.region_bin_rates(bad, genes, spots)


def test_communities_of_no_edge(spark):
    assert graph.communities(spark.createDataFrame([], "a long, b long, weight double"), repeats=1).collect() == []
