"""Recovery of planted mixtures under planted platform effects, and the likelihood against a fine sum."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.expect import Violation
from spotframe.operators import deconvolution as D


def test_likelihood_equals_a_fine_sum():
    z = np.linspace(-37, 37, 800_001)
    w = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z[1] - z[0])
    for y in (0, 1, 7, 400):
        for rate in (0.01, 1.0, 300.0):
            for sigma in (0.05, 0.5, 1.5):
                r = rate * np.exp(sigma * z)
                p = np.exp(y * np.log(r) - r - math.lgamma(y + 1))
                exact = (w * p).sum()
                if exact < 1e-250:
                    continue
                value, first, second = (x[0] for x in D.log_likelihood(np.array([float(y)]), np.array([rate]), sigma))
                assert value - math.lgamma(y + 1) == pytest.approx(math.log(exact), abs=2e-3)
                h = 1e-4 * rate
                up, down = (D.log_likelihood(np.array([float(y)]), np.array([rate + s * h]), sigma)[0][0] for s in (1, -1))
                assert first == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=2e-3)


def planted(spark, seed=4):
    """120 spots of one or two of four types, genes with a platform effect each, sigma 0.3."""
    rng = np.random.default_rng(seed)
    genes, types = 240, 4
    shares = rng.gamma(0.6, 1, (genes, types))
    for t in range(types):
        shares[t * 40 : t * 40 + 40, t] += 6
    shares /= shares.sum(0)
    effect = np.exp(rng.normal(0, 0.7, genes))
    spots, rows = [], []
    for s in range(120):
        a, b = rng.choice(types, 2, replace=False)
        w = np.zeros(types)
        w[a] = 1.0 if s < 60 else 0.6
        w[b] += 0.0 if s < 60 else 0.4
        rate = 3000 * (shares @ w) * effect * np.exp(rng.normal(0, 0.3, genes))
        n = rng.poisson(rate)
        spots.append((s, {f"t{a}"} if s < 60 else {f"t{a}", f"t{b}"}, w))
        rows += [(s, int(g), int(n[g])) for g in range(genes) if n[g]]
    profiles = [(f"t{t}", g, float(shares[g, t])) for g in range(genes) for t in range(types)]
    return spots, spark.createDataFrame(rows, "spot int, gene int, n long"), spark.createDataFrame(profiles, "type string, gene int, share double")


def test_planted_mixtures_are_recovered(spark):
    spots, counts, profiles = planted(spark)
    full, figures = D.deconvolve(counts, profiles, least_fold=0.5)
    got = {r["spot"]: r for r in full.collect()}
    assert len(got) == 120 and all(r["converged"] for r in got.values()) and 0.2 <= figures["sigma"] <= 0.45
    off = []
    for s, _, w in spots:
        found = np.array([got[s]["weights"][f"t{t}"] for t in range(4)])
        off.append(np.abs(found / found.sum() - w).sum())
    assert np.mean(off) < 0.12
    true = np.mean([w for *_, w in spots], 0)
    assert max(abs(figures["proportions"][f"t{t}"] - true[t]) for t in range(4)) < 0.1

    pairs = {r["spot"]: r for r in D.deconvolve(counts, profiles, "doublet", least_fold=0.5, sigma=figures["sigma"])[0].collect()}
    single = [pairs[s]["spot_class"] == "singlet" and {pairs[s]["first_type"]} == names for s, names, _ in spots[:60]]
    both = [pairs[s]["spot_class"] == "doublet_certain" and {pairs[s]["first_type"], pairs[s]["second_type"]} == names for s, names, _ in spots[60:]]
    assert np.mean(single) >= 0.95 and np.mean(both) >= 0.95

    many = {r["spot"]: r for r in D.deconvolve(counts, profiles, "multi", least_fold=0.5, sigma=figures["sigma"])[0].collect()}
    assert np.mean([set(many[s]["types"]) == names and all(many[s]["confident"]) for s, names, _ in spots]) >= 0.95
    assert all(len(r["types"]) == len(r["type_weights"]) == len(r["confident"]) <= 4 for r in many.values())


def test_profiles_weigh_cells_alike_and_bad_input_raises(spark):
    cells = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 1, 10), (3, 2, 0)], "cell int, gene int, n long")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "cell int, type string")
    got = {r["gene"]: r["share"] for r in D.type_profiles(cells, labels).collect()}
    assert got == {1: (0.25 + 1.0) / 2, 2: 0.75 / 2}
    with pytest.raises(Violation):
        D.deconvolve(cells.withColumnRenamed("cell", "spot"), spark.createDataFrame([("a", 1, 1.0)], "type string, gene int, share double"), "other")


@pytest.mark.parametrize("mode", ["full", "doublet", "multi"])
def test_no_marker_gene_leaves_no_row(spark, mode):
    """With more genes than 1 / least_share, all alike, none reaches the published share: no spot can be fitted."""
    counts = spark.range(6000).select((F.col("id") % 10).cast("int").alias("spot"), F.col("id").alias("gene"), F.lit(20).cast("long").alias("n"))
    profiles = spark.range(6000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("type"), F.col("id").alias("gene"), F.lit(1 / 6000).alias("share"))
    fitted, figures = D.deconvolve(counts, profiles, mode)
    assert fitted.isEmpty() and figures == {"sigma": None, "proportions": {}, "genes": 0}
    assert ("gain" in fitted.columns) == (mode == "doublet") and ("confident" in fitted.columns) == (mode == "multi")
