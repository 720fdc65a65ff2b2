"""Published expression programs against dense NumPy, and a grid that goes on after it was stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.expect import Violation
from spotframe.operators import programs as P


def table(spark, seed=3, spots=60, genes=90, k=3):
    """Counts of spots that mix three programs of 15 genes each, and the dense matrix."""
    rng = np.random.default_rng(seed)
    basis = rng.gamma(0.3, 1, (k, genes))
    for i in range(k):
        basis[i, i * 15 : i * 15 + 15] += 4
    n = rng.poisson(rng.dirichlet([0.3] * k, spots) @ basis * 6)
    n[:, -1] = 0
    n[0, -1] = 1
    rows = [(int(s), int(g), int(n[s, g])) for s, g in zip(*np.nonzero(n))]
    return n, spark.createDataFrame(rows, "spot int, gene int, n long"), spark.range(spots).selectExpr("CAST(id AS INT) AS spot")


def test_input_and_overdispersion_equal_dense(spark):
    n, counts, spots = table(spark)
    tpm = n / n.sum(1, keepdims=True) * 1e6
    mean, var = tpm.mean(0), tpm.var(0)
    some = mean > 0
    fano = var[some] / mean[some]
    a = (np.sqrt(var) / np.maximum(mean, 1e-300))[np.argsort(-mean)[:20]].min()
    (ml, mh), (fl, fh) = np.quantile(mean[some], [0.1, 0.9]), np.quantile(fano, [0.1, 0.9])
    box = (mean[some] > ml) & (mean[some] < mh) & (fano > fl) & (fano < fh)
    ratio = fano / (a * a * mean[some] + np.median(fano[box]))
    want = np.flatnonzero(some)[np.argsort(-ratio)[:20]].tolist()
    genes = P.overdispersed_genes(counts, spots, 20)
    assert [r["gene"] for r in genes.orderBy("rank").collect()] == want
    got = {(r["row"], r["col"]): r["value"] for r in P.program_input(counts, spots, genes).collect()}
    sd = n.std(0, ddof=1)
    assert got == pytest.approx({(s, g): n[s, g] / sd[g] for s in range(len(n)) for g in want if n[s, g]})
    with pytest.raises(Violation):
        P.program_input(counts, spots, spark.createDataFrame([(89,)], "gene int"))


def test_grid_resumes_and_programs_are_recovered(spark, tmp_path):
    n, counts, spots = table(spark)
    entries = P.program_input(counts, spots, P.overdispersed_genes(counts, spots, 60)).cache()
    folder = str(tmp_path)
    assert P.factorise_grid(entries, [3], 4, folder, batch=2, iterations=40) == [(3, 0), (3, 2)]
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("part-*")}
    (tmp_path / "k=3" / "runs=2-4" / "figures" / "_SUCCESS").unlink()  # stopped before its second half was whole
    with pytest.raises(Violation):
        P.merged_spectra(spark, folder, 3, 4, batch=2)
    assert P.factorise_grid(entries, [3], 4, folder, batch=2, iterations=40) == [(3, 2)]
    kept = {f: t for f, t in before.items() if "runs=0-2" in str(f)}
    assert kept and all(f.stat().st_mtime_ns == t for f, t in kept.items())
    assert P.factorise_grid(entries, [3], 4, folder, batch=2) == []
    found = P.choose_rank(entries, [3], 4, folder, batch=2)
    assert found[0][0] == 3 and found[0][1] > 0.8
    usage = P.consensus(entries, 3, 4, spectra=P.merged_spectra(spark, folder, 3, 4, batch=2))[1].cache()
    out = P.program_table(counts, spots, usage, 3, top=15).collect()
    best = {}
    for r in out:
        best.setdefault(r["program"], set()).add(r["gene"])
    hits = [[sum(g // 15 == i for g in best[p]) for i in range(3)] for p in sorted(best)]
    assert min(max(h) for h in hits) >= 11 and {h.index(max(h)) for h in hits} == {0, 1, 2}, hits

    u = np.zeros((len(n), 3))
    for r in usage.collect():
        u[r["id"]] = r["vec"]
    tpm = n / n.sum(1, keepdims=True) * 1e6
    sd = tpm.std(0)
    z = np.divide(tpm - tpm.mean(0), sd, out=np.zeros_like(tpm), where=sd > 0)
    beta = np.linalg.pinv(u.T @ u) @ u.T @ z
    values = P.per_million(counts).select("spot", "gene", "value")
    got = {(r["program"], r["gene"]): r["score"] for r in P.gene_scores(values, usage, len(n), 3).collect()}
    assert got == pytest.approx({(i, g): beta[i, g] for i in range(3) for g in range(90)}, rel=1e-6, abs=1e-9)


def test_spot_without_chosen_counts_has_zero_usages(spark):
    counts = spark.createDataFrame([(s, g, 1 + (s * g) % 5) for s in range(8) for g in range(4)] + [(8, 9, 3)], "spot int, gene int, n long")
    spots, genes = counts.select("spot").distinct(), spark.createDataFrame([(g,) for g in range(4)], "gene int")
    entries = P.program_input(counts, spots, genes, empty_spots=True)
    assert {r["row"] for r in entries.collect()} == set(range(8))
    usage = entries.select(F.col("row").alias("id")).distinct().select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    got = {r["id"]: r["vec"] for r in P.all_usages(usage, spots, 2).collect()}
    assert got == {s: [1.0, 2.0] for s in range(8)} | {8: [0.0, 0.0]}
    assert P.all_usages(usage.where("false"), spots, 2).isEmpty()
