"""Identifier resolution, scores, batch correction, consensus and mixtures."""

import numpy as np
import pytest

from spotframe.expect import Violation
from spotframe.operators import deconvolution, mapping


def test_resolution_order(spark):
    genes = spark.createDataFrame([("E1", "A"), ("E2", "B"), ("E3", "B"), ("E4", "C")], "gene string, name string")
    rows = [("one", "E1|E9", "X"), ("tie", "E2|E4", "C"), ("none", "E2|E3", "B"), ("name", None, "A"), ("twice", "E9", "B"), ("two", "E1;E4", "A; C")]
    sub = mapping.split_complexes(spark.createDataFrame(rows, "u string, ids string, names string"), "u", "ids", "names")
    got = {(r["u"], r["position"]): r["gene"] for r in mapping.resolve_genes(sub, genes, "u", "gene", "name").collect()}
    assert got == {("one", 0): "E1", ("tie", 0): "E4", ("none", 0): None, ("name", 0): "E1", ("twice", 0): None, ("two", 0): "E1", ("two", 1): "E4"}
    with pytest.raises(Violation):
        mapping.split_complexes(spark.createDataFrame([("x", "E1", "A;B")], "u string, ids string, names string"), "u", "ids", "names")


def test_cell_cycle(spark):
    values = spark.createDataFrame([(s, g, 5.0 if (s == 0 and g < 3) else 1.0) for s in range(3) for g in range(30)], "spot long, gene long, value double")
    spots = spark.createDataFrame([(s,) for s in range(4)], "spot long")
    lists = [spark.createDataFrame([(g,) for g in x], "gene long") for x in ((0, 1, 2), (10, 11), ())]
    got = {r["spot"]: r["phase"] for r in mapping.cell_cycle(values, spots, lists[0], lists[1]).collect()}
    assert got[0] == "S" and len(got) == 4
    assert {r["phase"] for r in mapping.cell_cycle(values, spots, lists[0], lists[2]).collect()} == {"G1"}


def test_harmonize_brings_batches_together(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4)) + np.repeat([[6, 0, 0, 0], [0, 6, 0, 0]], 60, 0)
    batch = np.arange(120) % 2
    x[batch == 1] += [0, 0, 2, 0]
    df = spark.createDataFrame([(i, int(batch[i]), x[i].tolist()) for i in range(120)], "id long, batch long, vec array<double>")
    corrected, objective, settled = mapping.harmonize(df, clusters=4)
    assert settled and len(objective) < 10 and objective[-1] <= objective[0] + 1e-3 * abs(objective[0])
    y = np.array([r["vec"] for r in corrected.orderBy("id").collect()])
    gap = lambda m: np.abs(m[batch == 1].mean(0) - m[batch == 0].mean(0))[2]
    assert gap(y) < 0.3 * gap(x)


def test_harmonize_against_a_loop_without_shuffled_sums(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n, k, nb = 90, 3, 2
    x = rng.normal(size=(n, 5)) + np.eye(5)[rng.integers(0, 3, n)] * 4
    b = rng.integers(0, nb, n)
    df = spark.createDataFrame([(i, "uv"[b[i]], x[i].tolist()) for i in range(n)], "id long, batch string, vec array<double>")
    marks = df.selectExpr("id", "xxhash64(id) AS h", "pmod(xxhash64(id, 1), 2) AS blk").orderBy("id").toPandas()
    blk, unit = marks["blk"].to_numpy(), lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    y, centre, close = x.copy(), unit(x[marks.sort_values("h")["id"].to_numpy()[:k]]), -np.inf
    for _ in range(20):
        far = unit(x) @ centre.T
        centre, before, close = unit(np.eye(k)[far.argmax(1)].T @ unit(x)), close, far.max(1).sum()
        if close - before <= 1e-4 * abs(close):
            break
    share, want = np.bincount(b) / n, []
    for _ in range(3):
        r, value = np.zeros((n, k)), np.inf
        for step in range(20):
            dist = 2 * (1 - unit(y) @ centre.T)
            for at in range(2):
                rest = np.stack([r[(blk != at) & (b == i)].sum(0) for i in range(nb)], 1)
                w = np.exp(-dist / 0.1) * (((rest.sum(1, keepdims=True) * share + 1) / (rest + 1)) ** 2)[:, b].T
                r[blk == at] = (w / w.sum(1, keepdims=True))[blk == at]
            held = np.stack([r[b == i].sum(0) for i in range(nb)], 1)
            before, value = value, (r * dist).sum() + 0.1 * (r * np.log(r)).sum() + 0.2 * (held * np.log((held + 1) / (held.sum(1, keepdims=True) * share + 1))).sum()
            if step and before - value <= 1e-5 * abs(before):
                break
            centre = unit(r.T @ unit(y))
        want.append(value)
        design, y = np.column_stack([np.ones(n), np.eye(nb)[b]]), x.copy()
        for c in range(k):
            fit = np.linalg.lstsq(design.T @ (r[:, [c]] * design) + np.diag([0.0, 1.0, 1.0]), design.T @ (r[:, [c]] * x), rcond=None)[0]
            y -= r[:, [c]] * fit[1:][b]
        if len(want) > 1 and want[-2] - want[-1] < 1e-4 * abs(want[-2]):
            break
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    corrected, objective, _ = mapping.harmonize(df, clusters=k, rounds=3)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    # the vectors go to their blocks once; no pass shuffles its sums
    assert sum(c for i, c in shuffled().items() if i not in before) <= 2 * n
    got = np.array([r["vec"] for r in corrected.orderBy("id").collect()])
    assert objective == pytest.approx(want) and np.abs(got - y).max() < 1e-8
    monkeypatch.setattr(mapping, "HELD", 4)  # long sums are added up by Spark
    again, longer, _ = mapping.harmonize(df, clusters=k, rounds=1)
    assert longer == pytest.approx(want[:1]) and again.count() == n
    with pytest.raises(Exception, match="5 components"):
        mapping.harmonize(df.union(spark.createDataFrame([(n, "u", [1.0])], df.schema)), clusters=k)


def test_consensus(spark):
    rng = np.random.default_rng(1)
    x = rng.random((10, 2)) @ rng.random((2, 8))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(10) for j in range(8)], "row long, col long, value double")
    programs, errors = mapping.consensus_programs(cells, 2, runs=2, iterations=4)
    assert programs.count() == 16 and len(errors) == 2


def test_consensus_takes_every_run(spark):
    rng = np.random.default_rng(3)
    basis = np.kron(np.eye(3), np.ones(5)) * rng.uniform(0.5, 1.5, 15)
    x = np.repeat(np.eye(3), [12, 8, 5], 0) * rng.uniform(1, 3, (25, 1)) @ basis + 0.05 * rng.random((25, 15))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(25) for j in range(15)], "row long, col long, value double")
    programs, usage, figures = mapping.consensus(cells, 3, runs=10)
    got = programs.toPandas().pivot(index="program", columns="feature", values="value").to_numpy()
    truth = basis / basis.sum(1, keepdims=True)
    assert got == pytest.approx(truth, abs=0.02)  # the largest program first
    shares = np.array([r["vec"] for r in usage.orderBy("id").collect()])
    assert list(shares.argmax(1)) == [0] * 12 + [1] * 8 + [2] * 5
    assert figures["spectra"] == 30 and figures["silhouette"] > 0.9 and figures["iterations"] < 1000
    assert figures["prediction_error"] < 0.02 * (x**2).sum()


def test_spectra_far_from_others_are_left_out():
    rng = np.random.default_rng(5)
    x = np.vstack([np.repeat(np.eye(8)[:2], 10, 0) + 0.02 * rng.random((20, 8)), np.eye(8)[5:6]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels, silhouette = mapping.group_spectra(x @ x.T, 2, 3, 0.5)
    assert labels[20] == -1 and len(set(labels[:10])) == len(set(labels[10:20])) == 1 and labels[0] != labels[10] and silhouette > 0.9
    assert list(mapping.group_spectra(np.eye(4), 2, 1, 0.5)[0]) == [-1] * 4


def test_deconvolution(spark):
    rng = np.random.default_rng(2)
    basis = rng.dirichlet(np.ones(40), 3)
    truth = rng.dirichlet(np.ones(3), 6)
    counts = rng.poisson(truth @ basis * 20_000)
    c = spark.createDataFrame([(s, g, int(counts[s, g])) for s in range(6) for g in range(40) if counts[s, g]], "spot long, gene long, n long")
    p = spark.createDataFrame([(f"t{k}", g, float(basis[k, g])) for k in range(3) for g in range(40)], "type string, gene long, share double")
    fitted = deconvolution.deconvolve(c, p, least_fold=0.05)[0]
    spots = spark.createDataFrame([(s,) for s in range(8)], "spot long")
    rows = {r["spot"]: r for r in mapping.expand_weights(spots, fitted, spots.where("spot < 7")).collect()}
    for s in range(6):
        assert [rows[s]["proportions"][f"t{k}"] for k in range(3)] == pytest.approx(truth[s], abs=0.08)
        assert rows[s]["dominant_type"] == f"t{truth[s].argmax()}"
    assert rows[6]["status"] == "marker_filtered" and rows[7]["status"] == "umi_filtered" and rows[7]["dominant_type"] == "unassigned"
