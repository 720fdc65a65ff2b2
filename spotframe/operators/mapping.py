"""Resolving identifiers, scoring gene lists, correcting batches and fitting mixtures."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.expect import expect
from spotframe.functions.columns import divide
from spotframe.operators.linalg import fit_factor, nmf_runs, run_sums
from spotframe.staging import release, running_start, staged

#: Values of a sum that come to the driver from each task; longer sums are added up by Spark first.
HELD = 50_000


def split_complexes(pairs: DataFrame, unit: str, ids: str, symbols: str) -> DataFrame:
    """(unit, position, alternates, symbol): one row per subunit; ``;`` parts subunits, ``|`` parts alternate ids.

    Raises Violation where a symbol is blank or there are other numbers of ids and symbols.
    """
    names = F.transform(F.split(symbols, ";"), lambda x: F.trim(x))
    groups = F.when(F.col(ids).isNotNull(), F.transform(F.split(ids, ";"), lambda x: F.trim(x))).otherwise(F.transform(names, lambda x: F.lit("")))
    rows = pairs.select(unit, names.alias("_s"), groups.alias("_g"))
    rows = expect(rows, named=~F.exists("_s", lambda x: x == ""), as_many=F.size("_s") == F.size("_g"))
    out = rows.select(unit, F.posexplode(F.arrays_zip("_s", "_g")).alias("position", "x"))
    return out.select(unit, "position", F.filter(F.split("x._g", r"\|"), lambda x: x != "").alias("alternates"), F.col("x._s").alias("symbol"))


def resolve_genes(subunits: DataFrame, genes: DataFrame, unit: str, gene: str, name: str) -> DataFrame:
    """``subunits`` with the gene each stands for, or null.

    One alternate id that is known decides; of several the one with the subunit's symbol, if it is the only one. With
    no known id the symbol decides, if it names exactly one gene.
    """
    known = genes.select(F.col(gene).alias("_id"), F.col(name).alias("_name"))
    key = [unit, "position"]
    tried = subunits.select(*key, "symbol", F.explode("alternates").alias("_id")).join(known, "_id")
    by_id = tried.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_id").alias("_one"), F.count_if(F.col("_name") == F.col("symbol")).alias("_m"), F.min(F.when(F.col("_name") == F.col("symbol"), F.col("_id"))).alias("_match"))
    by_name = known.groupBy("_name").agg(F.count("*").alias("_k"), F.min("_id").alias("_named"))
    out = subunits.join(by_id, key, "left").join(by_name, F.col("symbol") == F.col("_name"), "left")
    found = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_n") > 1, F.when(F.col("_m") == 1, F.col("_match"))).otherwise(F.when(F.col("_k") == 1, F.col("_named")))
    return out.select(*key, "symbol", found.alias(gene))


def list_score(values: DataFrame, spots: DataFrame, members: DataFrame, bins: int = 25, controls: int = 50, seed: int = 0) -> DataFrame:
    """(spot, score): mean over the listed genes minus mean over control genes of like mean expression.

    ``values``: spot, gene, value, absent cells zero; ``members``: gene. Controls are drawn by a seeded hash from the
    expression bins of the listed genes. An empty list scores 0. The draw is our own.
    """
    n = spots.select("spot").distinct().agg(F.count("*").alias("n"))
    mean = values.groupBy("gene").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(n)).select("gene", divide(F.col("s"), F.col("n")).alias("m"))
    ranked = staged(running_start(mean.withColumn("one", F.lit(1)), ["m", "gene"], {"one": "rank"}).drop("one"), "ranked")
    each, more = divmod(ranked.count(), bins)  # the first ``more`` bins hold one gene more
    after = F.lit(more) + F.floor((F.col("rank") - more * (each + 1)) / max(each, 1))
    binned = ranked.withColumn("bin", F.when(F.col("rank") < more * (each + 1), F.floor(F.col("rank") / (each + 1))).otherwise(after))
    listed = binned.join(members.select("gene"), "gene", "left_semi")
    pool = binned.join(listed.select("bin").distinct(), "bin", "left_semi").join(members.select("gene"), "gene", "left_anti")
    drawn = pool.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("gene").cast("string")).cast("binary")), "gene"))).where(F.col("r") <= controls)
    roles = listed.select("gene", F.lit(1).alias("role")).union(drawn.select("gene", F.lit(0).alias("role")))
    sizes = roles.groupBy("role").agg(F.count("*").alias("k"))
    sums = values.join(roles, "gene").groupBy("spot", "role").agg(F.sum("value").alias("s")).join(F.broadcast(sizes), "role")
    score = sums.groupBy("spot").agg(F.sum(F.when(F.col("role") == 1, 1).otherwise(-1) * divide(F.col("s"), F.col("k"))).alias("score"))
    return spots.select("spot").distinct().join(score, "spot", "left").fillna(0.0, ["score"])


def cell_cycle(values: DataFrame, spots: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(spot, s_score, g2m_score, phase): the larger positive score names the phase, G1 if none is positive or a list is empty."""
    none = first.isEmpty() or second.isEmpty()
    if none:
        return spots.select("spot").distinct().select("spot", F.lit(0.0).alias("s_score"), F.lit(0.0).alias("g2m_score"), F.lit("G1").alias("phase"))
    both = list_score(values, spots, first).withColumnRenamed("score", "s_score").join(list_score(values, spots, second, seed=1).withColumnRenamed("score", "g2m_score"), "spot")
    phase = F.when((F.col("s_score") < 0) & (F.col("g2m_score") < 0), "G1").when(F.col("g2m_score") > F.col("s_score"), "G2M").otherwise("S")
    return both.withColumn("phase", phase)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column as a matrix; raises where a list hasn't ``d`` values."""
    if column.null_count or not pc.all(pc.equal(pc.list_value_length(column), d)).as_py():
        raise ValueError(f"vectors must have {d} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))


def _summed(rows: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``f``'s arrays of ``size`` values over all rows; tasks add up theirs. Spark adds the tasks' if they are long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for t in parts:
            for i in range(0, t.num_rows, 2500):
                total += f(t.slice(i, 2500))
        yield pa.RecordBatch.from_pydict({"x": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "x array<double>")
    if size > HELD:
        sums = sums.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        out, found = np.zeros(size), sums.toArrow()
        out[found["i"].to_numpy()] = found["x"].to_numpy()
        return out
    return sums.toArrow()["x"].combine_chunks().flatten().to_numpy().reshape(-1, size).sum(0)


def harmonize(vectors: DataFrame, clusters: int | None = None, rounds: int = 50, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, steps: int = 20, cluster_tol: float = 1e-5, round_tol: float = 1e-4, blocks: int = 2) -> tuple[DataFrame, list[float], bool]:
    """(id, batch, vec): embeddings (id, batch, vec) corrected for their batch; the objective of each round; whether it settled.

    Clusters start from k-means on the cosine. A round assigns rows softly, one hashed block after the other, so that the
    objective falls: distances to centroids, entropy of the assignments, and divergence of a cluster's batches from those
    of all rows. It goes on until the objective falls by less than ``cluster_tol`` of itself or ``steps`` are done. Each
    cluster's ridge regression of the embeddings on the batches is then taken off. Rounds end once the objective falls by
    less than ``round_tol``, or after ``rounds``, as published; only in the first case the result has settled. Sums of size
    clusters x batches x dimensions leave the tasks. Blocks are staged apart, so a pass reads its own block alone, in as many
    tasks as the session runs at once.
    """
    batches = [r[0] for r in vectors.select("batch").distinct().orderBy("batch").collect()]  # one row a batch
    place = {b: i for i, b in enumerate(batches)}
    n, nb = vectors.count(), len(batches)
    k = clusters or max(2, min(100, round(n / 30)))
    start = vectors.orderBy(F.xxhash64("id"), "id").limit(k).collect()
    centre = _unit_rows(np.array([r["vec"] for r in start], float))
    k, d = centre.shape
    vec = F.transform("vec", lambda x: x.cast("double"))
    blocked = vectors.select("id", "batch", vec.alias("z"), vec.alias("vec"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("blk"))
    tasks = max(1, min(vectors.sparkSession.sparkContext.defaultParallelism, n // (blocks * 1000)))
    current = [staged(blocked.where(F.col("blk") == at).drop("blk").repartition(tasks), "embedding") for at in range(blocks)]

    def batch_of(t: pa.RecordBatch) -> np.ndarray:
        return t["batch"].to_pandas().map(place).to_numpy()

    def units(t: pa.RecordBatch) -> np.ndarray:
        return _unit_rows(_matrix(t["vec"], d))

    def nearest(t: pa.RecordBatch, centre: np.ndarray) -> np.ndarray:
        u = units(t)
        far = u @ centre.T
        return np.concatenate([(np.eye(k)[far.argmax(1)].T @ u).ravel(), [far.max(1).sum()], np.bincount(batch_of(t), minlength=nb)])

    close = -np.inf
    everywhere = functools.reduce(DataFrame.union, current).select("batch", "vec")
    for _ in range(steps):  # k-means start
        flat = _summed(everywhere, functools.partial(nearest, centre=centre), k * d + 1 + nb)
        sums, before, close = flat[: k * d].reshape(k, d), close, flat[k * d]
        centre = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit_rows(sums), centre)
        if close - before <= 1e-4 * abs(close):
            break
    frequency = flat[k * d + 1 :] / n

    def soft(u: np.ndarray, b: np.ndarray, centre: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, float]:
        """Assignments, and the sum over rows of the logarithm of what they were divided by."""
        r = u @ (2 / sigma * centre.T)
        top = r.max(1, keepdims=True)
        r -= top
        np.exp(r, out=r)
        r *= balance.T[b]
        whole = r.sum(1, keepdims=True)
        r /= whole
        return r, (top - 2 / sigma + np.log(whole)).sum()

    def assigned(t: pa.RecordBatch, centre: np.ndarray, balance: np.ndarray) -> np.ndarray:
        u, b = units(t), batch_of(t)
        r, log = soft(u, b, centre, balance)
        held = r.T @ np.eye(nb)[b]
        # distances and entropy: the logarithm of an assignment is its distance's share plus its balance's less ``log``
        return np.concatenate([held.ravel(), (r.T @ u).ravel(), [sigma * ((held * np.log(balance)).sum() - log)]])

    def moments(t: pa.RecordBatch, used: tuple) -> np.ndarray:
        z, u, b = _matrix(t["z"], d), units(t), batch_of(t)
        r = soft(u, b, *used)[0]
        return np.concatenate([(r.T @ np.eye(nb)[b]).ravel(), np.stack([r[b == i].T @ z[b == i] for i in range(nb)], 1).ravel()])

    def move(parts: Iterator[pa.RecordBatch], used: tuple, shift: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t in parts:
            z, b = _matrix(t["z"], d), batch_of(t)
            r, out = soft(units(t), b, *used)[0], z.copy()
            for i in range(nb):
                out[b == i] -= r[b == i] @ shift[:, i]
            yield pa.RecordBatch.from_arrays([t["id"], t["batch"], t["z"], _lists(out)], ["id", "batch", "z", "vec"])

    objective, settled = [], False
    for _ in range(rounds):
        held, sums, used, value = np.zeros((blocks, k, nb)), np.zeros((blocks, k, d)), [(centre, np.ones((k, nb)))] * blocks, np.inf
        for step in range(steps):
            parts = np.zeros(blocks)
            for at in range(blocks):
                rest = held.sum(0) - held[at]
                balance = ((rest.sum(1, keepdims=True) * frequency + 1) / (rest + 1)) ** theta
                used[at] = (centre, balance)
                flat = _summed(current[at].select("batch", "vec"), functools.partial(assigned, centre=centre, balance=balance), k * nb + k * d + 1)
                held[at], sums[at], parts[at] = flat[: k * nb].reshape(k, nb), flat[k * nb : -1].reshape(k, d), flat[-1]
            whole = held.sum(0)
            spread = sigma * theta * (whole * np.log((whole + 1) / (whole.sum(1, keepdims=True) * frequency + 1))).sum()
            before, value = value, parts.sum() + spread
            if step and before - value <= cluster_tol * abs(before):
                break
            centre = _unit_rows(sums.sum(0))
        objective.append(float(value))
        flat = sum(_summed(current[at].select("batch", "z", "vec"), functools.partial(moments, used=used[at]), k * nb * (d + 1)) for at in range(blocks))
        mass, total = flat[: k * nb].reshape(k, nb), flat[k * nb :].reshape(k, nb, d)
        shift = np.zeros((k, nb, d))
        for c in range(k):
            a = np.zeros((nb + 1, nb + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = mass[c].sum(), mass[c], mass[c]
            a[1:, 1:] = np.diag(mass[c] + ridge)
            shift[c] = np.linalg.lstsq(a, np.vstack([total[c].sum(0), total[c]]), rcond=None)[0][1:]
        moved = [staged(current[at].mapInArrow(functools.partial(move, used=used[at], shift=shift), current[at].schema), "embedding") for at in range(blocks)]
        release(*current)
        current = moved
        if len(objective) > 1 and objective[-2] - objective[-1] < round_tol * abs(objective[-2]):
            settled = True
            break
    return functools.reduce(DataFrame.union, current).select("id", "batch", "vec"), objective, settled


def group_spectra(gram: np.ndarray, k: int, neighbors: int, density: float, starts: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """Cluster of each spectrum, -1 where it is left out, and the clusters' mean silhouette.

    ``gram``: inner products of unit spectra. A spectrum whose mean distance to its nearest ``neighbors`` is ``density``
    or more is left out; the others are parted by k-means with the least inertia of seeded starts. With fewer than k
    others all are left out.
    """
    far = np.sqrt(np.maximum(2 - 2 * gram, 0))
    np.fill_diagonal(far, 0)
    kept = np.flatnonzero(np.sort(far, 1)[:, 1 : neighbors + 1].mean(1) < density)
    if len(kept) < k:
        return np.full(len(gram), -1), 0.0
    far, (values, axes) = far[np.ix_(kept, kept)], np.linalg.eigh(gram[np.ix_(kept, kept)])
    x, rng, best = axes * np.sqrt(np.maximum(values, 0)), np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        at = [rng.integers(len(x))]
        while len(at) < k:
            d = (far[:, at] ** 2).min(1)
            at.append(rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x)))
        centre, label = x[at], None
        for _ in range(300):
            d = ((x[:, None] - centre) ** 2).sum(2)
            if label is not None and np.array_equal(label, d.argmin(1)):
                break
            label = d.argmin(1)
            centre = np.array([x[label == c].mean(0) if (label == c).any() else x[d.min(1).argmax()] for c in range(k)])
        best = min(best, (d.min(1).sum(), label), key=lambda t: t[0])
    own = np.eye(k)[best[1]]
    size, total = own.sum(0), far @ own
    inner = total[np.arange(len(x)), best[1]] / np.maximum(size[best[1]] - 1, 1)
    outer = np.where((own > 0) | (size == 0), np.inf, total / np.maximum(size, 1)).min(1)
    score = np.where(size[best[1]] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0) if np.isfinite(outer).all() else np.zeros(1)
    labels = np.full(len(gram), -1)
    labels[kept] = best[1]
    return labels, float(score.mean())


def consensus(entries: DataFrame, k: int, runs: int = 100, iterations: int = 1000, density: float = 0.5, neighbors: float = 0.3, tol: float = 1e-4, seed: int = 0, spectra: tuple[DataFrame, list[float], int] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Programs (program, feature, value), usages (id, vec) and figures of ``runs`` factorisations of rank k.

    Spectra of unit length are filtered by local density (``neighbors``: share of the runs), clustered, and each
    cluster's median over its spectra is scaled to sum 1. Usages are the rows fitted anew on the medians. Programs are
    numbered by falling total share of usage. Figures: errors of the runs, iterations, spectra kept, silhouette,
    prediction_error of the medians. Only the spectra's inner products, (runs k)^2 values, reach the driver. Where
    fewer than k spectra pass the filter the runs don't agree: there is no row, and spectra is 0. ``spectra`` are those of
    a finished grid (programs.merged_spectra), which are taken as they are.
    """
    h, errors, taken = spectra or nmf_runs(entries, k, runs, iterations, tol, seed)[1:]
    m = runs * k

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((m, m))
        for t in parts:
            if len(t):
                x = np.stack(t["vec"])
                out += x.T @ x
        yield pd.DataFrame({"i": np.arange(m), "x": list(out)})

    sums = h.select("vec").mapInPandas(products, "i int, x array<double>").select("i", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((m, m))
    gram[sums["i"], sums["j"]] = sums["x"]
    norm = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    labels, silhouette = group_spectra(gram / np.outer(norm, norm), k, max(1, int(neighbors * runs)), density, seed=seed)
    figures = {"errors": errors, "iterations": taken, "spectra": int((labels >= 0).sum()), "silhouette": silhouette}
    if not figures["spectra"]:
        kinds = [entries.schema[c].dataType.simpleString() for c in ("row", "col")]
        none = lambda schema: entries.sparkSession.createDataFrame([], schema)
        return none(f"program int, feature {kinds[1]}, value double"), none(f"id {kinds[0]}, vec array<double>"), figures | {"prediction_error": float("nan")}

    def medians(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            if len(t):
                x = np.stack(t["vec"]) / norm
                yield pd.DataFrame({"id": t["id"], "vec": list(np.stack([np.median(x[:, labels == c], 1) if (labels == c).any() else np.zeros(len(x)) for c in range(k)], 1))})

    median = staged(h.mapInPandas(medians, h.schema), "median")
    total = np.array(median.agg(F.array(*[F.sum(F.col("vec")[c]) for c in range(k)])).first()[0])
    median = staged(median.select("id", F.array(*[F.col("vec")[c] / float(total[c] or 1.0) for c in range(k)]).alias("vec"), F.array(F.lit(0.0)).alias("cross")), "median")
    cells = entries.select("row", "col", F.col("value").cast("double").alias("value"))
    basis = run_sums(median, 1, k)[0]
    usage = staged(fit_factor(cells, median, None, "row", basis, 200), "usage")
    own, cross = run_sums(usage, 1, k)
    square = cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    whole = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    shares = usage.agg(*[F.sum(divide(F.col("vec")[c], whole)).alias(f"s{c}") for c in range(k)]).first()
    order = sorted(range(k), key=lambda c: (-(shares[c] or 0.0), c))
    ordered = lambda t: t.select("id", F.array(*[F.col("vec")[c] for c in order]).alias("vec"))
    programs = ordered(median).select(F.posexplode("vec").alias("program", "value"), F.col("id").alias("feature")).select("program", "feature", "value")
    return programs, ordered(usage), figures | {"prediction_error": float(square - 2 * cross[0] + (basis * own).sum())}


def consensus_programs(entries: DataFrame, k: int, runs: int = 100, iterations: int = 1000, density: float = 0.5) -> tuple[DataFrame, list[float]]:
    """(program, feature, value) of ``consensus``, and the runs' errors."""
    programs, _, figures = consensus(entries, k, runs, iterations, density)
    return programs, figures["errors"]


def program_stability(entries: DataFrame, ranks: list[int], runs: int = 100, iterations: int = 1000) -> list[tuple[int, float, float]]:
    """(k, silhouette, prediction error) for each rank, over all spectra, for the choice of k."""
    found = [(k, consensus(entries, k, runs, iterations, density=np.inf)[2]) for k in ranks]
    return [(k, f["silhouette"], f["prediction_error"]) for k, f in found]


def expand_weights(spots: DataFrame, fitted: DataFrame, selected: DataFrame) -> DataFrame:
    """All spots with status, proportions, dominant type and its share; later rungs of the status win."""
    chosen, marked = selected.select("spot", F.lit(True).alias("_sel")), fitted.withColumn("_fit", F.lit(True))
    rows = spots.select("spot").join(chosen, "spot", "left").join(marked, "spot", "left")
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))
    valid = F.col("weights").isNotNull() & (total > 0) & ~F.exists(F.map_values("weights"), lambda x: F.isnan(x))
    status = F.when(F.col("_fit") & ~valid, "invalid_weights").when(F.col("_fit") & ~F.col("converged"), "not_converged").when(F.col("_fit"), "fitted").when(F.col("_sel"), "marker_filtered").otherwise("umi_filtered")
    shares = F.when(valid, F.transform_values("weights", lambda k, x: F.greatest(x, F.lit(0.0)) / total))
    ranked = F.array_sort(F.transform(F.map_entries("proportions"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    out = rows.select("spot", status.alias("status"), shares.alias("proportions"))
    return out.withColumn("dominant_type", F.coalesce(F.try_element_at(ranked, F.lit(1))["k"], F.lit("unassigned"))).withColumn("max_proportion", -F.try_element_at(ranked, F.lit(1))["v"])
