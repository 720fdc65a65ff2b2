"""Mixtures of reference types in spots: platform effects, an overdispersed likelihood, full, doublet and multi modes.

A spot's count of a gene is Poisson with a log-normal rate: total * sum of weight * profile, times exp(sigma * normal).
Profiles are first brought to the spots' platform: the spots' summed counts are fitted by the profiles on a log scale,
and each gene's profile is scaled by what the fit leaves over. Sigma is the value of a grid under which fitted spots are
likeliest. Weights are non-negative and found by Newton steps on the likelihood, halved until it rises.

Genes and types meet in Spark; tasks hold the profiles of the chosen genes, a matrix whose size is checked.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.expect import Violation
from spotframe.staging import broadcast_if_small, staged

#: Values of the profile matrix (genes x types) that a task may hold.
MOST_VALUES = 8_000_000
#: Sigmas to choose from, and nodes of the integral over the log-normal factor.
SIGMAS = tuple(round(0.05 * i, 2) for i in range(1, 31))
NODES = 9
#: Published limits: full weights of candidates, gains in log-likelihood that tell types and doublets apart.
CANDIDATE, CONFIDENCE, DOUBLET = 0.01, 5.0, 20.0
_X, _W = np.polynomial.hermite.hermgauss(NODES)


def type_profiles(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(type, gene, share): mean over a type's cells of a gene's share of the cell's counts.

    ``cells``: cell, gene, n; ``labels``: cell, type. Cells without counts don't count.
    """
    totals = cells.groupBy("cell").agg(F.sum("n").cast("double").alias("t")).where("t > 0").join(labels.select("cell", "type"), "cell")
    sizes = totals.groupBy("type").agg(F.count("*").alias("m"))
    sums = cells.join(totals, "cell").groupBy("type", "gene").agg(F.sum(F.col("n") / F.col("t")).alias("s"))
    return sums.join(F.broadcast(sizes), "type").select("type", "gene", (F.col("s") / F.col("m")).alias("share"))


def marker_genes(profiles: DataFrame, bulk: DataFrame, least_share: float, least_fold: float, least_count: int = 10) -> DataFrame:
    """(gene): genes with at least ``least_count`` counts in ``bulk`` (gene, n) whose share in some type is ``least_share``
    or more and above the mean share in the other types by ``least_fold`` in natural logarithms."""
    k = profiles.select("type").distinct().count()
    sums = profiles.groupBy("gene").agg(F.sum("share").alias("all"))
    rows = profiles.join(sums, "gene").where(F.col("share") >= least_share)
    fold = F.log(F.col("share")) - F.log((F.col("all") - F.col("share")) / max(k - 1, 1) + 1e-9)
    return rows.where(fold >= least_fold).select("gene").distinct().join(bulk.where(F.col("n") >= least_count).select("gene"), "gene", "left_semi")


def _wide(profiles: DataFrame, types: list[str]) -> DataFrame:
    """(gene, shares): a gene's shares in the order of ``types``."""
    return profiles.groupBy("gene").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("type") == t, F.col("share"))), F.lit(0.0)).cast("double") for t in types]).alias("shares"))


def _nonnegative(h: np.ndarray, g: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """The x >= 0 of least x'hx / 2 - g'x, one component after another."""
    x, diagonal = np.zeros(len(g)), np.maximum(np.diag(h), 1e-300)
    for _ in range(sweeps):
        before = x.copy()
        for i in range(len(g)):
            x[i] = max(0.0, x[i] + (g[i] - h[i] @ x) / diagonal[i])
        if np.abs(x - before).max() <= 1e-10 * max(x.max(), 1e-12):
            break
    return x


def platform_effects(bulk: DataFrame, profiles: DataFrame, rounds: int = 50, tol: float = 1e-6) -> tuple[DataFrame, dict[str, float]]:
    """(gene, effect) and the types' proportions in the spots' summed counts ``bulk`` (gene, n).

    Proportions fit the logarithms of the counts by least squares; an effect is a gene's share of all counts over the
    fitted one. Each round is one pass over the genes; sums of k x k values reach the driver. Raises where rounds run out.
    """
    types = [r[0] for r in profiles.select("type").distinct().orderBy("type").collect()]  # one row a type
    k = len(types)
    total = bulk.agg(F.sum("n")).first()[0]
    met = bulk.where("n > 0").join(_wide(profiles, types), "gene").select("gene", (F.col("n") / float(total or 1)).alias("b"), "shares")
    met = staged(met.where(F.exists("shares", lambda x: x > 0)), "bulk")

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(1 + k + k * k)
            for t in parts:
                if len(t):
                    s = np.stack(t["shares"])
                    p = np.maximum(s @ w, 1e-12)
                    left, j = np.log(t["b"].to_numpy()) - np.log(p), s / p[:, None]
                    out += np.concatenate([[left @ left], j.T @ left, (j.T @ j).ravel()])
            yield pd.DataFrame({"x": [out]})

        x = sum(np.array(r["x"]) for r in met.select("b", "shares").mapInPandas(run, "x array<double>").collect())  # a row a task
        return x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k)

    w = np.full(k, 1 / k)
    error, slope, curve = sums(w)
    for _ in range(rounds):
        aim, step = _nonnegative(curve + 1e-9 * np.eye(k) * max(np.trace(curve), 1e-12), slope + curve @ w), 1.0
        while True:
            new = w + step * (aim - w)
            now = sums(new)
            if now[0] <= error or step < 1e-4:
                break
            step /= 2
        moved, fell = np.abs(new - w).sum(), error - now[0]
        if now[0] <= error:
            w, (error, slope, curve) = new, now
        if moved <= tol * w.sum() or fell <= tol * max(error, 1e-12):
            break
    else:
        raise Violation(f"platform effects aren't settled after {rounds} rounds")
    fitted = F.aggregate(F.zip_with("shares", F.array(*map(F.lit, map(float, w))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    effects = met.select("gene", (F.col("b") / F.greatest(fitted, F.lit(1e-12))).alias("effect"))
    return effects, dict(zip(types, (w / w.sum()).tolist(), strict=True))


def log_likelihood(y: np.ndarray, rate: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of counts ``y`` under Poisson rates ``rate`` * exp(sigma * normal): value, first and second derivative by the rate.

    The integral is taken at nodes around the mode of its integrand, which has a single one. log(y!) is left out.
    """
    rate, s2 = np.maximum(rate, 1e-9), sigma * sigma
    s = np.clip(np.log((y + 0.5) / rate), -4 * sigma, 4 * sigma) * s2 / (s2 + 1 / (y + 1))
    for _ in range(20):
        e = rate * np.exp(s)
        step = np.clip((e - y + s / s2) / (e + 1 / s2), -1.0, 1.0)
        s = s - step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    width = np.sqrt(2 / (rate * np.exp(s) + 1 / s2))
    at = s[..., None] + width[..., None] * _X
    f = y[..., None] * (at + np.log(rate)[..., None]) - rate[..., None] * np.exp(at) - at * at / (2 * s2) + _X * _X + np.log(_W)
    top = f.max(-1)
    p = np.exp(f - top[..., None])
    total = p.sum(-1)
    value = top + np.log(total) + np.log(width) - 0.5 * np.log(2 * np.pi * s2)
    p /= total[..., None]
    d = y[..., None] / rate[..., None] - np.exp(at)
    first = (p * d).sum(-1)
    second = (p * d * d).sum(-1) - y / (rate * rate) - first * first
    return value, first, second


def fit_weights(y: np.ndarray, basis: np.ndarray, sigma: float, rounds: int = 50, tol: float = 1e-3) -> tuple[np.ndarray, float, bool]:
    """Non-negative weights of the columns of ``basis`` (rates), the log-likelihood and whether the steps settled."""
    k = basis.shape[1]
    w = np.full(k, y.sum() / max(basis.sum(), 1e-12))
    value, first, second = log_likelihood(y, basis @ w, sigma)
    now = value.sum()
    for _ in range(rounds):
        slope, curve = basis.T @ first, basis.T @ (basis * np.maximum(-second, 1e-12)[:, None])
        aim, step = _nonnegative(curve + 1e-9 * np.eye(k) * max(np.trace(curve), 1e-12), slope + curve @ w, 50), 1.0
        while True:
            new = w + step * (aim - w)
            found = log_likelihood(y, basis @ new, sigma)
            if found[0].sum() >= now - 1e-9 or step < 1e-4:
                break
            step /= 2
        moved = np.abs(new - w).sum()
        if found[0].sum() >= now - 1e-9:
            w, (value, first, second) = new, found
            now = value.sum()
        if moved <= tol * max(w.sum(), 1e-12):
            return w, float(now), True
    return w, float(now), False


def doublet(y: np.ndarray, basis: np.ndarray, sigma: float, full: np.ndarray) -> dict:
    """The best pair of candidate types, whether each of the two is sure, and whether one type alone does as well.

    A type is sure if every pair within CONFIDENCE of the best one holds it. The spot is a singlet if the better single
    type is within DOUBLET of the best pair.
    """
    k, share = basis.shape[1], full / max(full.sum(), 1e-12)
    candidates = [i for i in np.argsort(-share, kind="stable").tolist() if share[i] > CANDIDATE]
    candidates = sorted(candidates if len(candidates) >= 2 else np.argsort(-share, kind="stable")[: min(3, k)].tolist())
    scores = {p: fit_weights(y, basis[:, p], sigma) for p in itertools.combinations(candidates, 2)}
    if not scores:
        return {"spot_class": "singlet", "first": 0, "second": None, "weights": full[:1], "gain": 0.0}
    best = max(scores, key=lambda p: (scores[p][1], [-i for i in p]))
    top = scores[best][1]
    close = [p for p in scores if scores[p][1] > top - CONFIDENCE]
    sure = [all(i in p for p in close) for i in best]
    single = {i: fit_weights(y, basis[:, [i]], sigma) for i in best}
    w = scores[best][0]
    first, second = (0, 1) if w[0] >= w[1] else (1, 0)
    alone = max(best, key=lambda i: (single[i][1], -i))
    gain = top - single[alone][1]
    if gain < DOUBLET:
        others = max((single_score(y, basis, i, sigma) for i in candidates if i != alone), default=-np.inf)
        kind = "singlet" if others <= single[alone][1] - CONFIDENCE or any(sure) else "reject"
        return {"spot_class": kind, "first": alone, "second": best[0] if best[1] == alone else best[1], "weights": np.array([single[alone][0][0], 0.0]), "gain": gain}
    kind = "doublet_certain" if all(sure) else "doublet_uncertain" if any(sure) else "reject"
    if kind == "doublet_uncertain" and not sure[first]:
        first, second = second, first  # the sure type is named first
    return {"spot_class": kind, "first": best[first], "second": best[second], "weights": w[[first, second]], "gain": gain}


def single_score(y: np.ndarray, basis: np.ndarray, i: int, sigma: float) -> float:
    return fit_weights(y, basis[:, [i]], sigma)[1]


def multi(y: np.ndarray, basis: np.ndarray, sigma: float, full: np.ndarray, most: int = 4) -> tuple[list[int], np.ndarray, list[bool]]:
    """Types taken one after another while the best further one gains DOUBLET or more, their weights, and which are sure.

    A type is sure if no other candidate in its place comes within CONFIDENCE.
    """
    share = full / max(full.sum(), 1e-12)
    order = np.argsort(-share, kind="stable").tolist()
    candidates = [i for i in order if share[i] > CANDIDATE] or order[:1]
    taken, score, weights = [], -np.inf, np.zeros(0)
    while len(taken) < most:
        tried = [(fit_weights(y, basis[:, [*taken, i]], sigma), i) for i in candidates if i not in taken]
        if not tried:
            break
        (w, value, _), i = max(tried, key=lambda t: (t[0][1], -t[1]))
        if taken and value - score < DOUBLET:
            break
        taken, score, weights = [*taken, i], value, w
    sure = []
    for at in range(len(taken)):
        swaps = [[*taken[:at], i, *taken[at + 1 :]] for i in candidates if i not in taken]
        sure.append(all(fit_weights(y, basis[:, s], sigma)[1] <= score - CONFIDENCE for s in swaps))
    return taken, weights, sure


def _rows(counts: DataFrame, genes: DataFrame, totals: DataFrame) -> DataFrame:
    """(spot, total, at, n): a spot's counts of the numbered ``genes`` (gene, at); spots without any are left out."""
    met = counts.where("n > 0").join(broadcast_if_small(genes.select("gene", "at")), "gene")
    cells = met.groupBy("spot").agg(F.collect_list(F.struct("at", F.col("n").cast("double").alias("n"))).alias("c"))
    return cells.join(totals, "spot").select("spot", "total", F.col("c.at").alias("at"), F.col("c.n").alias("n"))


def _dense(t: pd.DataFrame, genes: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, (at, n) in enumerate(zip(t["at"], t["n"], strict=True)):
        y = np.zeros(genes)
        y[at] = n
        yield i, y


def deconvolve(counts: DataFrame, profiles: DataFrame, mode: str = "full", least_share: float = 2e-4, least_fold: float = 0.75, least_count: int = 10, sigma_spots: int = 100, sigma_total: float = 300.0, most_types: int = 4, sigma: float | None = None) -> tuple[DataFrame, dict]:
    """Fitted spots of ``counts`` (spot, gene, n) and figures: sigma, proportions of the summed counts, genes.

    ``profiles``: type, gene, share. Platform effects come from genes of a lower fold (0.5) and share (1.25e-4); the fit
    uses those of ``least_fold`` and ``least_share``. Spots without a count of these genes have no row; where no gene passes
    these limits, no spot has one, and figures say genes 0 with neither sigma nor proportions. Modes:

    - full: spot, weights (map by type), converged
    - doublet: also spot_class, first_type, second_type, first_weight, second_weight, gain
    - multi: also types, type_weights, confident (arrays)

    Sigma is chosen on at most ``sigma_spots`` spots of more than ``sigma_total`` counts, those of least hash.
    """
    if mode not in ("full", "doublet", "multi"):
        raise Violation(f"unknown mode {mode}")
    profiles = staged(profiles.where("share > 0").select(F.col("type").cast("string").alias("type"), "gene", F.col("share").cast("double").alias("share")), "profiles")
    more = {"full": "", "doublet": ", spot_class string, first_type string, second_type string, first_weight double, second_weight double, gain double", "multi": ", types array<string>, type_weights array<double>, confident array<boolean>"}[mode]
    schema = f"spot {counts.schema['spot'].dataType.simpleString()}, weights map<string, double>, converged boolean{more}"
    bulk = staged(counts.groupBy("gene").agg(F.sum("n").alias("n")), "bulk")
    chosen = staged(marker_genes(profiles, bulk, least_share, least_fold, least_count), "chosen")
    if chosen.isEmpty():
        return counts.sparkSession.createDataFrame([], schema), {"sigma": None, "proportions": {}, "genes": 0}
    effects, proportions = platform_effects(bulk.join(marker_genes(profiles, bulk, 1.25e-4, min(0.5, least_fold), least_count), "gene", "left_semi"), profiles)
    types = sorted(proportions)
    scaled = profiles.join(effects, "gene").join(chosen, "gene", "left_semi").select("type", "gene", (F.col("share") * F.col("effect")).alias("share"))
    wide = staged(_wide(scaled, types), "shares")
    n_genes = wide.count()
    if n_genes * len(types) > MOST_VALUES:
        raise Violation(f"{n_genes} genes x {len(types)} types: raise least_fold or least_share")
    if not n_genes:
        raise Violation("no gene tells the types apart")
    table = wide.orderBy("gene").toPandas()  # at most MOST_VALUES values, as checked
    basis = np.stack(table["shares"])
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast(basis)
    genes = staged(spark.createDataFrame(pd.DataFrame({"gene": table["gene"], "at": np.arange(n_genes)}), f"gene {counts.schema['gene'].dataType.simpleString()}, at int"), "genes")
    totals = counts.groupBy("spot").agg(F.sum("n").cast("double").alias("total"))
    rows = staged(_rows(counts, genes, totals), "spots")
    sigma = sigma or choose_sigma(rows, held, sigma_spots, sigma_total)

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            out = []
            for i, y in _dense(t, n_genes):
                rates = held.value * t["total"].iloc[i]
                w, _, settled = fit_weights(y, rates, sigma)
                row = {"spot": t["spot"].iloc[i], "weights": dict(zip(types, w.tolist(), strict=True)), "converged": settled}
                if mode == "doublet":
                    d = doublet(y, rates, sigma, w)
                    pair = [*d["weights"].tolist(), 0.0][:2]
                    row |= {"spot_class": d["spot_class"], "first_type": types[d["first"]], "second_type": None if d["second"] is None else types[d["second"]], "first_weight": pair[0], "second_weight": pair[1], "gain": float(d["gain"])}
                if mode == "multi":
                    taken, tw, sure = multi(y, rates, sigma, w, most_types)
                    row |= {"types": [types[j] for j in taken], "type_weights": tw.tolist(), "confident": sure}
                out.append(row)
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(fit, schema), {"sigma": sigma, "proportions": proportions, "genes": n_genes}


def choose_sigma(rows: DataFrame, held, spots: int, least_total: float) -> float:
    """The sigma of SIGMAS with the largest likelihood of the sampled spots, fitted anew under each sigma in turn until it stays."""
    some = rows.where(F.col("total") > least_total).orderBy(F.xxhash64("spot"), "spot").limit(spots)
    n_genes = held.value.shape[0]

    def chosen(t: pd.DataFrame) -> pd.DataFrame:
        sigma, seen = 0.5, set()
        ys = [(y, held.value * t["total"].iloc[i]) for i, y in _dense(t, n_genes)]
        while sigma not in seen:
            seen.add(sigma)
            rates = [r @ fit_weights(y, r, sigma)[0] for y, r in ys]
            value = {s: sum(float(log_likelihood(y, r, s)[0].sum()) for (y, _), r in zip(ys, rates, strict=True)) for s in SIGMAS}
            sigma = max(value, key=lambda s: (value[s], -s))
        return pd.DataFrame({"sigma": [sigma]})

    found = some.groupBy(F.lit("all").alias("all")).applyInPandas(chosen, "sigma double").first()  # ``spots`` rows
    if found is None:
        raise Violation(f"no spot has more than {least_total} counts for the choice of sigma")
    return found["sigma"]
