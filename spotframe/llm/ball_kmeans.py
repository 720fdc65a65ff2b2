"""Ball k-means on integer vectors, exact.

A cluster is a ball: its centroid and the largest distance of a member from it. Only a centroid within twice that
radius of the ball's own centroid can be nearer to one of its members, so a ball has a list of such neighbours, nearest
first. A member at distance d is compared with the neighbours whose centroids lie within 2 d, and with no others: below
half the way to the first neighbour lies the stable core, whose members stay without a comparison; each further annulus
adds one neighbour. Distances are squared integers throughout, so the bounds are exact, and a centroid that is as near
as the own one is compared, too: ties go to the smaller number, as with all distances.

A round is two passes over the vectors, which stay where they are: one sums each ball's members, the other finds the
radii of the new centroids and moves members. Tasks return k sums and k radii each, added up in Spark; the driver
holds k centroids and k * k distances, so k and the length of a vector bound it, not the number of vectors.

Defined cases: vectors that are null, of another length or hold null or non-finite components are left out. Each row is
a vector of its own, also where rows repeat a ``vec_id``; a null ``vec_id`` hashes as the empty string. Rows that tie in
the start order are taken by their components. With fewer vectors than k there are as many centroids as vectors; equal
centroids leave all but the first one empty, and an empty centroid stays where it is. Components too large for exact
products in floating point are worked on as Python integers; a distance or inertia beyond a long is null. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged
from .kernel import tidy

#: Clusters, rounds, length of a vector, and what a component is multiplied by before it is rounded down.
CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Bits of a limb of a sum, so that Spark adds sums of any size as longs in decimals.
LIMB = 40
#: Squared distances below this are exact in double precision.
EXACT = 1 << 52
_LONG = 1 << 63


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; int64 where all fit, else Python integers."""
    if not x.size or np.abs(x).max() < (1 << 50) / scale:
        return np.floor(x * scale).astype(np.int64)
    flat = [math.floor(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` from the vector ``c``, exact: int64 where they fit, else Python integers."""
    most = max((abs(int(y.max(initial=0))) + abs(int(y.min(initial=0))) for y in (x, c)), default=0)
    if most * most * 4 * len(c) < EXACT:
        d = x.astype(np.float64) - c.astype(np.float64)
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(1) if len(x) else np.zeros(0, object)


@dataclass
class Balls:
    """Centroids, their squared distances from each other, and each ball's neighbours, nearest first."""

    centroids: list[list[int]]
    #: For each ball the neighbours (squared distance of the centroids, number); None: all centroids, before the first round.
    neighbours: list[list[tuple[int, int]]] | None = None

    @classmethod
    def within(cls, centroids: list[list[int]], radii: dict[int, int]) -> Balls:
        """Neighbours of each ball of squared radius ``radii[i]``: two balls may share a member's nearest centroid only
        if the centroids are at most twice the radius apart. A ball without members needs none."""
        near = []
        for i, c in enumerate(centroids):
            apart = [(sum((p - q) ** 2 for p, q in zip(c, o, strict=True)), j) for j, o in enumerate(centroids) if j != i]
            near.append(sorted(x for x in apart if i in radii and x[0] <= 4 * radii[i]))
        return cls(centroids, near)

    def array(self, i: int) -> np.ndarray:
        c = self.centroids[i]
        return np.array(c, np.int64 if max(map(abs, c), default=0) < 1 << 50 else object)


def assign(x: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of ``x``, now in ball ``own``, and the number of distances taken."""
    cluster, best, taken = own.copy(), np.zeros(len(x), object), 0
    for i in np.unique(own).tolist():
        mine = np.flatnonzero(own == i)
        d = squared(x[mine], balls.array(i))
        near = [(0, j) for j in range(len(balls.centroids)) if j != i] if balls.neighbours is None else balls.neighbours[i]
        at, low = np.full(len(mine), i), d.copy()
        taken += len(mine)
        for apart, j in near:
            annulus = np.flatnonzero(4 * d >= apart)  # nearer members can't prefer j or any later neighbour
            if not len(annulus):
                break
            e = squared(x[mine[annulus]], balls.array(j))
            taken += len(annulus)
            closer = (e < low[annulus]) | ((e == low[annulus]) & (j < at[annulus]))
            low[annulus[closer]], at[annulus[closer]] = e[closer], j
        cluster[mine], best[mine] = at, low
    return cluster, best, taken


def _vectors(column: pa.Array, size: int, scale: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size), scale)


def _kept(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, x) of usable rows; x: doubles, an array without nulls."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = (F.size("x") == size) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("x IS NOT NULL").where(fine)


def _start(rows: DataFrame, clusters: int, size: int, scale: int) -> list[list[int]]:
    """The first centroids: the vectors whose ids have the smallest SHA-256; k rows come to the driver."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.withColumn("order", order).orderBy("order", "x").limit(clusters).collect()
    return [[int(v) for v in whole(np.array(r["x"], np.float64).reshape(1, size), scale)[0]] for r in first]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb, part) of an integer: the sum of part << (LIMB * limb)."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield limb, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        limb += 1


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """{(cluster, place): sum} of the tasks' sums by limb; k * (length + 1) values, a few limbs each, come to the driver."""
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        key = r["cluster"], r["place"]
        out[key] = out.get(key, 0) + (int(r["part"]) << (LIMB * r["limb"]))
    return out


def _sums(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(cluster, place, limb, part): each task's sums of its members' components; place ``size`` is their number."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            x, own = _vectors(batch.column("x"), size, scale), batch.column("cluster").to_numpy()
            for i in np.unique(own).tolist():
                mine = x[own == i]
                if len(mine) and x.dtype != object and np.abs(mine).max() > (1 << 62) // len(mine):
                    mine = mine.astype(object)
                sums = [*map(int, mine.sum(0)), len(mine)]
                total[i] = [a + b for a, b in zip(total[i], sums, strict=True)] if i in total else sums
        out = [(i, place, *limb) for i, sums in total.items() for place, s in enumerate(sums) for limb in _limbs(s)]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "place", "limb", "part"])

    return rows.select("x", "cluster").mapInArrow(run, "cluster int, place int, limb int, part long")


def _radii(rows: DataFrame, centroids: list[list[int]], size: int, scale: int) -> dict[int, int]:
    """The largest squared distance of a member from its centroid, for each cluster that has members."""
    balls = Balls(centroids)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            x, own = _vectors(batch.column("x"), size, scale), batch.column("cluster").to_numpy()
            for i in np.unique(own).tolist():
                most[i] = max(most.get(i, 0), int(squared(x[own == i], balls.array(i)).max()))
        yield pa.RecordBatch.from_arrays([pa.array([*most], pa.int32()), pa.array([f"{v:0400d}" for v in most.values()], pa.string())], ["cluster", "most"])

    found = rows.select("x", "cluster").mapInArrow(run, "cluster int, most string")  # as text of one length, the largest is the last
    return {r["cluster"]: int(r["most"]) for r in found.groupBy("cluster").agg(F.max("most").alias("most")).collect()}


def _moved(rows: DataFrame, balls: Balls, size: int, scale: int) -> DataFrame:
    """``rows`` (vec_id, x, cluster) in the balls of nearest centroids, with ``distance`` and ``taken`` distances a row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            cluster, best, taken = assign(_vectors(batch.column("x"), size, scale), own, balls)
            distance = pa.array([int(d) if d < _LONG else None for d in best.tolist()], pa.int64())
            counts = np.zeros(len(own), np.int64)
            counts[:1] = taken
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), distance, pa.array(counts)], ["vec_id", "x", "cluster", "distance", "taken"])

    return rows.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, x array<double>, cluster int, distance long, taken long")


def ball_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, x, cluster, distance, taken) of every usable row of ``vectors`` (vec_id, embedding), the centroids, and
    how many distances each assignment took."""
    rows = staged(_kept(vectors, size).withColumn("cluster", F.lit(0)), "vectors")
    centroids, taken = _start(rows, clusters, size, scale), []
    if not centroids:
        return _moved(rows, Balls([]), size, scale), [], []
    balls = Balls(centroids)
    for turn in range(rounds + 1):
        if turn:
            sums = _added(_sums(rows, size, scale))
            centroids = [[sums.get((i, p), 0) // n for p in range(size)] if (n := sums.get((i, size), 0)) else c for i, c in enumerate(centroids)]
            balls = Balls.within(centroids, _radii(rows, centroids, size, scale))
        moved = staged(_moved(rows, balls, size, scale), "moved")
        release(rows)
        taken.append(moved.agg(F.sum("taken")).first()[0])
        rows = moved
    return rows, centroids, taken


def cluster_table(vectors: DataFrame, **how: int) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per usable vector."""
    rows, centroids, _ = ball_kmeans(vectors, **how)
    spark, whole_sum = vectors.sparkSession, lambda c: F.expr(f"CASE WHEN count({c}) = count(*) THEN try_cast(sum(CAST({c} AS DECIMAL(38,0))) AS BIGINT) END")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = rows.groupBy("cluster").agg(whole_sum("distance").alias("cluster_inertia"))
    total = rows.agg(whole_sum("distance").alias("inertia"))
    # k rows and one row; joined to the vectors by broadcast
    of_cluster = F.broadcast(inertia.join(F.broadcast(named), "cluster").join(F.broadcast(total)))
    return rows.join(of_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
