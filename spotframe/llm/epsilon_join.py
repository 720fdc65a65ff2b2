"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label link when their cosine, in double precision, is at least ``least``. On unit vectors that is a
Euclidean distance of at most eps = sqrt(2 - 2 * least), and so in any projection. Vectors are sorted by their cells
of width eps on the leading principal dimensions (label and length first), which makes near vectors near in the
sequence. The sequence is cut into blocks of bounded size. Starting from the whole sequence, pairs of intervals split
into pairs of halves, and a pair goes as soon as its bounding boxes lie farther apart than eps or share no label. Pairs
of blocks that stay meet in one task, where the recursion goes on with pairs of short runs; the runs that stay are
compared exactly.

Equal vectors of a label are one class with a count, and a block pair returns counts of links and a spanning forest,
so no step emits the pairs of a group.

Defined cases: vectors that are null, zero or hold null or non-finite components, and vectors with a null label, link
with nothing and are kept. Vectors link only with vectors of their own length; those of other lengths than the most
frequent one have no projection, so their blocks are all compared. Each row is a vector of its own, also where rows
repeat a ``vec_id``. A null ``vec_id`` has no component. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, running_start, staged
from .kernel import tidy

#: Leading principal dimensions of the grid; rows of a block, and of a run within it.
DIMENSIONS, BLOCK, RUN = 16, 2048, 64
#: Slack of the bounding boxes for rounding.
SLACK = 1e-9


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec, fine): vec as doubles, and whether it can link."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.withColumn("fine", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each length in an array<double> column, scaled by powers of two so that squares don't overflow."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        v = flat[first[rows, None] + np.arange(d)]
        yield rows, np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u @ v.T) / np.sqrt((u * u).sum(1)[:, None] * (v * v).sum(1))


def principal_axes(classes: DataFrame, dimensions: int) -> np.ndarray:
    """Leading eigenvectors of the covariance over all vectors; only sums of fixed size leave the tasks."""

    @tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, v in _by_length(batch.column("vec")):
                v = _unit(v)
                x = np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])  # count, first and second moments
                total[v.shape[1]] = total.get(v.shape[1], 0) + x
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["d", "x"])

    parts = classes.select("vec").mapInArrow(sums, "d int, x array<double>").select("d", F.posexplode("x").alias("i", "x"))
    found = staged(parts.groupBy("d", "i").agg(F.sum("x").alias("x")), "moments")
    top = found.where("i = 0").orderBy(F.desc("x"), "d").limit(1).collect()
    if not top:
        return np.zeros((0, dimensions))
    d, n = top[0]["d"], top[0]["x"]
    x = np.array([r["x"] for r in found.where(F.col("d") == d).orderBy("i").collect()])  # one length's moments
    mean, cov = x[1 : d + 1] / n, x[d + 1 :].reshape(d, d) / n
    values, axes = np.linalg.eigh(cov - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:dimensions]]
    return np.pad(axes, ((0, 0), (0, dimensions - axes.shape[1])))


def _sequenced(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """The classes in the epsilon grid order: label, digest, rep, weight, size, vec, proj, place, block. vec: bytes of doubles."""
    dims = axes.shape[1]
    carried = ["label", "digest", "rep", "weight"]

    @tidy
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in _by_length(batch.column("vec")):
                proj = _unit(v) @ axes if v.shape[1] == len(axes) else np.zeros((len(v), dims))
                cells = np.floor(proj / eps).astype(np.int32)
                offsets = pa.array(np.arange(len(rows) + 1) * dims, pa.int32())
                nested = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (proj, cells)]
                made = [pa.array(np.full(len(rows), v.shape[1], np.int32)), pa.array([x.tobytes() for x in v], pa.binary()), *nested]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in carried], *made], [*carried, "size", "vec", "proj", "cell"])

    placed = classes.select(*carried, "vec").mapInArrow(project, "label long, digest string, rep long, weight long, size int, vec binary, proj array<double>, cell array<int>")
    ordered = running_start(placed.withColumn("one", F.lit(1)), ["label", "size", "cell", "digest"], {"one": "place"}).drop("one", "cell")
    return ordered.withColumn("block", F.expr(f"place div {BLOCK}"))


def block_pairs(blocks: DataFrame, eps: float, exact: int, dims: int) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes come within eps; blocks: block, lo, hi.

    A box has ``exact`` values that must overlap, then ``dims`` projected ones.
    """
    levels = [staged(blocks, "boxes")]
    while levels[-1].limit(2).count() > 1:
        up = levels[-1].groupBy(F.expr("block div 2").alias("block"))
        box = lambda f, name: F.array(*[f(F.col(name)[i]) for i in range(exact + dims)]).alias(name)
        levels.append(staged(up.agg(box(F.min, "lo"), box(F.max, "hi")), "boxes"))
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    for level in reversed(levels[:-1]):
        kids = F.array(*[F.struct((F.col("a") * 2 + i).alias("a"), (F.col("b") * 2 + j).alias("b")) for i in (0, 1) for j in (0, 1)])
        split = pairs.select(F.inline(kids)).where("a <= b")
        left = level.select(F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        right = level.select(F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        both = split.join(left, "a").join(right, "b")
        gap = F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        far = F.aggregate(F.slice(gap, exact + 1, dims), F.lit(0.0), lambda s, x: s + x * x)
        apart = F.exists(F.slice(gap, 1, exact), lambda x: x > 0)
        pairs = staged(both.where(~apart & (far <= (eps + SLACK) ** 2)).select("a", "b"), "pairs")
    return pairs


def _run_boxes(proj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(proj), RUN)
    return np.minimum.reduceat(proj, starts), np.maximum.reduceat(proj, starts)


def _near_runs(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which runs of ``x`` may come within eps of which runs of ``y``; x, y: projections in sequence order."""
    (xlo, xhi), (ylo, yhi) = _run_boxes(x), _run_boxes(y)
    gap = np.maximum(np.maximum(xlo[:, None] - yhi, ylo - xhi[:, None]), 0)
    return (gap * gap).sum(2) <= (eps + SLACK) ** 2


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    """A side of a block pair in sequence order."""
    table = table.sort_by("place").combine_chunks()
    out = {c: table.column(c).to_numpy() for c in ("place", "weight", "label", "size")}
    return out | {"proj": table.column("proj").combine_chunks().flatten().to_numpy().reshape(len(table), -1), "vec": np.array(table.column("vec").to_pylist(), object)}


def compare(left: pa.Table, right: pa.Table, least: float, eps: float) -> pa.Table:
    """Link counts of the vectors of two blocks, and a spanning forest of their links, as (node, other, n).

    A block compared with itself gives each link from both of its ends.
    """
    nodes, others, counts = [], [], []
    if len(left) and len(right):
        same = left.column("pair_a")[0] == left.column("pair_b")[0]
        x, y = _arrays(left), _arrays(right)
        for label, size in sorted({*zip(x["label"].tolist(), x["size"].tolist(), strict=True)} & {*zip(y["label"].tolist(), y["size"].tolist(), strict=True)}):
            i, j = (np.flatnonzero((z["label"] == label) & (z["size"] == size)) for z in (x, y))
            u, v = (np.frombuffer(b"".join(z["vec"][k]), np.float64).reshape(len(k), size) for z, k in ((x, i), (y, j)))
            near = _near_runs(x["proj"][i], y["proj"][j], eps)
            hits = []
            for run, row in enumerate(near):
                k = np.flatnonzero(np.repeat(row, RUN)[: len(j)])
                p, q = np.nonzero(_cosines(u[run * RUN : (run + 1) * RUN], v[k]) >= least)
                hits.append((p + run * RUN, k[q]))
            p, q = (np.concatenate(z) for z in zip(*hits, strict=True))
            if same:
                p, q = p[p != q], q[p != q]
            xs, ys = x["place"][i], y["place"][j]
            sums = [(xs, np.bincount(p, y["weight"][j][q], len(i)))]
            if not same:
                sums.append((ys, np.bincount(q, x["weight"][i][p], len(j))))
            for name, total in sums:
                some = total > 0
                nodes.append(name[some])
                others.append(name[some])
                counts.append(total[some].astype(np.int64))
            ends = np.concatenate([xs, ys])
            root = _roots(len(ends), p, q + len(xs)) if not same else _roots(len(xs), p, q)
            moved = np.flatnonzero(root != np.arange(len(root)))
            nodes.append(ends[moved])
            others.append(ends[root[moved]])
            counts.append(np.zeros(len(moved), np.int64))
    joined = [np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64) for z in (nodes, others, counts)]
    return pa.table(dict(zip(("node", "other", "n"), joined, strict=True)))


def epsilon_join(vectors: DataFrame, least: float = 0.98, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    rows = staged(_usable(vectors).withColumn("digest", F.when(F.col("fine"), F.md5(F.to_json(F.struct("vec")).cast("binary")))), "vectors")
    usable = rows.where("fine")
    classes = usable.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = staged(classes, "classes")
    axes = principal_axes(classes, dimensions)
    seq = staged(_sequenced(classes, axes, eps), "sequence")
    dims = axes.shape[1]
    exact = [F.col("label").cast("double"), F.col("size").cast("double")]
    box = lambda f, name: F.array(*[f(x) for x in exact], *[f(F.col("proj")[i]) for i in range(dims)]).alias(name)
    pairs = staged(block_pairs(seq.groupBy("block").agg(box(F.min, "lo"), box(F.max, "hi")), eps, len(exact), dims), "block_pairs")

    carried = ["pair_a", "pair_b", "place", "weight", "label", "size", "vec", "proj"]

    def side(own: str, name: str) -> DataFrame:
        """The vectors of each pair's block ``own``; the two sides of a cogroup need columns of different names."""
        held = pairs.select(F.col(own).alias("block"), F.col("a").alias("pair_a"), F.col("b").alias("pair_b")).join(seq, "block")
        return held.select(*[F.col(c).alias(f"{name}{c}") for c in carried])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return compare(x.rename_columns(carried), y.rename_columns(carried), least, eps)

    met = side("a", "x_").groupBy("x_pair_a", "x_pair_b").cogroup(side("b", "y_").groupBy("y_pair_a", "y_pair_b"))
    found = staged(met.applyInArrow(run, "node long, other long, n long"), "found")
    root = components(found.where("node <> other"), "node", "other")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    of_class = seq.select("label", "digest", "rep", "weight", F.col("place").alias("node")).join(counts, "node", "left").join(root, "node", "left")
    of_class = staged(of_class.select("label", "digest", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "node").alias("root")), "of_class")
    least_id = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    linked = usable.select("vec_id", "label", "digest").join(of_class.join(least_id, "root").select("label", "digest", "links", "component"), ["label", "digest"])
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    component = F.when(F.col("vec_id").isNotNull(), F.col("component"))
    out = linked.select("vec_id", "links", "component").union(alone)
    return out.select("vec_id", F.col("links").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
