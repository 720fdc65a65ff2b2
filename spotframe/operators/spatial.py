"""Spots on a tissue grid: registration, nearest spots, neighbours, layers and pair scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.expect import expect
from spotframe.functions.columns import divide
from spotframe.operators.neighbors import blocks_of, distinct_units
from spotframe.staging import BROADCAST_ROWS, broadcast_if_small, release, staged

#: Places of a leaf at most in the search for the nearest spot.
LEAF = 16

#: Radii of a tile's side in pair scores.
TILE = 4


def affine(rows: DataFrame, x: str, y: str, degrees: float, dx: float, dy: float, centre: tuple[float, float]) -> DataFrame:
    """Coordinates rotated about the moving image's centre, then moved: columns moved_x, moved_y."""
    a = F.radians(F.lit(degrees))
    u, v = F.col(x) - centre[0], F.col(y) - centre[1]
    return rows.withColumn("moved_x", centre[0] + u * F.cos(a) - v * F.sin(a) + dx).withColumn("moved_y", centre[1] + u * F.sin(a) + v * F.cos(a) + dy)


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))


def _cell(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width)


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (id, other, d2) of points (id, x, y, part) of one part at most ``radius`` apart, by grid cells of that width."""
    a = left.withColumn("_cx", _cell("x", radius)).withColumn("_cy", _cell("y", radius))
    b = right.select("part", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = b.withColumn("_o", F.explode(around)).withColumn("_cx", _cell("ox", radius) + F.col("_o.i")).withColumn("_cy", _cell("oy", radius) + F.col("_o.j")).drop("_o")
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return a.join(b, ["part", "_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("part", "id", "other", "d2", "x", "y", "ox", "oy")


def reference_tree(reference: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(part, rep, vec, ids, path): distinct places of the spots (part, id, x, y) in the leaves of a tree of their part.

    A leaf holds at most ``leaf`` places, however dense or far apart they are; ``ids`` are a place's two smallest ids.
    Spots without a finite place can't be near anything and are left out.
    """
    placed = reference.where(_finite("x") & _finite("y")).select("part", "id", F.array("x", "y").alias("vec"))
    return blocks_of(distinct_units(placed, ["part"], 1)[0], ["part"], 2, leaf)


def _boxes(tree: DataFrame, level: int) -> DataFrame:
    """Bounding boxes of the tree's nodes of a level, with the spots in them (a place counts at most twice)."""
    x, y = F.col("vec")[0], F.col("vec")[1]
    nodes = tree.where(F.length("path") >= level).groupBy("part", F.substring("path", 1, level).alias("node"))
    boxes = nodes.agg(F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh"), F.sum(F.size("ids")).alias("n"), (F.max(F.length("path")) == level).alias("leaf"))
    return staged(boxes.withColumn("parent", F.substring("node", 1, max(level - 1, 0))), "boxes")


def leaf_pairs(moving: DataFrame, tree: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(part, id, x, y, node): the leaves of the tree that may hold a spot's nearest one.

    From level to level a spot opens its boxes, and of all those only boxes stay whose nearest corner isn't farther than
    the farthest corner of another one. A leaf waits with its distances until the deeper ones are reached.
    """
    depth = tree.agg(F.max(F.length("path"))).first()[0] or 0
    near = [F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0)) for v, lo, hi in (("x", "xl", "xh"), ("y", "yl", "yh"))]
    far = [F.greatest(F.abs(F.col(v) - F.col(lo)), F.abs(F.col(v) - F.col(hi))) for v, lo, hi in (("x", "xl", "xh"), ("y", "yl", "yh"))]
    # a box of one spot may hold just the spot itself, which is no bound for another one
    bound = F.when((F.col("n") > 1) | F.lit(not exclude_self), far[0] * far[0] + far[1] * far[1])
    least = F.min("far").over(Window.partitionBy("part", "id"))
    columns = ["part", "id", "x", "y", "node", "leaf", "near", "far"]
    found = moving.where(_finite("x") & _finite("y")).select("part", "id", "x", "y", F.lit("").alias("parent"))
    waiting = last = None
    for level in range(depth + 1):
        boxes = _boxes(tree, level)
        met = found.join(broadcast_if_small(boxes), ["part", "parent"]).withColumns({"near": near[0] * near[0] + near[1] * near[1], "far": bound}).select(*columns)
        met = met if waiting is None else met.union(waiting.select(*columns))
        kept = staged(met.withColumn("least", least).where(F.col("least").isNull() | (F.col("near") <= F.col("least"))).select(*columns), "leaves")
        release(boxes, last)
        last = kept
        waiting, found = kept.where("leaf"), kept.where("NOT leaf").select("part", "id", "x", "y", F.col("node").alias("parent"))
    return waiting.select("part", "id", "x", "y", "node")


def nearest_spot(moving: DataFrame, reference: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(part, id, other, d2): the nearest reference spot of each moving one in its part; ties go to the smaller id.

    Null other and d2 where the part has no reference spot, or with ``exclude_self`` none but the spot itself, or where
    the moving spot has no finite place. There is no radius: a tree that splits dense boxes alone is searched from the
    whole part down to leaves of a few places, so neither one far spot nor a dense cluster makes pairs of far spots.
    """
    tree = reference_tree(reference)
    leaves = leaf_pairs(moving, tree, exclude_self)
    places = tree.select("part", F.col("path").alias("node"), F.col("vec")[0].alias("ox"), F.col("vec")[1].alias("oy"), F.explode("ids").alias("other"))
    pairs = leaves.join(places, ["part", "node"])
    if exclude_self:
        pairs = pairs.where("id <> other")
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    best = pairs.groupBy("part", "id").agg(F.min(F.struct(d2.alias("d2"), F.col("other").alias("other"))).alias("k"))
    return moving.select("part", "id").join(best, ["part", "id"], "left").select("part", "id", F.col("k.other").alias("other"), F.col("k.d2").alias("d2"))


def square_overlap(moving: DataFrame, reference: DataFrame, side: float) -> DataFrame:
    """Nearest pairs whose squares of width ``side`` overlap on both axes; no reference spot may be taken twice."""
    pairs = within(moving, reference, side * 2**0.5)
    best = pairs.groupBy("part", "id").agg(F.min(F.struct("d2", "other", "x", "y", "ox", "oy")).alias("k")).select("part", "id", "k.*")
    hits = best.where((F.abs(F.col("x") - F.col("ox")) < side) & (F.abs(F.col("y") - F.col("oy")) < side)).select("part", "id", "other", "d2")
    return expect(hits, unique=[["part", "other"]])


def nearest_median(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per part: source spots that have another target spot, and the median distance to the nearest of these."""
    return nearest_spot(source, target, exclude_self=True).groupBy("part").agg(F.count("d2").alias("n"), F.median(F.sqrt("d2")).alias("median_distance"))


def grid_neighbors(rows: DataFrame, part: list[str], row: str, col: str) -> DataFrame:
    """Each spot with each of its eight grid neighbours' columns, prefixed ``n_``; missing cells give no row."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    moved = rows.select("*", F.explode(around).alias("_o")).withColumn("_r", F.col(row) + F.col("_o.i")).withColumn("_c", F.col(col) + F.col("_o.j")).drop("_o")
    other = rows.select(*[F.col(c).alias(f"n_{c}") for c in rows.columns])
    same = [F.col(p) == F.col(f"n_{p}") for p in part]
    on = (F.col("_r") == F.col(f"n_{row}")) & (F.col("_c") == F.col(f"n_{col}"))
    for s in same:
        on = on & s
    return moved.join(other, on).drop("_r", "_c")


def drop_isolated(rows: DataFrame, part: list[str], spot: str, row: str, col: str, label: str, none: str = "none") -> DataFrame:
    """Labels without an equal label among the eight neighbours become ``none``; all spots are judged at once."""
    near = grid_neighbors(rows.select(*part, spot, row, col, label), part, row, col).where(F.col(label) == F.col(f"n_{label}")).select(spot).distinct().withColumn("_ok", F.lit(True))
    return rows.join(near, spot, "left").withColumn(label, F.when((F.col(label) == none) | F.col("_ok"), F.col(label)).otherwise(none)).drop("_ok")


def call_layer(weights: DataFrame, layers: dict[str, list[str]], fitted: Column, least: float = 0.5, margin: float = 0.0, types: list[str] = ()) -> DataFrame:
    """``weights`` with best_weight and layer: the one layer at ``least`` or more, fitted, ahead by the margin; else none.

    A layer's weight is the sum of its columns. A row that lacks any weight, those of ``types`` outside the layers
    included, has no layer; a negative or infinite weight raises.
    """
    every = [F.col(c).cast("double") for c in dict.fromkeys([*(c for cols in layers.values() for c in cols), *types])]
    finite = lambda x: x.isNotNull() & ~F.isnan(x)
    bad = functools.reduce(lambda a, b: a | b, [finite(x) & ((x < 0) | (F.abs(x) == float("inf"))) for x in every])
    weights = weights.where(F.when(bad, F.raise_error(F.lit("weights must be nonnegative finite numbers or missing")).cast("boolean")).otherwise(True))
    sums = {}
    for name, cols in layers.items():
        total = F.col(cols[0])
        for c in cols[1:]:
            total = total + F.col(c)
        sums[name] = total
    complete = functools.reduce(lambda a, b: a & b, [finite(x) for x in every])
    ranked = F.sort_array(F.array(*[F.struct(s.alias("w"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, s) in enumerate(sums.items())]), asc=False)
    qualifying = sum((F.when((s >= least) & (s > 0), 1).otherwise(0) for s in sums.values()), F.lit(0))
    gap = ranked[0]["w"] - ranked[1]["w"]
    fine = complete & fitted & (qualifying == 1) & (gap >= margin) & (gap > 1e-12)
    return weights.withColumn("best_weight", F.when(complete, ranked[0]["w"])).withColumn("layer", F.when(fine, ranked[0]["n"]).otherwise("none"))


def grid_pitch(rows: DataFrame, part: str, axis: str) -> DataFrame:
    """Per part the least difference between neighbouring distinct coordinates of an axis."""
    before = F.lag(axis).over(Window.partitionBy(part).orderBy(axis))
    return rows.select(part, axis).distinct().withColumn("_d", F.col(axis) - before).groupBy(part).agg(F.min("_d").alias("pitch"))


def to_microns(rows: DataFrame, meta: DataFrame, sample: str, x: str, y: str) -> DataFrame:
    """Pixel coordinates times their sample's pixel_size_um: columns x_um, y_um."""
    return rows.join(meta.select(sample, "pixel_size_um"), sample).withColumn("x_um", F.col(x) * F.col("pixel_size_um")).withColumn("y_um", F.col(y) * F.col("pixel_size_um")).drop("pixel_size_um")


def pair_scores(values: DataFrame, spots: DataFrame, pairs: DataFrame, sigma: float = 125.0, radius: float = 250.0, include_self: bool = True, direction: str = "incoming") -> DataFrame:
    """(id, pair, score) of each pair at each spot: one role's value times the Gaussian-weighted mean of the other's around.

    ``incoming``: the receptor here, ligands around; ``outgoing``: the ligand here, receptors around. ``values``: id,
    gene, value (scaled), one for an id and gene; ``spots``: id, x, y, part; ``pairs``: pair, ligand, receptor. This is our
    own definition; weights are exp(-d2 / (2 sigma^2)) within ``radius`` and sum to one at each spot. A score without a row
    is zero. A value goes to its tile and those in reach, a square of ``TILE`` radii each, not to every spot around it; it
    meets only spots of a tile that hold the pair's other gene.
    """
    if direction not in ("incoming", "outgoing"):
        raise ValueError(f"no direction {direction!r}")
    here, there = ("receptor", "ligand") if direction == "incoming" else ("ligand", "receptor")
    weight = F.exp(-F.col("d2") / (2 * sigma * sigma))
    total = _around(spots, radius, include_self).groupBy("id").agg(F.sum(weight).alias("total"))
    side, reach = TILE * radius, radius * (1 + 2**-10)  # a little farther, for rounding
    at, tile = spots.select("part", "id", "x", "y"), ["part", "_tx", "_ty"]
    own = at.withColumn("_tx", _cell("x", side)).withColumn("_ty", _cell("y", side))
    tiles = staged(own.select(*tile).distinct().withColumn("tile", F.monotonically_increasing_id()), "tiles")
    own = own.join(tiles, tile).join(total, "id").select("id", "tile", "x", "y", "total")
    spanned = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    reached = at.withColumn("_tx", spanned("x")).withColumn("_ty", spanned("y")).join(tiles, tile)
    reached = reached.select("id", "tile", F.col("x").alias("ox"), F.col("y").alias("oy"))
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sending = values.join(F.broadcast(pairs.select(F.col(there).alias("gene")).distinct()), "gene", "left_semi") if few else values
    sent = sending.join(reached, "id").select("tile", F.col("gene").alias(there), F.col("id").alias("other"), "ox", "oy", F.col("value").alias("sent"))
    got = values.join(own, "id").select("tile", "id", "x", "y", F.col("gene").alias(here), divide(F.col("value"), F.col("total")).alias("share"))
    got = got.join(F.broadcast(pairs) if few else pairs, here).select("tile", there, "pair", here, "id", "x", "y", "share")
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    met = got.join(sent, ["tile", there]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    met = met if include_self else met.where("id <> other")
    out = met.groupBy("id", "pair", here, "share").agg(F.sum(weight * F.col("sent")).alias("got"))
    return out.select("id", "pair", (F.col("got") * F.col("share")).alias("score"))


def _around(spots: DataFrame, radius: float, include_self: bool) -> DataFrame:
    near = within(spots, spots, radius)
    return near if include_self else near.where("id <> other")


def score_available(spots: DataFrame, radius: float = 250.0, include_self: bool = True) -> DataFrame:
    """``spots`` with score_available: whether any spot lies within ``radius``, itself counted with ``include_self``."""
    near = _around(spots, radius, include_self)
    return spots.join(near.select("id").distinct().withColumn("_near", F.lit(True)), "id", "left").withColumn("score_available", F.coalesce("_near", F.lit(False))).drop("_near")
