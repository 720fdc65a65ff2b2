"""Connected components; staged tables, checked broadcasts and ordered sums are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.staging import BROADCAST_ROWS, broadcast_if_small, new_folder, release, running_start, shuffle_width, staged

__all__ = ["BROADCAST_ROWS", "broadcast_if_small", "components", "new_folder", "release", "running_start", "shuffle_width", "staged"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` reaches. Nodes without an edge are absent.

    Contraction: every node points to its smallest neighbour, pointers are followed twice, edges between
    roots are kept; rounds end when none is left. Each round is staged, so lineage stays short.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs = staged(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        point = staged(point, "point")
        for _ in range(2):
            up = point.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = staged(point.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "point")
            release(point)
            point = jumped
        if mapping is None:
            moved = point
        else:
            moved = staged(mapping.join(point.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            release(mapping)
        left = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = pairs.join(left, "a").join(right, "b").where("ra <> rb")
        rest = staged(rest.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        release(pairs)
        if moved is not point:
            release(point)
        pairs, mapping = rest, moved
    return mapping if mapping is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
