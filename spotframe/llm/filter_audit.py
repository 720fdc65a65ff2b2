"""Interaction audit of filters: what each filter removes at each place of every order.

Each document is tested once against all filters; its failures are the bits of a mask. Documents meet only as counts:
one cell for each part and mask, with its documents, its good and its toxic ones. The audit of a part is a walk over
all orders of the filters in which each order differs from the one before by one swap of neighbours. A swap leaves what
is kept before and after the two places, so only the count between them is taken anew from the cells, and only these
two steps change. What a filter removes is added to its Shapley sum whenever its step changes, for all orders that the
step has lasted.

A filter of the text alone is a Column that is true where a document fails. The duplicate filter fails a document
whose text a smaller doc_id has anywhere in the table. It needs no join: the cells of all rows less the cells of each
text's rows of smallest id are the cells of its failing rows. Texts are compared by their SHA-256.

Defined cases: a null text is empty; a null part is the empty string. Rows that repeat a doc_id are documents of their
own: none of them is smaller than another. A null doc_id is neither smaller nor larger than any, so it never fails as a
duplicate nor makes another one fail. A doc_id with several label rows is good or toxic if any of them says so; null
labels and labels of other ids say nothing. Extra columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, staged
from .kernel import tidy

#: What is counted of the documents of a cell.
COUNTS = ("n", "good", "toxic")
#: Parts of an output batch; each gives n! * n rows.
PARTS = 64


def text_filters() -> dict[str, Column]:
    """The four published conditions on ``text``, which isn't null; true where a document fails."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.char_length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def orders(n: int) -> Iterator[tuple[int, ...] | int]:
    """The first order of 0 to n-1, then the place i of each swap (i, i+1), until every order was there once.

    Each item moves through all places of the orders of the smaller items, in turn from the right and from the left.
    """
    yield tuple(range(n))

    def swaps(m: int) -> Iterator[int]:
        """Swaps over the orders of items 0 to m-1, the largest of which starts at the right."""
        if m < 2:
            return
        inner, left = swaps(m - 1), False
        while True:
            yield from range(m - 1) if left else range(m - 2, -1, -1)
            step = next(inner, None)
            if step is None:
                return
            left = not left
            yield step + 1 if left else step  # the largest item stands at the left or at the right of the smaller ones

    yield from swaps(n)


def walk(cells: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(order, kept, removed) of all orders of ``n`` filters; cells: parts x masks x counts.

    ``kept`` and ``removed`` (parts x places x counts) are changed in place as the walk goes on.
    """
    masks = np.arange(1 << n)

    def kept_by(filters: int) -> np.ndarray:
        return cells[:, (masks & filters) == 0].sum(1)

    path = orders(n)
    order = list(next(path))
    before = [sum(1 << f for f in order[:i]) for i in range(n + 1)]  # filters of the places before i
    sums = np.stack([kept_by(x) for x in before], 1)
    kept, removed = sums[:, 1:], sums[:, :-1] - sums[:, 1:]
    yield tuple(order), kept, removed
    for i in path:
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        sums[:, i + 1] = kept_by(before[i + 1])
        removed[:, i : i + 2] = sums[:, i : i + 2] - sums[:, i + 1 : i + 3]
        yield tuple(order), kept, removed


def audit_parts(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders, and for each part, order and place the counts of the audit (arrays parts x orders x places)."""
    parts, masks, total = len(cells), np.arange(1 << n), math.factorial(n)
    fails = np.stack([cells[:, (masks >> f & 1) == 1, 0].sum(1) for f in range(n)], 1)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(n)], 1)
    out = {c: np.zeros((parts, total, n), np.int64) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    seen: list[tuple[int, ...]] = []
    shapley, now, since = np.zeros((parts, n), np.int64), [None] * n, np.zeros(n, np.int64)
    for t, (order, kept, removed) in enumerate(walk(cells, n)):
        changed = range(n) if not seen else [i for i in range(n) if seen[-1][i] != order[i]]
        for i in changed:  # the filter's step before held for the orders since then
            f = order[i]
            if now[f] is not None:
                shapley[:, f] += now[f] * (t - since[f])
            now[f], since[f] = removed[:, i, 0].copy(), t
        seen.append(order)
        at = list(order)
        for c, x in (("kept", kept[:, :, 0]), ("removed", removed[:, :, 0]), ("redundant", fails[:, at] - removed[:, :, 0]), ("unique_fails", alone[:, at]), ("good_lost", removed[:, :, 1]), ("toxic_lost", removed[:, :, 2])):
            out[c][:, t] = x
    for f in range(n):
        shapley[:, f] += now[f] * (total - since[f])
    out["shapley"] = np.stack([shapley[:, list(order)] for order in seen], 1)
    return seen, out


def audit(cells: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``cells`` has (part, mask, n, good, toxic); bit i of a mask is a failure of the filter ``names[i]``. The rows are
    every part's orders and places; tasks work on whole parts, each an array of 2^n cells.
    """
    n = len(names)
    sums = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in COUNTS for m in range(1 << n)]
    wide = cells.groupBy("part").agg(*sums).select("part", F.array(*[f"{c}{m}" for m in range(1 << n) for c in COUNTS]).alias("cells"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                some = batch.slice(lo, PARTS)
                table = some.column("cells").flatten().to_numpy().reshape(some.num_rows, 1 << n, len(COUNTS))
                seen, out = audit_parts(table, n)
                each = len(seen) * n
                order = pa.array(["".join(names[f] for f in x) for x in seen for _ in range(n)])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), each))),
                        order.take(pa.array(np.tile(np.arange(each), some.num_rows))),
                        pa.array(np.tile(np.arange(n, dtype=np.int32) + 1, some.num_rows * len(seen))),
                        *[pa.array(out[c].ravel()) for c in counts],
                    ],
                    ["part", "filter_order", "step", *counts],
                )

    return wide.mapInArrow(run, ", ".join(["part string", "filter_order string", "step int", *[f"{c} long" for c in counts]]))


def cells_of(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(part, mask, n, good, toxic) of ``docs`` (doc_id, text, lang); the last bit is the duplicate filter.

    The texts are read once. Rows are counted by digest and id before any shuffle, and only these counts move.
    """
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    tested = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    tested = staged(tested.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")), "tested")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    of = [F.col("n"), (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")]
    counted = staged(tested.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "mask", *of), "counted")
    least = counted.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = counted.join(least, ["digest", "doc_id"], "left_semi").unionByName(counted.where("doc_id IS NULL"))
    bit = 1 << len(filters)
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    # a row of sign -1 takes a text's first rows out of the failing ones
    failing = counted.select("part", (F.col("mask") + bit).alias("mask"), *COUNTS).unionByName(first.select("part", (F.col("mask") + bit).alias("mask"), *[(-F.col(c)).alias(c) for c in COUNTS]))
    out = staged(failing.unionByName(first.select("part", "mask", *COUNTS)).groupBy("part", "mask").agg(*sums), "cells")
    release(tested, counted)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four text filters and the duplicate filter, named A to E, by language."""
    filters = text_filters()
    return audit(cells_of(docs, labels, filters), "".join(filters) + "E")
