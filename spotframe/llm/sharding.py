"""Sharding by extendible hashing, in DataFrame expressions only.

A directory is indexed by leading bits of a document's hash. A shard starts as the whole hash space; while its bytes
exceed the limit it splits on one more bit, so only oversized buckets split. Bytes are summed by hash prefix of BITS
bits at a time; all shorter prefixes follow from these sums, and only rows below prefixes that are still too large
take part in the next, finer histogram.

A shard whose rows share one hash can't split further: it becomes overflow pages within the limit. Rows find their
shard by an equi-join with the directory's entries.

Defined cases: a document larger than the limit has a shard or page of its own, and ``fits`` is false only there. Equal
rows may swap pages between runs, all other places are the same in each. A null text has no bytes; a null doc_id
hashes as the empty string. Rows that repeat a ``doc_id`` share a hash. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, running_start, shuffle_width, staged

#: Hash bits that each histogram resolves, and all bits used.
BITS, ALL_BITS = 15, 60
#: Production limit of a shard, in bytes of text.
SHARD_BYTES = 64 << 20
#: Entries of the directory up to which it may be broadcast.
ENTRIES = 20_000
#: Size classes of the rows of an overflowing shard.
CLASSES = 10


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a hash as text."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, over): the leaves, and whether one exceeds the limit. A staged ``sizes`` has h and n_bytes.

    A prefix is a leaf if its parent is none and it fits, or holds a single hash and so can't be split.
    """
    rows, parts, over = sizes.select("h", "n_bytes"), [], None
    of_prefix = [F.sum("n_bytes").alias("n_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    for used in range(BITS, ALL_BITS + 1, BITS):
        inside = rows if over is None else rows.join(broadcast_if_small(over), F.shiftright(rows["h"], ALL_BITS - used + BITS) == over["parent"], "left_semi")
        cells = inside.withColumns({"lo": F.col("h"), "hi": F.col("h")}).groupBy(F.shiftright("h", ALL_BITS - used).alias("cell")).agg(*of_prefix)
        depths = F.explode(F.sequence(F.lit(0 if over is None else used - BITS + 1), F.lit(used)))
        sums = cells.select("*", depths.alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {used} - depth)"))
        sums = staged(sums.groupBy("depth", "prefix").agg(*of_prefix), "prefixes")
        splits = (F.col("n_bytes") > limit) & (F.col("lo") < F.col("hi"))
        parents = sums.where(splits & (F.col("depth") < used)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        first = sums.where(F.col("depth") == 0) if over is None else sums.limit(0)
        if over is not None:
            parents = parents.union(over.select(F.lit(used - BITS + 1).alias("depth"), "parent"))
        children = sums.withColumn("parent", F.shiftright("prefix", 1)).where("depth > 0").join(parents, ["depth", "parent"], "left_semi")
        parts.append(children.select(*sums.columns).union(first).where(~splits).select("depth", "prefix", (F.col("n_bytes") > limit).alias("over")))
        over = staged(sums.where(splits & (F.col("depth") == used)).select(F.col("prefix").alias("parent")), "oversized")
        if over.isEmpty():
            break
    leaves = parts[0]
    for x in parts[1:]:
        leaves = leaves.union(x)
    return staged(leaves, "directory")


def lookup(leaves: DataFrame) -> tuple[int, DataFrame]:
    """(bits, (cell, leaves)): the directory by the first ``bits`` bits of a hash, each entry a list of the leaves there.

    There are at most as many entries as leaves. A leaf of fewer bits stands in all entries below it; one of more bits
    shares its entry with its neighbours.
    """
    n, deepest = leaves.agg(F.count("*"), F.max("depth")).first()
    bits = min(max(0, n.bit_length() - 1), deepest or 0)
    below = F.expr(f"sequence(shiftleft(prefix, {bits} - depth), shiftleft(prefix + 1, {bits} - depth) - 1)")
    cells = F.when(F.col("depth") <= bits, below).otherwise(F.array(F.expr(f"shiftright(prefix, depth - {bits})")))
    entries = leaves.select(F.explode(cells).alias("cell"), F.struct("depth", "prefix", "over").alias("leaf"))
    return bits, staged(entries.groupBy("cell").agg(F.collect_list("leaf").alias("leaves")), "lookup")


def paged(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (depth, prefix, n_bytes, t and more), all of shards of one hash, with their page.

    Rows of a size class (largest at most twice the smallest) fill pages of their own by their number, which keeps the
    limit; the smallest class, with at most limit / 2^CLASSES bytes a row, fills them by bytes. A row that exceeds the
    limit has a page to itself. The numbers come from sums over range partitions, so no shard is one task.
    """
    fill = F.floor(F.log2(F.lit(float(limit)) / F.greatest("n_bytes", F.lit(1)))).cast("int")
    kind = F.when(F.col("n_bytes") > limit, F.lit(-1)).otherwise(F.least(F.greatest(fill, F.lit(0)), F.lit(CLASSES)))
    order = ["depth", "prefix", "kind", "doc_id", "t", "n_bytes", "salt"]
    ranged = rows.withColumns({"kind": kind, "one": F.lit(1), "salt": F.monotonically_increasing_id()})
    ranged = staged(running_start(ranged, order, {"n_bytes": "bytes_before", "one": "rows_before"}), "ranged")
    first = ranged.groupBy("depth", "prefix", "kind").agg(F.min("bytes_before").alias("b0"), F.min("rows_before").alias("r0"))
    out = ranged.join(broadcast_if_small(staged(first, "first")), ["depth", "prefix", "kind"])
    at_row, at_byte = F.col("rows_before") - F.col("r0"), F.col("bytes_before") - F.col("b0")
    by_bytes = max(1, limit - limit // (1 << CLASSES))
    page = F.when(F.col("kind") < 0, at_row).when(F.col("kind") == CLASSES, F.floor(at_byte / by_bytes)).otherwise(F.floor(at_row / F.expr("shiftleft(1L, greatest(kind, 0))")))
    return out.withColumn("page", page.cast("long") * (CLASSES + 2) + F.col("kind") + 1).select(*rows.columns, "page")


def _placed(rows: DataFrame, leaves: DataFrame, limit: int) -> DataFrame:
    """``rows`` (doc_id, n_bytes, h, t and more) with depth, prefix and page."""
    bits, entries = lookup(leaves)
    mine = F.expr(f"filter(leaves, x -> shiftright(h, {ALL_BITS} - x.depth) = x.prefix)")
    found = rows.withColumn("cell", F.shiftright("h", ALL_BITS - bits)).join(broadcast_if_small(entries, ENTRIES), "cell").select(*rows.columns, F.inline(mine))
    out = found.withColumn("page", F.lit(0).cast("long"))
    if leaves.where("over").isEmpty():
        return out
    return out.where("not over").unionByName(paged(found.where("over"), limit))


def _sizes(docs: DataFrame) -> list[Column]:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return [F.col("doc_id"), n_bytes.alias("n_bytes"), id_hash(F.col("doc_id")).alias("h"), F.xxhash64("text").alias("t")]


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, shard, page, shard_docs, shard_bytes, fits), one row per row of ``docs`` (doc_id, text).

    ``shard`` is the hash prefix in bits ("" for the whole space); ``page`` tells overflow pages apart, 0 elsewhere.
    """
    sizes = staged(docs.select(*_sizes(docs)), "sizes")
    both = staged(_placed(sizes, directory(sizes, limit), limit).select("doc_id", "n_bytes", "depth", "prefix", "page"), "placed")
    totals = staged(both.groupBy("depth", "prefix", "page").agg(F.count("*").alias("shard_docs"), F.sum("n_bytes").alias("shard_bytes")), "totals")
    out = both.join(broadcast_if_small(totals, ENTRIES), ["depth", "prefix", "page"])
    return out.select("doc_id", "n_bytes", "depth", _bits(F.col("prefix"), F.col("depth")).alias("shard"), "page", "shard_docs", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, folder: str, limit: int = SHARD_BYTES) -> None:
    """Write the rows of ``docs`` to ``folder``, one directory ``_shard=<bits>/_page=<page>`` for each shard or page.

    The name of the whole space is "all". Any column of ``docs`` but these two is kept.
    """
    leaves = directory(staged(docs.select(*_sizes(docs)), "sizes"), limit)
    rows = _placed(docs.select(*_sizes(docs), F.struct("*").alias("row")), leaves, limit)
    name = F.when(F.col("depth") == 0, "all").otherwise(_bits(F.col("prefix"), F.col("depth")))
    spread = rows.repartitionByRange(shuffle_width(docs.sparkSession), "depth", "prefix", "page").select("row.*", name.alias("_shard"), F.col("page").alias("_page"))
    spread.write.partitionBy("_shard", "_page").parquet(folder)
