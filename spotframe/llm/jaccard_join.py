"""N-gram Jaccard self-join over a token-group matrix.

Every document is the set of its distinct word shingles. Two documents link when
``100 * |intersection| >= threshold * |union|``; the result is exact (sets hold 64-bit hashes of shingles,
equal sets are recognised by a 128-bit digest).

1. Equal sets are one class, whose node is a number of its own.
2. *Groups.* Classes that share a min-hash compare with that key's most typical member; linked ones form a group of
   similar documents, those that come near without a link another one. Groups are cut into blocks of bounded size.
   Every other class is a group of its own.
3. *Token-group matrix.* Row (token, group) for the union of the members' prefix tokens, rarest first (the order
   comes from a histogram over all tokens). Prefixes are so long that linked sets share at least ``prefix_overlap``
   tokens there. Two groups meet only if their unions share as many, their sizes are compatible and they aren't known
   to be linked.
4. Where groups have met, a query document opens the other group if ``|query & union of the whole member sets|``
   reaches the least overlap that the threshold asks for; only then are members compared.

No step emits the pairs of a group of copies: links inside a group are already known from its centre.

Defined cases: null or blank text: no shingles, no link, its own component. Fewer than ``k`` words: one shingle, the
whole sequence. Rows that repeat a ``doc_id`` are one vertex of the components, but rows of their own where one of each
group is chosen. A row with a null ``doc_id`` has a null component and links nothing. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, release, staged
from .kernel import U, mix, pieces, shingle_sets, tidy, words_of

#: Cells of the token histogram: its size, and so what is broadcast, is the same for any input (2 MB).
CELLS = 1 << 18
#: Min-hash values of a document; the first KEYS of them are keys for finding a group.
SKETCH, KEYS = 16, 4
#: A pair goes to the centre test if so many of its SKETCH values agree. Other pairs meet in the matrix.
AGREE = 9
#: Members of a block.
BLOCK = 64
#: Cells of a block's member-token table up to which it is laid out in full.
CELLS_LAID_OUT = 20_000_000

_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, buf, offs in pieces(batch.column("text")):
        yield from zip(range(lo, hi), shingle_sets(words_of(buf, offs), k), strict=True)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_overlap(n: int, threshold: int) -> int:
    """Fewest tokens that a set of n tokens shares with any set it links with."""
    return (n * threshold + 99) // 100


def prefix_overlap(n):
    """Tokens that the prefixes of two linked sets share at least; n: the smaller set's size."""
    return n // 20 + 1


def text_key() -> Column:
    """128 bits of a text; a null text and an empty one differ."""
    return F.md5(F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("")).cast("binary"))


def token_histogram(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents hold a token of each cell, over all documents."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, tokens in _sets(batch, k):
                np.add.at(total, (tokens & U(CELLS - 1)).astype(np.int64), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    cells = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return out


def _signatures(docs: DataFrame, k: int, threshold: int, order) -> DataFrame:
    """(doc_id, text_key, n, digest, sketch, common, prefix, n_index): one row per document; text_key: 128 bits of the text."""
    longs = pa.list_(pa.int64())

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = order.value
        for batch in batches:
            n, digest, sketch, common, prefix, n_index = [], [], [], [], [], []
            for _, tokens in _sets(batch, k):
                size = len(tokens)
                n.append(size)
                if not size:
                    for x in (digest, sketch, common, prefix, n_index):
                        x.append(None)
                    continue
                seen_here = seen[(tokens & U(CELLS - 1)).astype(np.int64)]
                kept = min(size, size - least_overlap(size, threshold) + prefix_overlap(size))
                digest.append(_digest(tokens))
                sketch.append(np.array([((tokens ^ s) * s).min() for s in _SEEDS], U).view(np.int64))
                common.append(float(np.log2(seen_here + 1.0).mean()))
                prefix.append(tokens[np.lexsort((tokens, seen_here))[:kept]].view(np.int64))
                # an index entry is only for partners that are at least as large
                n_index.append(min(size, size - -(-2 * threshold * size // (100 + threshold)) + prefix_overlap(size)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(sketch, longs), pa.array(common, pa.float64()), pa.array(prefix, longs), pa.array(n_index, pa.int32())], ["doc_id", "text_key", "n", "digest", "sketch", "common", "prefix", "n_index"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(sign, "doc_id long, text_key string, n int, digest binary, sketch array<long>, common double, prefix array<long>, n_index int")


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(digest, tokens): the whole sets of the documents in ``ids`` (a staged table of doc_id)."""

    @tidy
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, x in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "tokens"])

    rows = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id")
    return rows.select("text").mapInArrow(take, "digest binary, tokens binary").dropDuplicates(["digest"])


def _links(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < threshold * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (low + high - both)


def _tokens(x: bytes) -> np.ndarray:
    return np.frombuffer(x, U)


def _centre_links(cls: DataFrame, docs: DataFrame, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(node, centre) of classes that link with the most typical class of one of their min-hash keys, and of all that come near one."""
    carried = ["node", "doc_id", "digest", "sketch", "n"]
    keyed = cls.select(*carried, "common", F.posexplode(F.slice("sketch", 1, KEYS)).alias("r", "v"))
    centre = keyed.groupBy("r", "v").agg(F.max(F.struct("common", F.negative(F.col("node")).alias("less"), *carried)).alias("c"), F.count("*").alias("m")).where("m > 1")
    # written, so that the join deals both sides out anew and a key of many members can be split
    centre = staged(centre.select("r", "v", *[F.col(f"c.{x}").alias(f"centre_{x}" if x != "node" else "centre") for x in carried]), "centres")
    agree = F.size(F.filter(F.zip_with("sketch", "centre_sketch", lambda x, y: x == y), lambda x: x))
    near = keyed.join(centre, ["r", "v"]).where((F.col("centre") != F.col("node")) & (agree >= AGREE))
    possible = 100 * F.least("n", "centre_n") >= threshold * F.greatest("n", "centre_n")
    pairs = staged(near.select("node", "digest", "doc_id", "centre", "centre_digest", "centre_doc_id", possible.alias("possible")).distinct(), "near")
    asked = pairs.where("possible")
    ids = staged(asked.select("doc_id").union(asked.select("centre_doc_id")).distinct(), "ids")
    sets = staged(_whole_sets(docs, ids, k), "sets")

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("tokens").to_pylist(), batch.column("centre_tokens").to_pylist()
            ok = pa.array([_links(_tokens(a), _tokens(b), threshold) for a, b in zip(x, y, strict=True)], pa.bool_())
            yield batch.select(["node", "centre"]).filter(ok)

    both = asked.join(sets, "digest").join(sets.select(F.col("digest").alias("centre_digest"), F.col("tokens").alias("centre_tokens")), "centre_digest")
    out = staged(both.select("node", "centre", "tokens", "centre_tokens").mapInArrow(verify, "node long, centre long"), "centre_links")
    for x in (ids, sets, centre):
        release(x)
    return out, pairs.select("node", "centre")


def _overlaps(queries: list[np.ndarray], own: list[np.ndarray], threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query that the union of ``own`` can't rule out: its place and its overlap with every member."""
    union = np.unique(np.concatenate(own))
    table = None
    if len(own) * len(union) <= CELLS_LAID_OUT:
        table = np.zeros((len(own), len(union)), np.uint8)
        for i, t in enumerate(own):
            table[i, np.searchsorted(union, t)] = 1
    for i, q in enumerate(queries):
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        at = at[union[at] == q]
        if len(at) >= least_overlap(len(q), threshold):
            yield i, table[:, at].sum(1, dtype=np.int64) if table is not None else np.array([len(np.intersect1d(q, t, assume_unique=True)) for t in own])


def _open_groups(met: DataFrame, members: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) between members of met groups. met: ga, gb (ga <= gb); members: node, doc_id, digest, group."""
    wanted = members.join(met.select(F.col("ga").alias("group")).union(met.select("gb")).distinct(), "group", "left_semi")
    ids = staged(wanted.select("doc_id").distinct(), "ids")
    sets = staged(_whole_sets(docs, ids, k), "sets")
    held = staged(wanted.join(sets, "digest").select("group", "node", "tokens"), "held")

    def opened(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            queries, own = [_tokens(t) for t in left["tokens"]], [_tokens(t) for t in right["own_tokens"]]
            names, sizes = right["own"].to_numpy(), np.array([len(t) for t in own])
            for i, both in _overlaps(queries, own, threshold):
                node = left["node"].iloc[i]
                hit = (100 * both >= threshold * (len(queries[i]) + sizes - both)) & (names != node)
                found += [(node, n) for n in names[hit]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    queries = met.join(held.withColumnRenamed("group", "ga"), "ga").select("ga", "gb", "node", "tokens")
    own = met.join(held.withColumnRenamed("group", "gb"), "gb").select(F.col("ga").alias("oa"), F.col("gb").alias("ob"), F.col("node").alias("own"), F.col("tokens").alias("own_tokens"))
    return staged(queries.groupBy("ga", "gb").cogroup(own.groupBy("oa", "ob")).applyInPandas(opened, "a long, b long").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")


def linked_classes(docs: DataFrame, k: int = 5, threshold: int = 80, merge_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows (doc_id, text_key, n, digest), and (digest, root) of each class: its component.

    With ``merge_ids`` the classes of one ``doc_id`` are linked. ``threshold`` in percent.
    """
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(token_histogram(docs, k))
    signed = staged(_signatures(docs, k, threshold, order).withColumn("row", F.monotonically_increasing_id()), "signed")
    rows = signed.where("digest is not null and doc_id is not null")
    # one row stands for a class, that of its least id; its number is the class's node
    nodes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "row")).alias("x"))
    nodes = staged(nodes.select("digest", "x.doc_id", F.col("x.row").alias("node")), "nodes")
    cls = signed.select(F.col("row").alias("node"), "n", "sketch", "common").join(nodes, "node")
    stars, near = _centre_links(cls, docs, k, threshold)
    star = components(stars, "node", "centre")
    near = near.groupBy("node").agg(F.min("centre").alias("near"))
    kind = F.when(F.col("root").isNotNull(), "linked").when(F.col("near").isNotNull(), "near").otherwise("alone")
    placed = nodes.select("node", "doc_id", "digest").join(star, "node", "left").join(near, "node", "left").select("node", "doc_id", "digest", kind.alias("kind"), F.coalesce("root", "near", "node").alias("key"))
    sizes = placed.groupBy("kind", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["kind", "key"]).withColumn("group", F.xxhash64("kind", "key", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    # groups of one star are linked already; any other group stands for itself
    placed = staged(placed.select("node", "doc_id", "digest", "group", F.when(F.col("kind") == "linked", F.col("key")).otherwise(F.col("group")).alias("star"), "kind"), "placed")
    tokens = signed.select(F.col("row").alias("node"), "n", "n_index", "prefix").join(placed.select("node", "star", "group"), "node").select("star", "group", "n", "n_index", F.posexplode("prefix").alias("pos", "token"))
    of_token = Window.partitionBy("token")
    shared = tokens.withColumns({"lo": F.min("star").over(of_token), "hi": F.max("star").over(of_token)}).where("lo <> hi")
    # rows of the matrix; sizes let two groups miss each other without being opened. Written, so that the join deals both
    # sides out anew and a token of many groups can be split
    indexed = F.when(F.col("pos") < F.col("n_index"), F.col("n"))
    sides = shared.groupBy("token", "group", "star").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min(indexed).alias("least_i"), F.max(indexed).alias("most_i"))
    sides = staged(sides, "matrix")
    q, g = sides.alias("q"), sides.where("least_i is not null").select("token", "group", "star", F.col("least_i").alias("least_n"), F.col("most_i").alias("most_n")).alias("g")
    meets = F.expr(f"q.token = g.token and q.star <> g.star and q.most_n >= g.least_n and 100 * g.most_n >= {threshold} * q.least_n")
    met = q.join(g, meets).groupBy(F.col("q.group").alias("x"), F.col("g.group").alias("y")).agg(F.count("*").alias("common"), F.min("g.least_n").alias("least_n"))
    met = met.where("common >= least_n div 20 + 1").select(F.least("x", "y").alias("ga"), F.greatest("x", "y").alias("gb"))
    within = placed.where("kind = 'near'").groupBy("group").count().where("count > 1").select(F.col("group").alias("ga"), F.col("group").alias("gb"))
    met = staged(met.union(within).distinct(), "met")
    links = _open_groups(met, placed.select("node", "doc_id", "digest", "group"), docs, k, threshold)
    edges = star.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
    if merge_ids:
        of_id = rows.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").groupBy("doc_id").agg(F.min("node").alias("one"), F.max("node").alias("other"))
        several = staged(of_id.where("one <> other").select("doc_id", "one"), "several")
        edges = edges.union(rows.select("doc_id", "digest").join(several, "doc_id").join(nodes.select("digest", "node"), "digest").select(F.col("node").alias("a"), F.col("one").alias("b")))
    root = components(edges)
    for x in (stars, sides, met):
        release(x)
    return signed.select("doc_id", "text_key", "n", "digest"), nodes.join(root, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text). ``threshold`` in percent."""
    signed, classes = linked_classes(docs, k, threshold)
    classes = staged(classes, "classes")
    named = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least")).join(classes, "digest")
    component = staged(named.groupBy("root").agg(F.min("least").alias("component")), "component")
    out = signed.join(classes.join(component, "root").select("digest", "component"), "digest", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row of ``docs`` of each group that links, directly or not: that of the least ``doc_id``, then of the least digest.

    Rows that share an id and have other texts are documents of their own; equal rows of one id leave one. Rows without
    a ``doc_id`` and rows without a word link with nothing.
    """
    signed, classes = linked_classes(docs, k, threshold, merge_ids=False)
    # repeated rows stay here: a distinct by digest would keep Spark from splitting a digest of many rows
    found = signed.where("doc_id is not null").join(staged(classes, "classes"), "digest", "left").select("doc_id", "text_key", "digest", "root")
    found = staged(found, "found")
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "digest", "text_key")).alias("x"))
    kept = first.select("x.doc_id", "x.text_key")
    gone = staged(found.where("root is not null").select("doc_id", "text_key").join(kept, ["doc_id", "text_key"], "left_anti"), "gone")
    again = signed.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    again = staged(again, "again")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    out = rows.join(broadcast_if_small(gone), ["doc_id", "text_key"], "left_anti")
    if again.isEmpty():
        return out.select("row.*")
    again = broadcast_if_small(again)
    single, twice = out.join(again, ["doc_id", "text_key"], "left_anti"), out.join(again, ["doc_id", "text_key"], "left_semi")
    return single.select("row.*").union(twice.dropDuplicates(["doc_id", "text_key"]).select("row.*"))
