"""Content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts each document's stream into chunks, so equal passages give equal chunks
wherever they stand. Unique chunks are stored once under their digest; a document is a recipe of digests, in ascending
``doc_id`` order; a tree of digests over chunks, documents and runs of documents verifies every reconstruction.

    chunks/    digest, n, payload     each unique chunk once; ids as little-endian 16- or 32-bit integers
    recipes/   rank, doc_id, start, n_tokens, digests, root
    manifest/  level, index, digest   Merkle nodes: FANOUT documents or nodes each; the last level is the root
    format/    id_bytes               width of an id in a payload

Defined cases: a null text is empty and stored as its end id alone. Rows that repeat a ``doc_id`` are documents of
their own, in any order among themselves; a null ``doc_id`` comes first. Extra columns are ignored. An empty table
gives an empty store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_start, staged
from .kernel import U, mix, tidy
from .tokens import crc_join, encoder, ids_crc

WINDOW, FANOUT = 16, 1024
#: Least, usual (a power of two) and most ids of a chunk.
LEAST, USUAL, MOST = 256, 1024, 8192


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where the chunks of one id stream end; depends on the ids alone."""
    h = mix(ids.astype(U) + U(1))
    step = 1
    while step < WINDOW:  # h[i] becomes the hash of ids i-2*step+1 to i
        h[step:] = h[step:] + (h[:-step] << U(step))
        step *= 2
    marks = np.flatnonzero((mix(h) & U(USUAL - 1)) == 0) + 1
    ends, at, n = [], 0, len(ids)
    while at < n:
        k = np.searchsorted(marks, at + LEAST)
        at = min(n, at + MOST, int(marks[k]) if k < len(marks) else n)
        ends.append(at)
    return ends


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _root(digests: list[bytes]) -> bytes:
    """Merkle root of a document's chunks."""
    level = digests
    while len(level) > 1:
        level = [_digest(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def _encoded(docs: DataFrame, path: str, cut: str, end_id: int) -> DataFrame:
    """One row per document; a payload is null where the same task has given that chunk before."""
    kinds = {"n_tokens": pa.int64(), "digests": pa.list_(pa.binary()), "root": pa.binary(), "chunks": pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())]))}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, given = encoder(path, cut), set()
        end = np.array([end_id], coder.dtype)
        for batch in batches:
            for lo, hi, all_ids, bounds in coder.encode_column(batch.column("text")):
                rows = []
                for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                    ids = np.concatenate([all_ids[start:stop], end])
                    digests, new, at = [], [], 0
                    for e in chunk_ends(ids):
                        payload = ids[at:e].tobytes()
                        digests.append(d := _digest(payload))
                        if d not in given:
                            given.add(d)
                            new.append({"digest": d, "n": e - at, "payload": payload})
                        at = e
                    rows.append((len(ids), digests, _root(digests), new))
                if len(given) > 200_000:
                    given.clear()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]], ["doc_id", *kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, digests array<binary>, root binary, chunks array<struct<digest: binary, n: int, payload: binary>>")


def _tree(leaves: DataFrame) -> DataFrame:
    """(level, index, digest) of all nodes above (index, digest) leaves, FANOUT children each."""
    nodes, level = [], leaves
    for depth in range(1, 8):
        level = level.groupBy(F.expr(f"index div {FANOUT}").alias("index")).agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("x"))
        level = level.select("index", F.sha2(F.array_join(F.transform("x", lambda y: F.hex(y["digest"])), "").cast("binary"), 256).cast("binary").alias("digest"))
        level = staged(level, "tree")
        nodes.append(level.select(F.lit(depth).alias("level"), "index", "digest"))
        if level.limit(2).count() < 2:
            break
    out = nodes[0]
    for x in nodes[1:]:
        out = out.union(x)
    return out


def _leaves(recipes: DataFrame) -> DataFrame:
    """(index, digest): a digest over all that a recipe states."""
    said = F.concat_ws(":", "rank", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.hex("root"))
    return recipes.select(F.col("rank").alias("index"), F.sha2(said.cast("binary"), 256).cast("binary").alias("digest"))


def write_store(docs: DataFrame, folder: str, tokenizer: str, cut: str = "blank", end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) with the vocabulary file ``tokenizer`` and write the store to ``folder``."""
    width = np.dtype(encoder(tokenizer, cut).dtype).itemsize
    docs.sparkSession.createDataFrame([(width,)], "id_bytes int").coalesce(1).write.parquet(f"{folder}/format")
    encoded = staged(_encoded(docs, tokenizer, cut, end_id), "encoded")
    chunks = encoded.select(F.explode("chunks").alias("c")).select("c.*").dropDuplicates(["digest"])
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    rows = encoded.select("doc_id", "n_tokens", "digests", "root", F.lit(1).alias("one"), F.monotonically_increasing_id().alias("salt"))
    ordered = running_start(rows, ["doc_id", "salt"], {"n_tokens": "start", "one": "rank"})
    recipes = ordered.select("rank", "doc_id", "start", "n_tokens", "digests", "root")
    recipes.repartitionByRange("rank").sortWithinPartitions("rank").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    kept = docs.sparkSession.read.parquet(f"{folder}/recipes")
    _tree(_leaves(kept)).write.parquet(f"{folder}/manifest")


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the manifest that differ from the recipes as they are now; no row: all agree."""
    kept = spark.read.parquet(f"{folder}/manifest")
    now = _tree(_leaves(spark.read.parquet(f"{folder}/recipes")))
    return kept.exceptAll(now).union(now.exceptAll(kept))


def check_manifest(spark: SparkSession, folder: str) -> None:
    """Raises ValueError unless the manifest agrees with the recipes; names the lowest node that differs."""
    if node := verify_manifest(spark, folder).orderBy("level", "index").first():
        raise ValueError(f"the manifest differs from the recipes at level {node['level']}, node {node['index']}")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored chunks and recipes.

    The manifest is checked against the recipes first. Each chunk's payload is read and checked against its digest and
    length once; a document's value follows from its chunks' values, and its Merkle root and length are checked against
    the recipe. A broken or missing chunk raises an error.
    """
    check_manifest(spark, folder)
    width = spark.read.parquet(f"{folder}/format").first()["id_bytes"]

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for digest, n, payload in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "payload")), strict=True):
                if payload is None or _digest(payload) != digest:
                    raise ValueError(f"chunk {digest.hex()} doesn't hold what its digest says")
                if n is None or len(payload) != n * width:
                    raise ValueError(f"chunk {digest.hex()} holds another number of ids than it says")
                crc.append(ids_crc(np.frombuffer(payload, f"<u{width}")))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    @tidy
    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, crcs = [], []
            for parts, root, said in zip(*(batch.column(c).to_pylist() for c in ("parts", "root", "n_tokens")), strict=True):
                if any(p["n"] is None for p in parts) or _root([p["digest"] for p in parts]) != root:
                    raise ValueError("a document's chunks don't make up its recipe")
                crc = 0
                for p in parts:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                if sum(p["n"] for p in parts) != said:
                    raise ValueError("a document's chunks hold another number of ids than its recipe says")
                n_tokens.append(said)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n_tokens, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "n", "payload").mapInArrow(check, "digest binary, n int, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes").select("rank", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("pos", "digest"))
    parts = recipes.join(chunks, "digest", "left").groupBy("rank").agg(*[F.first(c).alias(c) for c in ("doc_id", "start", "n_tokens", "root")], F.array_sort(F.collect_list(F.struct("pos", "digest", "n", "crc"))).alias("parts"))
    return parts.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(join_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(rank, doc_id, start, payload): every document's ids joined from its chunks, once the manifest is checked."""
    check_manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes").select("rank", "doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    parts = recipes.join(spark.read.parquet(f"{folder}/chunks"), "digest").groupBy("rank", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("x"))
    return parts.select("rank", "doc_id", "start", F.unhex(F.array_join(F.transform("x", lambda y: F.hex(y["payload"])), "")).alias("payload"))
