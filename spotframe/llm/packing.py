"""Vector best-fit packing of documents into token sequences.

Every document's ids (with an end id) become pieces of at most ``capacity`` tokens; only longer documents are cut, the
first piece takes the remainder. A sequence has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). A piece's demand on all three follows from its length, so pieces of one length are one class.
The plan is made on the class counts, a table of at most ``capacity`` rows whatever the corpus: an open sequence takes,
again and again, the class that leaves the least weighted norm of residual capacities among all classes that fit every
constraint; the finished pattern repeats while each of its classes lasts. Pieces then find their place in the plan by
their rank within their class, and carry their ids there.

With the default limits a sequence is full of tokens before it is full of documents or cost; lower limits bind.

Defined cases: a null text is empty and gives one piece, its end id. Rows that repeat a ``doc_id`` are documents of
their own. A piece that alone breaks a document or cost capacity raises ValueError. Extra columns are ignored. An
empty table gives no piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, shuffle_width, staged
from .kernel import tidy
from .tokens import encoder, ids_crc

#: Parts of even size that pieces are dealt into for ranking, a shuffle partition; what a piece weighs besides its tokens.
DEALS, PIECE_WEIGHT = 16, 32
_PIECE = ["doc_id", "piece", "start", "length", "ids"]


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weights of their residuals in the norm."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


def cut_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first."""
    first = n % most or most
    return [(0, min(n, first)), *[(s, most) for s in range(first, n, most)]]


def pieces_of(docs: DataFrame, tokenizer: str, cut: str, end_id: int, most: int) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids as little-endian 16- or 32-bit integers."""
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, cut)
        end = np.array([end_id], coder.dtype)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi, all_ids, bounds in coder.encode_column(batch.column("text")):
                rows = []
                for doc_id, a, b in zip(doc_ids[lo:hi], bounds[:-1], bounds[1:], strict=True):
                    ids = np.concatenate([all_ids[a:b], end])
                    rows += [(doc_id, k, s, n, ids[s : s + n].tobytes()) for k, (s, n) in enumerate(cut_pieces(len(ids), most))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], [*kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit_plan(counts: dict[int, int], limits: Limits) -> tuple[np.ndarray, int]:
    """Segments (length, first rank, end rank, first sequence, pieces a sequence, offset) and the number of sequences.

    Each segment places ranks of one length class into consecutive sequences of one pattern.
    """
    lengths = np.array(sorted(counts), np.int64)
    left = np.array([counts[x] for x in lengths], np.int64)
    caps = np.array([limits.tokens, limits.documents, limits.cost], np.float64)
    demand = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1) / caps
    weights = np.array(limits.weights)
    if (demand > 1).any():
        raise ValueError("a piece alone breaks a capacity")
    used = np.zeros_like(left)
    segments, sequence = [], 0
    while (left > 0).any():
        pattern, room, residual, at = {}, left.copy(), np.ones(3), 0
        while True:
            after = residual - demand
            fits = (room > 0) & (after >= -1e-12).all(1)
            if not fits.any():
                break
            norm = np.where(fits, (weights * after * after).sum(1), np.inf)
            best = int(norm.argmin())
            pattern[best] = pattern.get(best, 0) + 1
            room[best] -= 1
            residual = after[best]
        copies = min(int(left[i]) // m for i, m in pattern.items())
        for i, m in pattern.items():
            segments.append((int(lengths[i]), int(used[i]), int(used[i]) + copies * m, sequence, m, at))
            used[i] += copies * m
            left[i] -= copies * m
            at += m * int(lengths[i])
        sequence += copies
    return np.array(segments, np.int64).reshape(-1, 6), sequence


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), cut: str = "space", end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): one row per piece, with its ids and its place."""
    found = pieces_of(docs, tokenizer, cut, end_id, limits.tokens)
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limits.tokens rows
    segments, _ = best_fit_plan(counts, limits)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    plan = docs.sparkSession.sparkContext.broadcast(segments)
    # a class is dealt into parts of even size, at most limits.tokens + DEALS * shuffle_width parts in all
    weight = {n: c * (n + PIECE_WEIGHT) for n, c in counts.items()}
    share = max(1, sum(weight.values()) // (DEALS * shuffle_width(docs.sparkSession)))
    parts = [max(1, -(-weight.get(n, 0) // share)) for n in range(1, limits.tokens + 1)]
    dealt = F.pmod(F.xxhash64("row"), F.element_at(F.from_json(F.lit(json.dumps(parts)), "array<bigint>"), F.col("length").cast("int")))
    found = found.withColumn("dealt", dealt)
    sums = found.groupBy("length", "dealt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.select("length", "dealt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "dealt")
    inside = Window.partitionBy("length", "dealt").orderBy("doc_id", "piece", "row")
    ranked = found.withColumn("local", F.row_number().over(inside) - 1).join(broadcast_if_small(sums), ["length", "dealt"]).withColumn("rank", F.col("before") + F.col("local"))

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, each, offset = plan.value.T
        keys = length * (1 << 44) + first
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, n * (1 << 44) + rank, "right") - 1
            inner = rank - first[k]
            out = [pa.array(sequence[k] + inner // each[k]), pa.array(offset[k] + inner % each[k] * n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in _PIECE], *out], [*_PIECE, "sequence_id", "offset"])

    return ranked.select(*_PIECE, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, their pieces' ids joined in order of offset."""
    places = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most limits.tokens ids
    joined = F.unhex(F.array_join(F.transform(places, lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def piece_digests(packed: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``packed`` with ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit integers; ids stay if asked."""
    fields = [f for f in packed.schema if keep_ids or f.name != "ids"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [ids_crc(np.frombuffer(x, f"<u{len(x) // n}")) for x, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(crc, pa.int64())], [*[f.name for f in fields], "ids_crc32"])

    return packed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids_crc32 long")
