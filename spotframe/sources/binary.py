"""Binary categorical masks and coordinate references, decoded in Arrow batches.

A container is gzip-compressed: a header of 17 bytes (signature and payload size in 8 bytes each, little-endian, with
the format as one ASCII character between them), then the payload, which must have exactly the stated size.

Format "2", a mask: zero-terminated labels, one more zero, the width of a code in bytes (1, 2, 3 or 8), then runs of a
code and a 2-byte length, little-endian. Format "7", a coordinate reference: for each chromosome a zero-terminated name
and increasing 1-based positions as deltas, ended by 0xFF or the end of the file. The leading bits of a delta say its
size: below 0x80 one byte, below 0xC0 two, else eight, big-endian. Positions come out 0-based.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.expect import Violation

# Fixed values of the format.
SIGNATURE = 266563789635
HEADER = struct.Struct("<QcQ")
WIDTHS = (1, 2, 3, 8)


def payload_of(data: bytes, kind: str) -> bytes:
    """The payload of a container of format ``kind``."""
    raw = gzip.decompress(data)
    if len(raw) < HEADER.size:
        raise Violation("the header is cut off")
    signature, found, size = HEADER.unpack_from(raw)
    if signature != SIGNATURE or found != kind.encode():
        raise Violation(f"signature {signature} and format {found!r} instead of {SIGNATURE} and {kind!r}")
    if len(raw) - HEADER.size != size:
        raise Violation(f"{len(raw) - HEADER.size} bytes of payload instead of {size}")
    return raw[HEADER.size :]


def decode_runs(payload: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, and code and length of each run."""
    head, mark, body = payload.partition(b"\0\0")
    if not mark or not body:
        raise Violation("labels without an end or without a run")
    try:
        labels = head.decode().split("\0")
    except UnicodeDecodeError as e:
        raise Violation("labels aren't UTF-8") from e
    width, runs = body[0], np.frombuffer(body, np.uint8, offset=1)
    if width not in WIDTHS or len(runs) % (width + 2):
        raise Violation(f"codes of {width} bytes, {len(runs)} bytes of runs")
    runs = runs.reshape(-1, width + 2).astype(np.uint64)
    code, n = ((part << (8 * np.arange(part.shape[1], dtype=np.uint64))).sum(1, dtype=np.uint64) for part in (runs[:, :width], runs[:, width:]))
    if (code >= len(labels)).any() or (code > 255).any() or (n == 0).any():
        raise Violation("a run without a label or of no length")
    return labels, code.astype(np.int64), n.astype(np.int64)


def decode_positions(payload: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(chromosome, 0-based positions)."""
    at, seen = 0, set()
    while at < len(payload):
        end = payload.find(b"\0", at)
        if end < 0:
            raise Violation("a chromosome name is cut off")
        try:
            name = payload[at:end].decode()
        except UnicodeDecodeError as e:
            raise Violation("a chromosome name isn't UTF-8") from e
        if not name or name in seen:
            raise Violation(f"chromosome {name!r} is empty or occurs twice")
        seen.add(name)
        at, deltas = end + 1, []
        while at < len(payload) and payload[at] != 0xFF:
            size, bits = (1, 7) if payload[at] < 0x80 else (2, 14) if payload[at] < 0xC0 else (8, 62)
            if at + size > len(payload):
                raise Violation("a position is cut off")
            deltas.append(int.from_bytes(payload[at : at + size], "big") & ((1 << bits) - 1))
            at += size
        at += 1
        pos = np.cumsum(np.array(deltas, object)) - 1 if deltas else np.zeros(0, object)
        if 0 in deltas or len(pos) and pos[-1] > 0xFFFFFFFF:
            raise Violation(f"positions of {name} don't increase or exceed 32 bits")
        yield name, pos.astype(np.int64)


def read_state_runs(spark: SparkSession, path: str) -> DataFrame:
    """(state, first, n): runs of the mask, whose rows count from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for data in t["content"]:
                labels, code, n = decode_runs(payload_of(data, "2"))
                yield pd.DataFrame({"state": np.array(labels, object)[code], "first": np.cumsum(n) - n, "n": n})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "state string, first long, n long")


def read_state_labels(spark: SparkSession, path: str) -> DataFrame:
    """(state): all labels of the mask, those without a run too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for data in t["content"]:
                yield pd.DataFrame({"state": decode_runs(payload_of(data, "2"))[0]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "state string")


def read_site_reference(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, row): the coordinates that the mask's rows stand for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for data in t["content"]:
                at = 0
                for chrom, pos in decode_positions(payload_of(data, "7")):
                    yield pd.DataFrame({"chrom": chrom, "pos": pos, "row": np.arange(at, at + len(pos))})
                    at += len(pos)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "chrom string, pos long, row long")


def site_states(reference: DataFrame, runs: DataFrame, required: list[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, state); both files must have as many rows, and the required states must be among the labels.

    Without ``labels`` the states of the runs count as such.
    """
    n, m = reference.count(), runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n != m:
        raise Violation(f"{n} coordinates but {m} states")
    known = (labels if labels is not None else runs).select("state").distinct()
    if missing := set(required) - {r[0] for r in known.collect()}:
        raise Violation(f"the mask lacks states: {sorted(missing)}")
    width = 1 << 16  # a run covers few buckets of this width, a row lies in one
    spread = runs.where("n > 0").withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width))))
    rows = reference.withColumn("b", F.floor(F.col("row") / width))
    return rows.join(spread, "b").where((F.col("row") >= F.col("first")) & (F.col("row") < F.col("first") + F.col("n"))).select("chrom", "pos", "state")
