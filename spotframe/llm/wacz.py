"""WARC records in ZIP-packaged archives: a writer, and a reader that takes byte ranges without extracting anything.

An archive is a ZIP file whose members are stored, not compressed: a WARC file of records that are gzip members of
their own, and a sorted index with each record's offset and length.

    archive/data.warc.gz   the records
    indexes/index.cdxj     a line for each record: key, timestamp, {url, offset, length, filename, digest}
    datapackage.json       what the archive holds

The reader takes the end of the file, follows the ZIP64 locator where there is one, parses the central directory, and
finds from each member's local header where its bytes begin. Index members say where records lie; neighbouring records
make one range of bounded bytes, and ranges are what Spark deals out: a task seeks to a range and reads its records.
A WARC member that no index covers is one range, scanned a record at a time. Members that are compressed can't be read by range and
raise an error, as do damaged directories and records.

Equal payloads of at least ``min_bytes`` bytes are stored once: the record of largest ``page_id`` is the response, the
others are revisits that name it and have no payload. The reader finds each revisit's response and takes the size of
the payload from there.

Defined cases: a null html is the empty payload. Rows that tie at the largest page_id of a payload are all responses. A
null page_id is smaller than any; where a payload has no other id, all its records are responses. A null or empty url
is named after the page, and blanks and control characters in urls are percent-encoded. Extra columns are ignored. An
empty table gives no archive and no record.

Files are opened by ``pyarrow.fs`` on executors, so archives may lie wherever that reaches (a shared folder, HDFS, S3).
A task writes archives under names of its own, and only those that Spark's written list names are read: what a lost
task left counts for nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, shuffle_width, staged
from .kernel import tidy

#: An archive ends after the record that takes it to this many bytes, or to this many records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 100_000
#: Bytes of neighbouring records that are read at once.
RANGE_BYTES = 4 << 20
#: Bytes that a scan reads at once, and payload bytes of an output batch.
CHUNK, BATCH_BYTES = 64 << 10, 16 << 20
#: Fixed values of the formats: ZIP signatures and field layouts, the revisit profile.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path there."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI of the file system that Spark takes it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "file:///", uri)


def sha1_name(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Member:
    """A file within an archive: where its bytes begin and how many there are."""

    name: str
    method: int
    start: int
    size: int


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """``values`` (size, compressed size, offset) with those that are all ones taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field, out = extra[at + 4 : at + 4 + n], []
            for v in values:
                if v == _FULL32:
                    _need(len(field) >= 8, "a ZIP64 field is too short")
                    v, field = struct.unpack("<Q", field[:8])[0], field[8:]
                out.append(v)
            return out
        at += 4 + n
    _need(_FULL32 not in values, "a ZIP64 field is missing")
    return values


def members(file: pa.NativeFile, size: int) -> list[Member]:
    """The members that an archive's central directory lists; reads the end, the directory and the local headers."""
    tail_at = max(0, size - 22 - _FULL16 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature may stand in the comment
    _need(at >= 0, "no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        _need(end64 + 56 <= size, "the ZIP64 end record lies outside the file")
        file.seek(end64)
        record = file.read(56)
        _need(record[:4] == END64, "no ZIP64 end record where the locator says")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    _need(start + length <= size, "the central directory lies outside the file")
    file.seek(start)
    table, at, out = file.read(length), 0, []
    while at < len(table):
        _need(table[at : at + 4] == CENTRAL and at + 46 <= len(table), "a damaged central directory")
        flags, method = struct.unpack_from("<HH", table, at + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", table, at + 20)
        (local,) = struct.unpack_from("<I", table, at + 42)
        name = table[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, local = _wide(table[at + 46 + n_name : at + 46 + n_name + n_extra], [full, packed, local])
        at += 46 + n_name + n_extra + n_note
        file.seek(local)
        head = file.read(30)
        _need(len(head) == 30 and head[:4] == LOCAL, f"no local header of {name}")
        data = local + 30 + sum(struct.unpack_from("<HH", head, 26))
        _need(data + packed <= size, f"{name} lies outside the file")
        _need(bool(method) or packed == full, f"{name} is stored with two sizes")
        out.append(Member(name, method, data, packed))
    _need(len(out) == count, "the central directory holds another number of members than its end says")
    return out


def _stored(m: Member) -> Member:
    _need(m.method == 0, f"{m.name} is compressed, so it has no byte ranges")
    return m


def ranges(uri: str, most: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, bytes) of an archive's records, neighbours together up to ``most`` bytes."""
    system, path = opened(uri)
    size = system.get_file_info(path).size
    with system.open_input_file(path) as file:
        found = members(file, size)
        warcs = {m.name.rpartition("/")[2]: _stored(m) for m in found if re.search(r"\.warc(\.gz)?$", m.name)}
        places: dict[str, list[tuple[int, int]]] = {}
        for m in found:
            if re.search(r"\.cdxj$", m.name):
                file.seek(_stored(m).start)
                for line in file.read(m.size).decode().splitlines():
                    said = json.loads(line.split(" ", 2)[2])
                    places.setdefault(said["filename"], []).append((int(said["offset"]), int(said["length"])))
    for name in places:
        _need(name in warcs, f"the index names {name}, which isn't there")
    for name, m in warcs.items():
        if name not in places:
            if m.size:
                yield m.start, m.size
            continue
        lo = hi = 0
        for offset, length in sorted(set(places[name])):
            _need(offset + length <= m.size, "an index line lies outside its member")
            if hi > lo and (offset != hi or hi - lo + length > most):
                yield m.start + lo, hi - lo
                lo = offset
            elif hi == lo:
                lo = offset
            hi = offset + length
        if hi > lo:
            yield m.start + lo, hi - lo


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and payload of an HTTP response."""
        head, found, payload = self.block.partition(b"\r\n\r\n")
        _need(bool(found), "an HTTP response without an end of its headers")
        return _fields(head), payload


def _fields(head: bytes) -> dict[str, str]:
    """Names in lower case and values of the lines after the first."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def records(file: pa.NativeFile, n: int) -> Iterator[Record]:
    """The WARC records of the next ``n`` bytes of ``file``, plain or each in a gzip member; holds one record at a time."""
    left, data = n, b""

    def more(least: int = 1) -> None:
        nonlocal left, data
        chunk = file.read(min(max(least, CHUNK), left))
        _need(len(chunk) >= min(least, left) and bool(chunk), "a record is cut short")
        left, data = left - len(chunk), data + chunk

    while data or left:
        if len(data) < 2 and left:
            more()
        if data[:2] == b"\x1f\x8b":
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                if not data:
                    more()
                parts.append(unpack.decompress(data))
                data = unpack.unused_data
            yield from _plain(b"".join(parts))
        else:
            while (end := _record_end(data)) is None:
                more()
            if end > len(data):
                more(end - len(data))
            yield from _plain(data[:end])
            data = data[end:]


def _record_end(data: bytes) -> int | None:
    """Where a plain record that ``data`` starts with ends; None before its headers are whole."""
    end = data.find(b"\r\n\r\n")
    return None if end < 0 else end + 8 + int(_fields(data[:end]).get("content-length", 0))


def _plain(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        _need(end >= 0 and data.startswith(b"WARC/", at), "no WARC record where one is due")
        headers = _fields(data[at:end])
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        _need(len(block) == length and data[end + 4 + length : end + 8 + length] == b"\r\n\r\n", "a record of another length than it says")
        yield Record(headers, block)
        at = end + 8 + length


def _record(page: int | None, url: str, payload: bytes, digest: str, owner: int | None, revisit: bool) -> bytes:
    """A record as a gzip member of its own."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_name(block)}", *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(owner)}"] if revisit else []), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class _Archive:
    """An archive in the making, written front to back."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = opened(self.uri)
        system.create_dir(path.rpartition("/")[0])
        self.sink = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.warc = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.bytes, self.lines = 0, []

    def add(self, url: str, digest: str, data: bytes) -> None:
        said = {"url": url, "mime": "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(self.bytes), "filename": "data.warc.gz"}
        self.lines.append(f"{url.split('://', 1)[-1].lower()} {re.sub('[^0-9]', '', DATE)} {json.dumps(said)}")
        self.warc.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int]:
        self.warc.close()
        self.zip.writestr("indexes/index.cdxj", "".join(f"{x}\n" for x in sorted(self.lines)))
        package = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": "archive/data.warc.gz", "bytes": self.bytes}]}
        self.zip.writestr("datapackage.json", json.dumps(package))
        self.zip.close()
        self.sink.close()
        return self.uri, len(self.lines)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """(uri, n_records): the archives of ``pages`` (page_id, url, html), written to ``folder``, a URI on a shared store.

    Digests are taken first and only they and ids are grouped; pages then meet the digests that occur more than once.
    """
    folder, html = qualified(pages.sparkSession, folder), F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("owner"))
    same = staged(same.where("n > 1").select("digest", "owner"), "same")
    joined = rows.join(broadcast_if_small(same), "digest", "left").select("page_id", "url", "html", "owner")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, text, owner = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "owner"))
                archive = archive or _Archive(folder)
                url = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or f"urn:page:{'' if page is None else page}"
                payload = text.encode()
                digest = sha1_name(payload)
                archive.add(url, digest, _record(page, url, payload, digest, owner, owner is not None and owner != page))
                if archive.bytes >= archive_bytes or len(archive.lines) >= archive_records:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["uri", "n_records"])

    return staged(joined.mapInArrow(run, "uri string, n_records long"), "archives")


KINDS = {"uri": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """(uri, record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest) of all responses and
    revisits in ``archives`` (uri). Lengths and digests are checked; a revisit's payload is null and its size what its
    HTTP header says. Without ``payloads`` all payloads are null once they are checked."""

    @tidy
    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                found = list(ranges(uri, range_bytes))
                starts, sizes = list(zip(*found, strict=True)) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["uri", "start", "n"])

    def filled(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in KINDS.items()], list(KINDS))

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, n in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "n")), strict=True):
                system, path = opened(uri)
                with system.open_input_file(path) as file:
                    file.seek(start)
                    rows, held = [], 0
                    for record in records(file, n):
                        if row := _row(uri, record, payloads):
                            rows.append(row)
                            held += len(row["payload"] or b"")
                        if held > BATCH_BYTES or len(rows) >= 10_000:
                            yield filled(rows)
                            rows, held = [], 0
                    yield filled(rows)

    found = staged(archives.select("uri").mapInArrow(located, "uri string, start long, n long"), "ranges")
    spread = found.repartition(shuffle_width(archives.sparkSession), "uri", "start")
    return spread.mapInArrow(read, "uri string, record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def _row(uri: str, r: Record, payloads: bool) -> dict | None:
    """A response or revisit as a row; None for records of other types."""
    h = r.headers
    kind = h.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    _need(h.get("warc-block-digest", said := f"sha1:{sha1_name(r.block)}") == said, f"the block of {h.get('warc-record-id')} has another digest than it says")
    http, payload = r.http()
    size, digest = int(http.get("content-length", len(payload))), h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        _need(size == len(payload) and digest in ("", own := sha1_name(payload)), f"the payload of {h.get('warc-record-id')} isn't what its headers say")
        digest = own
    return {"uri": uri, "record_id": h.get("warc-record-id"), "record_type": kind, "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload": payload if payloads and kind == "response" else None, "payload_bytes": size, "payload_digest": digest}


def page_table(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record of ``archives`` (uri).

    Sizes of revisits come from the response that they name; a revisit without one raises an error.
    """
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1), '') AS BIGINT)")
    rows = read_archives(archives, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
    rows = staged(rows, "records")
    responses = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("full"))
    revisits = rows.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("the response of a revisit is missing: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    full = F.when((F.col("full") == F.col("payload_bytes")), F.col("full")).otherwise(lost)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").select(*columns).unionByName(revisits.withColumn("payload_bytes", full).select(*columns))


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(uri) of the .wacz files of a folder, by Spark's file source; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"))
