"""Ball k-means, the filter audit and packaged archives against plain references, with their defined cases."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import math
import random
import re
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

CLASH = ["x", "cluster", "distance", "taken", "part", "mask", "n", "good", "digest", "owner", "uri", "order", "cells"]


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# --- ball k-means -----------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, size, scale):
    """[(vec_id, cluster, distance)], centroids; plain Python integers."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**53 else math.floor(x) * scale for x in v], v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    cents = [r[1] for r in start]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents)) for _, q, _ in kept]
        if turn < rounds:
            for j in range(len(cents)):
                mine = [q for (_, q, _), (_, c) in zip(kept, near) if c == j]
                if mine:
                    cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, c, d) for (i, _, _), (d, c) in zip(kept, near)], cents


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("kind", ["clustered", "spread", "huge"])
def test_balls_equal_plain_rounds(spark, kind):
    from spotframe.llm.ball_kmeans import ball_kmeans, cluster_table

    rng, size, k = np.random.default_rng(5), 4, 6
    centers = rng.normal(0, 4, (k, size))
    rows = [(i, (centers[i % k] + rng.normal(0, 0.1, size) if kind == "clustered" else rng.normal(0, 1, size)).tolist(), 0) for i in range(400)]
    if kind == "huge":
        rows += [(1000 + i, [1e30 * (i % 3), -1e25, 2.0**60, 0.5 * i], 0) for i in range(9)]
    rows += [(7, [1.0] * size, 0), (7, [1.0] * size, 0), (None, [0.0] * size, None), (500, None, 0), (501, [], 0), (502, [1.0] * 3, 0), (503, [1.0, None, 1.0, 1.0], 0), (504, [float("nan")] * size, 0), (505, [float("inf")] * size, 0)]
    rows += [(600 + i, [0.25, -0.25, 1 / 3, 0.0], 0) for i in range(20)]  # repeated rows
    df = with_clashes(spark.createDataFrame(rows, VECTORS).repartition(3))
    want, cents = lloyd([r[:2] for r in rows], k, 3, size, 64)
    out, centroids, taken = ball_kmeans(df, k, 3, size, 64)
    assert centroids == cents
    fits = lambda d: d if d < 2**63 else None
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, out.select("vec_id", "cluster", "distance").collect()), key=key) == sorted(((i, c, fits(d)) for i, c, d in want), key=key)
    assert taken[0] == k * len(want)
    if kind == "clustered":
        assert max(taken[2:]) < k * len(want) / 2  # stable cores and inner annuli spare the rest
    table = cluster_table(df, clusters=k, rounds=3, size=size, scale=64).collect()
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    for r in table:
        assert r["cluster_inertia"] == fits(sums[r["cluster"]]) and r["inertia"] == fits(sum(sums.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


def test_ball_neighbours_and_ties():
    from spotframe.llm.ball_kmeans import Balls, assign

    balls = Balls.within([[0], [10], [100]], {0: 25, 1: 24})
    assert balls.neighbours == [[(100, 1)], [], []]  # 10 apart: within twice the radius 5, not twice the root of 24
    x = np.array([[5], [4], [-5]])
    cluster, d, taken = assign(x, np.array([1, 0, 0]), Balls.within([[0], [10]], {0: 25, 1: 25}))
    assert cluster.tolist() == [0, 0, 0] and d.tolist() == [25, 16, 25]  # a tie goes to the smaller number
    assert taken == 5  # the vector at 4 lies in the core; the others are compared


def test_balls_of_few_or_no_vectors(spark):
    from spotframe.llm.ball_kmeans import cluster_table

    few = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)]
    got = sorted(map(tuple, cluster_table(spark.createDataFrame(few, VECTORS), size=2).select("vec_id", "cluster", "distance", "inertia").collect()))
    assert got == [(1, 0, 0, 0), (2, 0, 0, 0)]  # equal centroids: the second one is empty
    for rows in ([], [(1, None, 0)]):
        empty = cluster_table(spark.createDataFrame(rows, VECTORS))
        assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# --- filter audit -----------------------------------------------------------------------------------------------------


def audit(docs, labels):
    """{(part, order, step): counts}, each order applied document by document."""
    good, toxic = ({i for i, *x in labels if i is not None and x[at] == 1} for at in (0, 1))
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)]
        fails.append((lang or "", {f for f, b in zip("ABCDE", bad) if b}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                earlier = sum(f in x[0] for x in mine) - len(gone)
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), earlier, sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def test_audit_equals_plain_orders(spark):
    from spotframe.llm.filter_audit import filter_audit

    rng = random.Random(3)
    docs = []
    for i in range(150):
        w = [f"{rng.choice(['w', 'W', '', 'é'])}{rng.randrange(rng.choice([40, 4000]))}{rng.choice(['', '', '', '#'])}" for _ in range(rng.choice([5, 199, 200, 260]))]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(w) + rng.choice(["", " A|B"]), rng.choice(["en", "de", None])))
    docs += [(200 + i, docs[3][1], rng.choice(["en", "de"])) for i in range(30)]  # copies across parts
    docs += [(-1, None, None), (300, "", ""), (300, None, "fr"), (None, docs[3][1], "en"), (None, "only here", "en"), (None, "only here", "en"), (5, docs[3][1], "en"), (5, docs[3][1], "en")]
    docs += [(400, "Long " * 60_000, "es"), (401, "\x0b\x0c \r", "es")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 180, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (999, 1, 1)]
    got = filter_audit(with_clashes(spark.createDataFrame(docs, DOCS).repartition(4)), with_clashes(spark.createDataFrame(labels, LABELS)))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.select("part", "filter_order", "step", *counts).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in rows} == audit(docs, labels) and len(rows) == 600 * 5
    assert filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_orders_differ_by_one_swap_of_neighbours(n):
    from spotframe.llm.filter_audit import orders

    path = orders(n)
    order = list(next(path))
    seen = [tuple(order)]
    for i in path:
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(n)


# --- archives ---------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(11)
    out = [(i, f"https://x.example/{i}", f"<p>{rng.randrange(60)} äé😀</p>\r\n\r\n") for i in range(200)]
    return out + [(300, None, None), (301, "", ""), (302, "http://a b\n/é", "WARC/1.1\r\n\r\nPK\x05\x06"), (303, "u", "long " * 200_000), (None, "n", out[0][2]), (None, "n", "of no id"), (None, "n", "of no id"), (199, "again", out[199][2])]


def page_rows(rows, least):
    owner = {}
    for i, _, html in rows:
        if i is not None:
            owner[html or ""] = max(owner.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        to = owner.get(html or "") if len(payload) >= least else i
        revisit = to is not None and to != i
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 20])
def test_archives_round_trip(spark, tmp_path, least):
    from spotframe.llm.wacz import list_archives, page_table, read_archives, write_archives

    rows = pages()
    folder = str(tmp_path / "archives")
    archives = write_archives(with_clashes(spark.createDataFrame(rows, PAGES).repartition(3)), folder, least, archive_bytes=20_000, archive_records=40)
    assert archives.count() > 5 and archives.agg(F.sum("n_records")).first()[0] == len(rows)
    got = page_table(archives)
    assert sorted(str(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == page_rows(rows, least)
    listed = list_archives(spark, folder)
    assert sorted(r[0] for r in listed.collect()) == sorted(r[0] for r in archives.select("uri").collect())
    texts = read_archives(listed, range_bytes=500).where("record_type = 'response'").select("payload").collect()
    assert {bytes(r[0]).decode() for r in texts} == {r[2] or "" for r in rows}


def test_archives_of_no_page(spark, tmp_path):
    from spotframe.llm.wacz import page_table, write_archives

    assert page_table(write_archives(spark.createDataFrame([], PAGES), str(tmp_path))).count() == 0


def record(text, packed=True):
    from spotframe.llm.wacz import _record, sha1_name

    data = _record(1, "u", text.encode(), sha1_name(text.encode()), None, False)
    return data if packed else gzip.decompress(data)


def zip_of(parts, wide=False, comment=b"", before=b""):
    """A ZIP file made by hand from {name: bytes}; ``wide`` puts sizes and places into ZIP64 fields and records."""
    out, table = bytearray(before), bytearray()
    for name, data in parts.items():
        at, n = len(out), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        small = 0xFFFFFFFF if wide else len(data)
        out += b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, small, small, len(n), len(extra)) + n + extra + data
        more = struct.pack("<HHHHHQQQ", 9, 2, 0, 1, 24, len(data), len(data), at) if wide else b""  # another field comes first
        table += b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, small, small, len(n), len(more), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + n + more
    start = len(out)
    out += table
    if wide:
        end = len(out)
        out += b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(parts), len(parts), len(table), start)
        out += b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    count = 0xFFFF if wide else len(parts)
    out += b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, count, count, 0xFFFFFFFF if wide else len(table), 0xFFFFFFFF if wide else start, len(comment)) + comment
    return bytes(out)


def texts_of(path):
    from spotframe.llm.wacz import opened, ranges, records

    out = []
    for start, n in ranges(str(path)):
        system, where = opened(str(path))
        with system.open_input_file(where) as file:
            file.seek(start)
            out += [r.http()[1].decode() for r in records(file, n)]
    return out


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it and more than twenty-two bytes after"])
def test_directories(tmp_path, wide, comment):
    texts = ["one", "two" * 50_000, "", "PK\x05\x06"]
    data = [record(t) for t in texts]
    starts = np.cumsum([0, *map(len, data)])
    index = "".join(f"k {i} {json.dumps({'offset': str(starts[i]), 'length': len(data[i]), 'filename': 'a.warc.gz'})}\n" for i in (3, 0, 1))
    parts = {"archive/a.warc.gz": b"".join(data), "archive/b.warc": b"".join(record(t, packed=False) for t in texts), "indexes/i.cdxj": index.encode(), "other": b"x"}
    path = tmp_path / "x.wacz"
    path.write_bytes(zip_of(parts, wide, comment, before=b"\x00" * 100))
    assert sorted(texts_of(path)) == sorted(["one", "two" * 50_000, "PK\x05\x06", *texts])  # the third record isn't in the index; b has none
    if not wide and not comment:
        with zipfile.ZipFile(path) as z:
            assert z.namelist() == list(parts)


def test_members_equal_those_of_zipfile(tmp_path):
    from spotframe.llm.wacz import members

    path = tmp_path / "y.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ä/stored", b"abc")
        z.writestr("packed", b"abc" * 100, zipfile.ZIP_DEFLATED)
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"abcdef")
    raw = path.read_bytes()
    got = members(pa.BufferReader(raw), len(raw))
    assert [(m.name, m.method, m.size) for m in got] == [(x.filename, x.compress_type, x.compress_size) for x in zipfile.ZipFile(path).infolist()]
    assert [raw[m.start : m.start + m.size] for m in got if not m.method] == [b"abc", b"abcdef"]
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    assert members(pa.BufferReader(empty.getvalue()), 22) == []


def test_damage_raises(spark, tmp_path):
    from spotframe.llm.wacz import ranges

    good = {"archive/a.warc.gz": record("text"), "indexes/i.cdxj": b""}
    index = lambda **x: ("k 0 " + json.dumps({"offset": 0, "length": 10, "filename": "a.warc.gz"} | x)).encode()
    raw = zip_of(good)
    cases = {
        "no end": raw[:-10],
        "directory outside": raw[-60:],
        "member count": raw.replace(b"PK\x05\x06" + struct.pack("<HHHH", 0, 0, 2, 2), b"PK\x05\x06" + struct.pack("<HHHH", 0, 0, 3, 3)),
        "local header": raw.replace(b"PK\x03\x04", b"PK\x03\x05", 1),
        "index past the end": zip_of(good | {"indexes/i.cdxj": index(length=10**6)}),
        "index of another file": zip_of(good | {"indexes/i.cdxj": index(filename="b.warc.gz")}),
        "cut record": zip_of({"archive/a.warc.gz": record("text")[:-9]}),
        "no record": zip_of({"archive/a.warc": b"HTTP/1.1 200 OK\r\n\r\n"}),
    }
    for name, data in cases.items():
        path = tmp_path / f"{name}.wacz"
        path.write_bytes(data)
        with pytest.raises(ValueError):
            texts_of(path)
    packed = tmp_path / "packed.wacz"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", record("text" * 100))
    with pytest.raises(ValueError, match="compressed"):
        list(ranges(str(packed)))


def test_altered_payload_and_lost_response_raise(spark, tmp_path):
    from spotframe.llm.wacz import _record, page_table, sha1_name

    plain = gzip.decompress(record("text"))
    lone = _record(1, "u", b"abc", sha1_name(b"abc"), 2, True)
    for name, data, said in (("payload", gzip.compress(plain.replace(b"text\r\n", b"tEXt\r\n")), "another digest"), ("revisit", lone, "response of a revisit is missing")):
        path = tmp_path / f"{name}.wacz"
        path.write_bytes(zip_of({"archive/a.warc.gz": data}))
        with pytest.raises(Exception, match=said):
            page_table(spark.createDataFrame([(str(path),)], "uri string")).collect()
