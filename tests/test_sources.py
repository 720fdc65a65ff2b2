"""Readers and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from spotframe.expect import Violation
from spotframe.sources import binary, bundle, readers, sites


def put(path, text):
    (gzip.open if str(path).endswith(".gz") else open)(path, "wt").write(text)
    return str(path)


def test_matrix_market(spark, tmp_path):
    p = put(tmp_path / "m.mtx.gz", "%%MatrixMarket matrix coordinate integer general\n% note\n3 2 3\n1 1 4\n1 1 1\n3 2 7\n")
    assert sorted(tuple(r) for r in readers.read_matrix_market(spark, p, 3, 2).collect()) == [(1, 1, 5.0), (3, 2, 7.0)]
    with pytest.raises(Violation):
        readers.read_matrix_market(spark, p, 2, 2)
    mask = put(tmp_path / "k.mtx", "3 2 2\n1 1 1\n2 2 0\n")
    assert [tuple(r) for r in readers.read_value_mask(spark, mask).collect()] == [(1, 1)]


def test_lines_features_positions(spark, tmp_path):
    assert readers.read_lines(spark, put(tmp_path / "b.txt.gz", "A\nB\n")).count() == 2
    with pytest.raises(Violation):
        readers.read_lines(spark, put(tmp_path / "c.txt", "A\n\nB\n"))
    with pytest.raises(Violation):
        readers.read_features(spark, put(tmp_path / "f.tsv", "g1\tA\tx\ng1\tB\tx\n"))
    head = "barcode\tin_tissue\tarray_row\tarray_col\tpxl_row_in_fullres\tpxl_col_in_fullres\n"
    p = readers.read_positions(spark, put(tmp_path / "p.tsv", head + "b1\t1\t01\t2\t10\t20\nb2\t0\t1\t3\t10\t20\n"))
    assert p.first()["array_row"] == "01" and p.first()["array_row_n"] == 1
    with pytest.raises(Violation):
        readers.read_positions(spark, put(tmp_path / "q.tsv", head + "b1\t1\tx\t2\t10\t20\n"))


def test_coverage_gtf_bed(spark, tmp_path):
    c = readers.read_coverage(spark, put(tmp_path / "c.cov", "chr1\t5\t5\t50\t1\t1\ts\nchr1\t9\t9\t100\t2\t0\ts\n"))
    assert [r["pos"] for r in c.orderBy("pos").collect()] == [4, 8]
    assert readers.read_region(c, "chr1:1-6").first()["percent"] == 50.0
    with pytest.raises(Violation):
        readers.read_coverage(spark, put(tmp_path / "d.cov", "chr1\t5\t6\t50\t1\t1\ts\n"))
    g = readers.read_gtf(spark, put(tmp_path / "g.gtf", '#x\nchr1\ts\tgene\t11\t20\t.\t-\t.\tgene_id "G1"; gene_type "t";\nchr1\ts\texon\t11\t20\t.\t-\t.\tgene_id "G1";\n')).first()
    assert (g["lo"], g["hi"], g["gene_name"]) == (10, 20, "G1")
    b = readers.read_bed(spark, put(tmp_path / "b.bed", "chr1\t0\t10\tx\nchr1\t5\t9\n"))
    assert {r["region"] for r in b.collect()} == {"chr1:0-10", "chr1:5-9"}
    with pytest.raises(Violation):
        readers.parse_regions(spark.createDataFrame([("chr1:9-9",)], "id string"), "id").collect()


def test_json_and_tables(spark, tmp_path):
    p = put(tmp_path / "r.json", json.dumps({"duplication": {"rate": 0.25}, "flag": True}))
    assert readers.read_json_number(spark, p, "duplication.rate", 0, 1) == 0.25
    for field in ("flag", "none"):
        with pytest.raises(Violation):
            readers.read_json_number(spark, p, field, 0, 1)
    o = put(tmp_path / "o.json", json.dumps({"taps_to_beta": {"row_offset_fullres_pixels": 1, "col_offset_fullres_pixels": 2, "rotation_degrees": 3}}))
    assert tuple(readers.read_offsets(spark, o).first()) == ("taps_to_beta", 1.0, 2.0, 3.0)
    t = put(tmp_path / "t.csv", "﻿id,program_2,program_10,program_1\na,0.5,0.25,0.25\n")
    assert [r["name"] for r in readers.read_wide(spark, t, ["id"], "program_").collect()] == ["program_1", "program_2", "program_10"]
    with pytest.raises(Violation):
        readers.read_table(spark, t, {"missing": "string"}, ",")
    q = put(tmp_path / "q.tsv", "a\tb\n1_2\t03_4\n")
    assert tuple(readers.read_pairs(spark, q, "a", "b").first()) == ("01_02", "03_04")


def test_sites_by_region(spark, tmp_path):
    rows = spark.sql("SELECT concat('chr', id % 3) AS chrom, id * 7 % 3000 AS pos, id AS spot FROM range(3000)")
    sites.write_sites(rows, f"{tmp_path}/s", 200)
    every = [p.name for p in (tmp_path / "s" / "sites").iterdir() if p.name.endswith(".parquet")]
    for region, few in (("chr1:501-900", True), ("chr2:1-3000", False), ("chr1:9000-9001", True), ("none:1-5", True)):
        chrom, lo, hi = sites.parse_span(region)
        got, want = sites.read_sites(spark, f"{tmp_path}/s", region), rows.where(f"chrom = '{chrom}' AND pos >= {lo} AND pos < {hi}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        names = sites.files_of(spark, f"{tmp_path}/s", region)
        assert len(names) <= (2 if few else len(every) // 2) and (not names or {p.rsplit("/")[-1] for p in got.inputFiles()} == set(names))
    for region in ("chr1", "chr1:0-4", "chr1:5-4", "chr1:a-b"):
        with pytest.raises(Violation):
            sites.parse_span(region)
    with pytest.raises(Exception, match="lacks its place"):
        sites.write_sites(rows.withColumn("pos", F.expr("nullif(pos, 7)")), f"{tmp_path}/n")


def test_order_of_files(spark, tmp_path):
    def faults(name, places, split=None):
        text = "".join(f"{c}\t{p}\t{p}\t50\t1\t1\ts\n" for c, p in places)
        path = put(tmp_path / name, text)
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            found = sorted(tuple(r)[1:] for r in sites.order_faults(readers._csv(spark, path, readers.COVERAGE), pos="start").collect())
            if found:
                with pytest.raises(Violation):
                    readers.read_coverage(spark, path, ordered=True)
            else:
                assert readers.read_coverage(spark, path, ordered=True).count() == len(places)
            return found
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")

    fine = [(c, p) for c in ("chr2", "chr10", "chr1") for p in (1, 1, *range(2, 90))]
    for split in (None, 200):  # blocks of 200 bytes hold a dozen lines
        assert faults("fine", fine, split) == []
        assert faults("down", [*fine[:50], ("chr2", 3), *fine[50:]], split) == [("chr2", "unsorted")]
        assert [c for c, _ in faults("back", [*fine, ("chr2", 99)], split)]
        assert ("chr2", "apart") in faults("late", [*fine, *[("chr1", p) for p in range(90, 150)], *[("chr2", p) for p in range(200, 230)]], 200)
    assert faults("seam", [("c", p) for p in (*range(100, 125), *range(50, 90))], 200) == [("c", "unsorted")]
    assert faults("bare.cov.gz", fine) == []
    plan = sites.order_faults(readers._csv(spark, f"{tmp_path}/fine", readers.COVERAGE), pos="start")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInPandas")  # of the plan's lines, later ones come first: rows are mapped before anything is shuffled


def container(kind, payload, signature=266563789635, size=None):
    return gzip.compress(signature.to_bytes(8, "little") + kind.encode() + (len(payload) if size is None else size).to_bytes(8, "little") + payload)


def runs(width, *pairs):
    return bytes([width]) + b"".join(code.to_bytes(width, "little") + n.to_bytes(2, "little") for code, n in pairs)


def test_binary(spark, tmp_path):
    sites = b"chr1\0" + bytes([5, 0x81, 0x2C]) + b"\xff" + b"chr2\0" + (3 << 62 | 70_000).to_bytes(8, "big") + b"\x01"  # deltas 5, 300; 70000, 1
    (tmp_path / "m").write_bytes(container("2", b"quiet\0active\0unused\0\0" + runs(1, (0, 2), (1, 2))))
    (tmp_path / "s").write_bytes(container("7", sites))
    ref, mask = binary.read_site_reference(spark, str(tmp_path / "s")), binary.read_state_runs(spark, str(tmp_path / "m"))
    got = sorted(tuple(r) for r in binary.site_states(ref, mask, ["quiet"]).collect())
    assert got == [("chr1", 4, "quiet"), ("chr1", 304, "quiet"), ("chr2", 69_999, "active"), ("chr2", 70_000, "active")]
    labels = binary.read_state_labels(spark, str(tmp_path / "m"))
    assert binary.site_states(ref, mask, ["unused"], labels).count() == 4
    for states, rows in ((["other"], ref), ([], ref.limit(2))):
        with pytest.raises(Violation):
            binary.site_states(rows, mask, states, labels)


@pytest.mark.parametrize("width", [1, 2, 3, 8])
def test_binary_code_widths(width):
    labels, code, n = binary.decode_runs(binary.payload_of(container("2", b"a\0b\0\0" + runs(width, (1, 65_535), (0, 1))), "2"))
    assert (labels, code.tolist(), n.tolist()) == (["a", "b"], [1, 0], [65_535, 1])


@pytest.mark.parametrize("kind, data", [
    ("2", container("2", b"a\0\0" + runs(1, (0, 1)), signature=7)), ("7", container("2", b"a\0\0" + runs(1, (0, 1)))), ("2", gzip.compress(b"short")),
    ("2", container("2", b"a\0\0" + runs(1, (0, 1)), size=3)), ("2", container("2", b"a\0")), ("2", container("2", b"a\0\0")), ("2", container("2", b"a\0\0" + runs(4, (0, 1)))),
    ("2", container("2", b"a\0\0" + runs(1, (0, 1)) + b"x")), ("2", container("2", b"a\0\0" + runs(1, (1, 1)))), ("2", container("2", b"a\0\0" + runs(1, (0, 0)))), ("2", container("2", b"\xfe\0\0" + runs(1, (0, 1)))),
    ("7", container("7", b"chr1")), ("7", container("7", b"\0\x05")), ("7", container("7", b"c\0\x05\xffc\0\x05")), ("7", container("7", b"c\0\x00")), ("7", container("7", b"c\0\x81")), ("7", container("7", b"c\0\xc1\x00")),
    ("7", container("7", b"c\0" + (3 << 62 | 1 << 33).to_bytes(8, "big"))), ("7", container("7", b"\xfe\0\x05")),
])
def test_binary_errors(kind, data):
    with pytest.raises(Violation):
        payload = binary.payload_of(data, kind)
        binary.decode_runs(payload) if kind == "2" else list(binary.decode_positions(payload))


def test_bundle_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "g", 0, 0.5), (2, "h", 1, 1.0)], "spot int, gene string, bin int, rate double")
    bundle.write_bundle(spark, bundle.Bundle({"cells": rows}, {"name": "x"}), f"{tmp_path}/b")
    back = bundle.read_bundle(spark, f"{tmp_path}/b")
    assert back["cells"].count() == 2 and back.meta == {"name": "x"}
    with pytest.raises(FileExistsError):
        bundle.write_bundle(spark, bundle.Bundle({"cells": rows}), f"{tmp_path}/b")
    with pytest.raises(KeyError):
        bundle.read_bundle(spark, f"{tmp_path}/b", ["none"])
    with pytest.raises(Exception, match="zero"):  # nothing is left of a bundle that fails
        bundle.write_bundle(spark, bundle.Bundle({"fine": rows, "broken": rows.selectExpr("raise_error('zero')")}), f"{tmp_path}/x")
    assert not [x for x in tmp_path.iterdir() if "x" in x.name]
    factor = spark.createDataFrame([(1, [0.5, 2.0])], "id int, vec array<double>")
    bundle.write_factors(factor, factor, 2, f"{tmp_path}/f")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/f/loadings").collect()] == [("1", "0.5", "2.0")]
    bundle.write_gene_bins(rows, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g").count() == 2
    bundle.write_delimited(rows, f"{tmp_path}/t", compressed=True, digits=3)
    assert "1\tg\t0\t0.500" in [r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()]
    with pytest.raises(ValueError):
        bundle.write_statistics(spark, {"x": float("nan")}, f"{tmp_path}/j")
    made = []
    make = lambda: made.append(1) or rows
    assert [bundle.read_cached(spark, f"{tmp_path}/c", "rate", make).count() for _ in range(2)] == [2, 2] and len(made) == 1


def test_stream_equals_batch(spark, tmp_path):
    from spotframe.streaming.bins import windowed_rates

    rows = spark.sql("SELECT timestamp_seconds(1704067200 + id * 600) AS ts, concat('t', id % 2) AS event_type, CAST(id AS DOUBLE) AS value FROM range(40)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_rates(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.sql("SELECT * FROM rates")) == key(windowed_rates(spark.read.parquet(f"{tmp_path}/in")))
