"""Readers that check what their tables mean, checked keys and graphs with hubs."""

import pytest
from pyspark.sql import functions as F

from spotframe.expect import Violation, expect_fractions
from spotframe.functions.columns import single_spaced
from spotframe.operators import cohorts, graph, intervals, linalg, tables
from spotframe.sources import bundle, checked


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_rates_and_threshold(spark, tmp_path):
    p = put(tmp_path / "a.tsv", "x_CG\tx_CA\tnote\n1.5\t0\tz\n")
    assert checked.read_rates(spark, p, {"CG": "x_CG", "CA": "x_CA"}) == {"CG": 1.5, "CA": 0.0}
    for i, text in enumerate(("x_CG\n1\n2\n", "x_CG\n", "x_CG\n101\n", "x_CG\nNaN\n", "x_CG\nq\n", "x_CA\n1\n")):
        with pytest.raises(Violation):
            checked.read_rates(spark, put(tmp_path / f"r{i}.tsv", text), {"CG": "x_CG"})
    assert checked.read_threshold(spark, put(tmp_path / "t.tsv", "reads_threshold\n250\n-1\n")) == 250.0
    for i, text in enumerate(("reads_threshold\n", "reads_threshold\n0\n", "reads_threshold\nInfinity\n", "reads_threshold\nx\n", "other\n1\n")):
        with pytest.raises(Violation):
            checked.read_threshold(spark, put(tmp_path / f"t{i}.tsv", text))


def test_depths_and_correspondence(spark, tmp_path):
    head = "spot\treads\tdepth\tsite_count\n"
    assert checked.read_depths(spark, put(tmp_path / "d.tsv", head + "a\t5\t1\t2\na\t5\t2\t1\nb\t0\t1\t1\n")).count() == 3
    for i, rows in enumerate(("", "a\t5\t1\t2\na\t6\t2\t1\n", "a\t5\t0\t2\n", "a\t5\t1\t0\n", "a\t-1\t1\t1\n", "a\tx\t1\t1\n")):
        with pytest.raises(Violation):
            checked.read_depths(spark, put(tmp_path / f"d{i}.tsv", head + rows))
    columns = ["beta", "taps", "mrna"]
    head = "beta\ttaps\tmrna\n"
    assert checked.read_correspondence(spark, put(tmp_path / "c.tsv", head + "1\t2\t3\n2\t1\t1\n"), columns).count() == 2
    for i, rows in enumerate(("", "1\t2\t3\n1\t3\t4\n", "1\t \t3\n", "1\t\t3\n")):
        with pytest.raises(Violation):
            checked.read_correspondence(spark, put(tmp_path / f"c{i}.tsv", head + rows), columns)


def test_pair_database_labels_and_weights(spark, tmp_path):
    head = "\ufefflr_pair,ligand_gene_symbols,receptor_gene_symbols,ligand_ensembl_ids,receptor_ensembl_ids\n"
    got = checked.read_pair_database(spark, put(tmp_path / "p.csv", head + "A B,A,B,e1,e2\nA;C B,A;C,B,e1;e3,\n")).collect()
    assert [(r["pair"], r["complex"], r["receptor_ids"]) for r in sorted(got)] == [("A B", False, "e2"), ("A;C B", True, None)]
    for i, rows in enumerate(("", "A_B,A,B,e1,e2\n", ",A,B,e1,e2\n", "A ,A,,e1,e2\n")):
        with pytest.raises(Violation):
            checked.read_pair_database(spark, put(tmp_path / f"p{i}.csv", head + rows))
    seen = spark.createDataFrame([(0,), (1,), (1,)], "cluster int")
    assert {tuple(r) for r in checked.read_labels(spark, put(tmp_path / "l.csv", "cluster,annotation\n0, T cell \n 1,B\n"), seen).collect()} == {("0", "T cell"), ("1", "B")}
    for i, rows in enumerate(("0,a\n", "0,a\n1,b\n2,c\n", "0,a\n1, \n", "0,a\n1,b\n1,c\n")):
        with pytest.raises(Violation):
            checked.read_labels(spark, put(tmp_path / f"l{i}.csv", "cluster,annotation\n" + rows), seen)
    meta = put(tmp_path / "m.csv", "barcode,x\na,1\nb,2\n")
    got = checked.read_weights(spark, meta, put(tmp_path / "w.csv", "barcode,t\nb,0.5\na,\n"), ["t"], more={"x": "int"})
    assert {tuple(r) for r in got.collect()} == {("a", 1, None), ("b", 2, 0.5)}
    for i, rows in enumerate(("a,1\n", "a,1\nb,1\nc,1\n", "a,1\nb,1\nb,1\n")):
        with pytest.raises(Violation):
            checked.read_weights(spark, meta, put(tmp_path / f"w{i}.csv", "barcode,t\n" + rows), ["t"])


def test_markers_and_samples(spark, tmp_path):
    head = "cluster\tmodality\tmarker_type\trank\tfeature_id\tfeature_name\tdirection\n"
    p = put(tmp_path / "k.tsv", head + "0\tm\tgene\t1\tg1\tG\tup\n1\tm\tgene\t1\tg2\tH\tup\n")
    assert checked.read_markers(spark, p).count() == 2 and checked.read_markers(spark, p, "1").first()["feature_id"] == "g2"
    with pytest.raises(Violation):
        checked.read_markers(spark, p, "7")
    with pytest.raises(Violation):
        checked.read_markers(spark, put(tmp_path / "k2.tsv", head + "0\tm\tgene\t1\tg1\tG\tup\n" * 2))
    for s in ("s1", "s2", "more/s1"):
        put(tmp_path / s / "qc" / "t.tsv", "reads_threshold\n1\n")
    found = checked.discover_samples(spark, [f"{tmp_path}/s1", f"{tmp_path}/s2/"], {"threshold": "qc/t.tsv"})
    assert [s["sample"] for s in found] == ["s1", "s2"] and all(checked.read_threshold(spark, s["threshold"]) == 1.0 for s in found)
    with pytest.raises(FileNotFoundError):
        checked.discover_samples(spark, [f"{tmp_path}/s1"], {"threshold": "qc/u.tsv"})
    with pytest.raises(Violation):
        checked.discover_samples(spark, [f"{tmp_path}/s1", f"{tmp_path}/more/s1"], {"threshold": "qc/t.tsv"})


def test_fractions_and_blanks(spark):
    frame = lambda rows: spark.createDataFrame(rows, "i int, j int, value double")
    mask = frame([(1, 1, 1.0), (2, 1, 0.0)])
    assert expect_fractions(frame([(1, 1, 0.25)]), mask, 2, 1).count() == 1
    for cells, m in (([(1, 1, 1.5)], mask), ([(1, 1, float("nan"))], mask), ([(1, 2, 0.5)], mask), ([(1, 1, 0.5)] * 2, mask), ([(1, 1, 0.5)], frame([(1, 1, 0.5)]))):
        with pytest.raises(Violation):
            expect_fractions(frame(cells), m, 2, 1)
    rows = spark.createDataFrame([("  A\t B\n\u00a0C ",), ("",), (None,)], "x string").select(single_spaced(F.col("x")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["A B C", "", None]


def test_keys_of_spots_and_of_several_columns(spark):
    spots = spark.createDataFrame([("01_02", 1, 2), ("03_04", 3, 4)], "barcode string, array_row int, array_col int")
    other = spark.createDataFrame([("AACC-1", 1.0, 2.0), ("AAGG-1", 3.0, 4.0)], "barcode string, array_row double, array_col double")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = lambda s, k: sorted(r["key"] for r in cohorts.spot_keys(s, k).collect())
    assert got(spots, keys("0102", "0304")) == ["0102", "0304"] == got(other, keys("0102"))
    assert got(other, keys("AACC-1")) == ["AACC-1", "AAGG-1"] == got(other, keys().where("false"))
    for bad in (other.withColumn("array_row", F.lit(100)), other.withColumn("array_row", F.lit(1.5)), other.withColumn("array_row", F.lit(1)).withColumn("array_col", F.lit(1)), other.drop("array_row")):
        with pytest.raises(Violation):
            cohorts.spot_keys(bad, keys("0102"))
    with pytest.raises(Violation):
        cohorts.spot_keys(spark.createDataFrame([("01_02",), ("0102",)], "barcode string"), keys("x"))
    table = spark.createDataFrame([(1, 2, "a"), (1, 3, "b")], "r int, c int, s string")
    assert cohorts.lookup(spark.createDataFrame([(1, 3)], "r int, c int"), table, ["r", "c"]).first()["s"] == "b"
    for rows in ([(1, 4)], [(1, None)]):
        with pytest.raises(Violation):
            cohorts.lookup(spark.createDataFrame(rows, "r int, c int"), table, ["r", "c"])


def test_shared_rows_and_region_means(spark):
    schema = "sample string, pair string, ids string"
    rows = [("s", "p", "1"), ("t", "p", "1"), ("t", "p", "1"), ("s", "q", "1"), ("t", "r", "5"), ("t", "r", "6")]
    assert [tuple(r) for r in tables.shared_rows(spark.createDataFrame(rows, schema), "pair", "sample", ["ids"]).collect()] == [("p", "1")]
    for ids in ("2", None):
        with pytest.raises(Violation):
            tables.shared_rows(spark.createDataFrame([("s", "p", "1"), ("t", "p", ids)], schema), "pair", "sample", ["ids"])
    spots = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "spot int, region string")
    rates = lambda rows: spark.createDataFrame(rows, "spot int, gene string, bin int, rate double")
    got = intervals.region_bin_means(rates([(1, "g", 0, 0.5), (2, "g", 0, 1.0), (3, "g", 2, 0.0), (9, "g", 0, 7.0)]), spots, 3).collect()
    assert {tuple(r) for r in got} == {("x", "g", 0, 2, 0.75), ("y", "g", 2, 1, 0.0)}
    for bad in ([(1, "g", 3, 0.5)], [(1, "g", 0, 1.5)], [(1, "g", 0, None)], [(3, "g", 0, 0.1), (3, "g", 0, 0.2)], [(9, "g", 0, 0.5)]):
        with pytest.raises(Violation):
            intervals.region_bin_means(rates(bad), spots, 3)


def test_graph_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 7)
    lists = [(i, o, float(o)) for i in range(1, 60) for o in {0, (i * 7) % 60, (i * 11 + 3) % 60} - {i}]
    near = spark.createDataFrame(lists, "id long, other long, d2 double")
    own = {}
    for i, o, _ in lists:
        own.setdefault(i, set()).add(o)
    for me in (False, True):
        sets = {i: s | ({i} if me else set()) for i, s in own.items()}
        got = {(r["a"], r["b"]): r["weight"] for r in graph.shared_neighbors(near, 3, me).collect()}
        want = {(a, b): len(x & y) / (2 * (3 + me) - len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}
        assert got == pytest.approx(want)
    both = spark.createDataFrame([(1, 2, 4.0), (2, 1, 4.0), (3, 1, 9.0)], "id long, other long, d2 double")
    assert {tuple(r) for r in graph.distance_graph(both).collect()} == {(1, 2, 2.0), (1, 3, 3.0)}


def test_loadings_of_all_genes(spark):
    some = spark.createDataFrame([(1, [0.5, 0.25])], "id int, vec array<double>")
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    assert {r["id"]: r["vec"] for r in linalg.zero_filled(some, ids, 2).collect()} == {1: [0.5, 0.25], 2: [0.0, 0.0]}
    with pytest.raises(Violation):
        linalg.zero_filled(some, ids.where("id = 2"), 2)
    counts = spark.createDataFrame([(1, 1, 3), (2, 2, 4)], "spot int, gene int, n int")
    with pytest.raises(Violation):
        linalg.residual_pca(counts, counts.select("spot"), spark.createDataFrame([(1,)], "gene int"), 1, counted=True)


def test_aligned_modalities_and_spot_table(spark, tmp_path):
    spots = lambda *rows: spark.createDataFrame(rows, "spot string, position int")
    a = spots(("a", 0), ("b", 1), ("c", 2))
    fine = bundle.Bundle({"rna_spots": a, "dna_spots": a.orderBy(F.desc("position"))})
    assert bundle.aligned(fine, ["dna"], "rna") is fine
    for other in (spots(("a", 0), ("b", 2), ("c", 1)), spots(("a", 0), ("b", 1)), spots(("a", 0), ("b", 1), ("c", 2), ("d", 3)), spots(("a", 0), ("a", 0), ("b", 1), ("c", 2))):
        with pytest.raises(Violation):
            bundle.aligned(bundle.Bundle({"rna_spots": a, "dna_spots": other}), ["dna"], "rna")
    for b, least in ((bundle.Bundle({"rna_spots": a}), 3), (fine, 4)):
        with pytest.raises(Violation):
            bundle.aligned(b, ["dna"], "rna", least)
    rows = spark.createDataFrame([("s1", 1, 2, "k", 10), ("s2", 11, 3, "m", 20)], "id string, r int, c int, cluster string, total int")
    bundle.write_spots(rows, f"{tmp_path}/spots", "id", "cluster", "leiden", ["total", "absent"], ("r", "c"))
    got = spark.read.option("header", True).csv(f"{tmp_path}/spots")
    assert got.columns == ["barcode", "total", "leiden"] and {tuple(r) for r in got.collect()} == {("01_02", "10", "k"), ("11_03", "20", "m")}
    with pytest.raises(Violation):
        bundle.write_spots(rows.withColumn("id", F.lit("x")), f"{tmp_path}/again", "id", "cluster")
