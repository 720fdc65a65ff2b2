"""Every reference query with SQL against DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

from spotframe.plans import cohort_queries, genome_queries, matrix_queries, registry, stat_queries, table_queries  # noqa: E402, F401


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return c


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    return repr(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    answer = duck.sql(registry.ORACLE[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())


def rows_of(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, DIR).collect()]


def test_region_markers_are_published_ones(spark):
    tested = rows_of(spark, "region_markers")
    assert all(0 <= r["p"] <= r["p_adjusted"] <= 0.05 and math.isfinite(r["t"]) for r in tested)
    assert len({(r["cluster"], r["feature"]) for r in tested}) == len(tested)


def test_variance_shares_sum_to_one(spark):
    (r,) = rows_of(spark, "variance_partition")
    assert math.isclose(sum(r[c] for c in ("unique_first", "unique_second", "shared", "interaction_gain", "residual")), 1.0)
    assert -1e-9 <= r["r2_first"] <= r["r2_additive"] + 1e-9 <= r["r2_interaction"] + 2e-9 <= 1.0


def test_weighted_neighbors_rank_others(spark):
    lists = {}
    for r in rows_of(spark, "wnn"):
        assert r["id"] != r["other"] and 0 <= r["weight"] <= 1
        lists.setdefault(r["id"], []).append((r["rank"], -r["weight"]))
    n = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
    assert len(lists) == n and all([k for k, _ in sorted(x)] == [1, 2, 3, 4, 5] and sorted(x, key=lambda y: y[1]) == sorted(x) for x in lists.values())


def test_corrected_embeddings_keep_every_row(spark):
    got = rows_of(spark, "harmony")
    n = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
    assert len({r["id"] for r in got}) == len(got) == n and all(len(r["vec"]) == 64 and all(map(math.isfinite, r["vec"])) for r in got)


def test_mixtures_sum_to_one(spark):
    got = rows_of(spark, "deconvolution")
    assert len(got) == spark.read.parquet(f"{DIR}/supplier.parquet").count()
    fitted = [r for r in got if r["proportions"]]
    assert fitted and all(math.isclose(sum(r["proportions"].values()), 1.0, rel_tol=1e-9) and math.isclose(max(r["proportions"].values()), r["max_proportion"]) for r in fitted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
