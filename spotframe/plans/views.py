"""Domain views on the supplied tables. One SQL text serves Spark and the oracle: tables appear as {name}."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # spot x feature counts; an absent pair is a true zero
    "counts": """SELECT l_suppkey AS spot, l_partkey AS gene, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n
        FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    # observed rates; a row is an observed value, zero included, an absent pair is missing
    "observed": """SELECT l_suppkey AS spot, l_partkey AS feature, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS num,
        CAST(count(*) AS BIGINT) AS den FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "spots": """SELECT s_suppkey AS spot, CAST(s_nationkey % 3 AS BIGINT) AS sample, CAST(n_regionkey AS BIGINT) AS cluster,
        CAST(floor(s_suppkey / 10) AS BIGINT) AS grid_row, CAST(s_suppkey % 10 AS BIGINT) AS grid_col
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "genes": """SELECT p_partkey AS gene, p_type AS symbol, p_brand AS chrom, CAST((p_partkey * 37) % 10000 AS BIGINT) AS lo,
        CAST((p_partkey * 37) % 10000 + 10 * p_size AS BIGINT) AS hi, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM {part}""",
    # regions of interest: 0-based, half-open
    "regions": """SELECT o_orderkey AS region, concat('Brand#', CAST(1 + o_orderkey % 5 AS STRING), CAST(1 + CAST(floor(o_orderkey / 5) AS BIGINT) % 5 AS STRING)) AS chrom,
        CAST((o_custkey * 91) % 10400 AS BIGINT) AS lo, CAST((o_custkey * 91) % 10400 + 20 + o_orderkey % 180 AS BIGINT) AS hi
        FROM {orders}""",
    # exons of transcripts, and the coding parts of some of them; neighbours may overlap
    "exons": """SELECT l_orderkey AS transcript, concat('Brand#', CAST(1 + l_orderkey % 5 AS STRING), CAST(1 + CAST(floor(l_orderkey / 5) AS BIGINT) % 5 AS STRING)) AS chrom,
        CASE WHEN l_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand, kind, CAST(2000 * l_orderkey + 1500 * l_linenumber + l_partkey % 1000 + cut AS BIGINT) AS lo,
        CAST(2000 * l_orderkey + 1500 * l_linenumber + l_partkey % 1000 + 30 * CAST(l_quantity AS BIGINT) + 20 - cut AS BIGINT) AS hi
        FROM {lineitem} JOIN (SELECT 'exon' AS kind, 0 AS cut UNION ALL SELECT 'CDS', 8) k ON kind = 'exon' OR l_linenumber BETWEEN 2 AND 4""",
    "loci": """SELECT o_orderkey AS region, concat('Brand#', CAST(1 + o_orderkey % 5 AS STRING), CAST(1 + CAST(floor(o_orderkey / 5) AS BIGINT) % 5 AS STRING)) AS chrom,
        CAST(greatest(0, 2000 * o_orderkey + (o_custkey * 91) % 30000 - 8000) AS BIGINT) AS lo,
        CAST(greatest(0, 2000 * o_orderkey + (o_custkey * 91) % 30000 - 8000) + 20 + o_orderkey % 180 AS BIGINT) AS hi FROM {orders}""",
    "sites": """SELECT p_brand AS chrom, CAST((l_orderkey * 13) % 10000 AS BIGINT) AS pos, CAST(round(l_discount * 1000) AS BIGINT) AS pct,
        CAST(l_quantity AS BIGINT) AS meth, CAST(l_linenumber AS BIGINT) AS unmeth, l_suppkey AS spot
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # reads of a spot, and how many of its sites have each depth
    "reads": "SELECT o_custkey AS spot, CAST(count(*) AS BIGINT) AS reads FROM {orders} GROUP BY o_custkey",
    "depth": """SELECT o_custkey AS spot, n_lines AS depth, CAST(count(*) AS BIGINT) AS site_count FROM {orders}
        JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines FROM {lineitem} GROUP BY l_orderkey) x ON o_orderkey = l_orderkey
        GROUP BY o_custkey, n_lines""",
    "vectors": "SELECT vec_id AS id, embedding AS vec, CAST(label AS BIGINT) AS label FROM {embeddings}",
    "event": "SELECT event_id, user_id, event_type, value, ts, props FROM {events}",
}

# counts in which five genes of eleven are found in one cluster each
VIEWS["planted"] = f"""SELECT c.spot, c.gene, c.n FROM ({VIEWS["counts"]}) c JOIN ({VIEWS["spots"]}) s ON c.spot = s.spot
    WHERE c.gene % 11 > 4 OR c.gene % 11 = s.cluster"""

_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a lazy DataFrame over the Parquet tables it names."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(_NAME.findall(text))})


def with_views(query: str) -> str:
    """``query`` for the oracle: the views it names as {name} become common table expressions."""
    names = list(dict.fromkeys(n for n in _NAME.findall(query) if n in VIEWS))
    ctes = [f"{n} AS ({_NAME.sub(r'\1', VIEWS[n]).replace('AS STRING', 'AS VARCHAR')})" for n in names]
    body = _NAME.sub(r"\1", query)
    if not ctes:
        return body
    head = re.match(r"\s*WITH (RECURSIVE )?", body)
    return f"WITH {head[1] or ''}{', '.join(ctes)}, {body[head.end():]}" if head else f"WITH {', '.join(ctes)} {body}"
