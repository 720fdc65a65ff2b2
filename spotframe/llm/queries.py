"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import new_folder
    from .content_store import read_digests, write_store

    folder = new_folder(spark, "store")
    write_store(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), cut="blank", end_id=1)
    return read_digests(spark, folder)


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), limit=64 << 10)


def op3_epsilon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .epsilon_join import epsilon_join

    return epsilon_join(_table(spark, sf_dir, "embeddings"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import span_table

    return span_table(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import staged
    from .packing import pack, piece_digests

    return piece_digests(staged(pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "packed"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_and_read

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0, 'user', '{text}'), (-1L, 1, 'assistant', '{text}') AS t(conv_id, turn, role, text)")
    return format_and_read(rows.union(own))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_kmeans import cluster_table

    return cluster_table(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_folder
    from .wacz import page_table, write_archives

    return page_table(write_archives(_table(spark, sf_dir, "pages"), new_folder(spark, "archives"), min_bytes=0))


QUERIES = {
    f.__name__: f
    for f in (
        op1_content_store,
        op2_extendible_sharding,
        op3_epsilon_join,
        op4_quality_crf,
        op5_secret_scan,
        op6_best_fit_packing,
        op7_mixing,
        op8_quality_rules,
        op9_chat_format,
        op10_jaccard_join,
        op11_ball_kmeans,
        op12_filter_audit,
        op13_warc_archives,
    )
}
