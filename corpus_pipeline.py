"""A training-data pipeline: rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and rereads it as the next
stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.llm.jaccard_join import one_of_each_group
from spotframe.llm.mixing import mix_documents
from spotframe.llm.packing import pack, piece_digests
from spotframe.llm.quality_rules import passing_documents
from spotframe.llm.secrets import redact
from spotframe.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or blank text fails and goes; a null language is judged as a language of its own. Equal rows share a verdict.
    """
    return passing_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Rows that share an id but not their words are documents of their own; equal rows leave one. Texts without a word
    and rows without an id all stay, but for equal rows of one id.
    """
    return one_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts and n_chars counted anew.

    A null text stays null, and so does its n_chars. Each row is judged by itself.
    """
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, one taken in part as a whole copy.

    A document without a word has nothing to take and goes. A null source is a source of its own.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences; a null text is its end id alone."""
    return piece_digests(pack(docs, public_tokenizers.path("byte_bpe_50k.json")), keep_ids=True)


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixing), ("best-fit packing", packing)]

#: Tokenizer ids aren't expressible in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
