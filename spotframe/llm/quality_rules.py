"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words compare by Jensen-Shannon distance (base 2,
between 0 and 1) with references of its language, which sum the histograms of all its documents. A document of at
least ``min_words`` words fails if either distance exceeds its limit, which falls with the length of the text; shorter
ones are judged by the base rules alone.
Base rules: fewer than 10 words, or more than a fifth of the words in five-word windows that the text repeats.

Defined cases: null text: no words, fails. A null language is a language of its own. A language with fewer than
``min_reference`` words is compared with the sum of all languages. Repeated rows are judged alike; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged
from .features import CLASSES, COMMON, Texts, common_index
from .kernel import pieces, tidy

MIN_WORDS, MIN_REFERENCE = 50, 2000
#: A limit is a + b / sqrt(words): b allows for the chance differences of short texts.
CHAR_LIMIT, WORD_LIMIT = (0.10, 2.0), (0.10, 3.0)

_SCHEMA = "doc_id long, lang string, row_key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>"


def row_key() -> Column:
    """Rows of equal doc_id, lang and text share a key, and a verdict: the id and 128 bits of a digest."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    text = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit(""))
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.concat(F.char_length(lang).cast("string"), lang, text).cast("binary")))


def document_counts(docs: DataFrame) -> DataFrame:
    """Base counts and the two histograms of every whole text; one row per row of ``docs`` (doc_id, lang, text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in pieces(batch.column("text")):
                t = Texts(buf, offs)
                chars = t.class_counts(offs[:-1], offs[1:])
                line_bounds = np.searchsorted(t.line_doc, np.arange(t.n + 1))
                word = common_index(t.words.hashes(lower=True))
                words = np.bincount(t.word_doc * (len(COMMON) + 1) + word, minlength=t.n * (len(COMMON) + 1)).reshape(t.n, -1)
                base = [t.n_words, chars.sum(1) - chars[:, 3], chars[:, 5], t.per_doc(t.repeats_line, line_bounds), t.per_doc(t.repeated, t.words.first)]
                nested = [pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().astype(np.int64))) for x in (chars, words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo), batch.column("row_key").slice(lo, hi - lo), *[pa.array(x.astype(np.int64)) for x in base], *nested], ["doc_id", "lang", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", row_key().alias("row_key"), "text").mapInArrow(run, _SCHEMA)


def _sums(name: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(name)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the counts in the same row of ``q``; no counts: 0."""
    empty = (p.sum(1) == 0) | (q.sum(1) == 0)
    p, q = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (p.astype(np.float64), q.astype(np.float64)))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = sum(np.where(x > 0, x * np.log2(x / m), 0.0).sum(1) for x in (p, q))
    return np.where(empty, 0.0, np.sqrt(np.maximum(both / 2, 0.0)))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the histograms of rows with their distances from the references beside them."""
    for batch in batches:
        n = batch.num_rows
        table = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("chars", "words", "ref_chars", "ref_common")}
        rest = [c for c in batch.schema.names if c not in table]
        far = [pa.array(js_distance(table["chars"], table["ref_chars"])), pa.array(js_distance(table["words"], table["ref_common"]))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *far], [*rest, "char_distance", "word_distance"])


def judge(counts: DataFrame, min_words: int = MIN_WORDS, char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """The counts with base_failed, char_distance, word_distance and kept."""
    key = F.coalesce("lang", F.lit(""))
    of = counts.withColumn("key", key)
    by_lang = staged(of.groupBy("key").agg(F.sum("n_words").alias("ref_words"), _sums("chars", CLASSES), _sums("words", len(COMMON) + 1)), "references")
    whole = by_lang.agg(_sums("chars", CLASSES), _sums("words", len(COMMON) + 1)).select(F.col("chars").alias("all_chars"), F.col("words").alias("all_words"))
    own = F.col("ref_words") >= min_reference
    refs = by_lang.crossJoin(F.broadcast(whole)).select("key", F.when(own, F.col("chars")).otherwise(F.col("all_chars")).alias("ref_chars"), F.when(own, F.col("words")).otherwise(F.col("all_words")).alias("ref_common"))
    out = of.join(broadcast_if_small(refs, 10_000), "key").drop("key")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in ("chars", "words", "ref_chars", "ref_common"))
    out = out.mapInArrow(_distances, f"{kept}, char_distance double, word_distance double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    limit = lambda a, b: a + b / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > limit(*char_limit)) | (F.col("word_distance") > limit(*word_limit)))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """Counts and verdict of every document of ``docs`` (doc_id, lang, text)."""
    return judge(staged(document_counts(docs), "counts"), **limits).drop("row_key", "lang")


def passing_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    verdict = judge(staged(document_counts(docs), "counts"), **limits)
    rejected = staged(verdict.where("not kept").select("row_key").distinct(), "rejected")
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))
    return rows.join(broadcast_if_small(rejected), "row_key", "left_anti").select("row.*")
