"""Secret scans: fixed patterns and character Markov models, in DataFrame expressions only.

Base spans come from three patterns, leftmost and non-overlapping for each kind. The models add spans of kind
"random": runs of 20 or more characters of ``[A-Za-z0-9+/_=-]``, less what base spans cover, with a letter and a digit,
whose mean log-likelihood ratio over character pairs, random strings against ordinary identifiers, reaches a threshold. Both
models are first-order chains over ASCII pairs with additive smoothing, trained from labelled samples: ordinary ones
are words of a bounded sample of documents in several spellings, random ones are digests in two alphabets.

Spans are (kind, start, end) in code points, end exclusive. Defined cases: null text is empty and has no span. Each row
is judged by itself, so repeated rows and ids are fine; extra columns are ignored; an empty table gives an empty
result, and models without ordinary samples fall back to uniform ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

RUN_LEAST = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}"
#: Documents whose words are ordinary samples, and random strings drawn: the bounds of the training sample.
SAMPLE_DOCS, SAMPLE_STRINGS = 1000, 4000
#: Mean log-likelihood ratio for each pair of characters from which a run counts as random.
RATIO = 2.0
_CODES = 128
#: Matches of a text that are located one after another; longer lists go by chunks.
CHUNK = 64
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters.

    Positions follow from the lengths of matches and of the gaps between them, summed up by chunks and within each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
    sizes = F.transform(found, lambda m: F.char_length(m))
    sizes = F.zip_with(sizes, F.transform(value, lambda m: F.char_length(m)) if group else sizes, lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    matches = F.filter(F.zip_with(F.split(text, pattern, -1), sizes, lambda g, m: F.struct(F.char_length(g).alias("gap"), m["n"].alias("n"), m["v"].alias("v"))), lambda m: m["n"].isNotNull())
    rank = F.lit(KINDS.index(kind))

    def inside(chunk: Column, at: Column) -> Column:
        """The spans of one chunk, whose first gap begins at ``at``."""
        start = F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))

        def step(s: Column, m: Column) -> Column:
            a = s["at"] + m["gap"]
            span = F.struct(a.alias("start"), rank.alias("rank"), (a + m["n"]).alias("end"))
            return F.struct((a + m["n"]).alias("at"), F.when(m["v"] >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

        return F.aggregate(chunk, start, step, lambda s: s["out"])

    def located(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, m: s + m["gap"] + m["n"]))
        upto = F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(upto, 1, F.size(chunks)), inside))

    chunks = _bound(matches, lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda c: F.slice(m, c * CHUNK + 1, CHUNK)))
    return F.when(text.rlike(pattern), _bound(chunks, located)).otherwise(F.array().cast(_SPANS))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(value, random): ordinary identifiers from the words of a sample of ``docs``, random strings from digests.

    The sample is the ``sample_docs`` rows of least hash of id and text, of which whole texts are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text").where(F.col("text").isNotNull())
    chosen = rows.select("k").orderBy("k").limit(sample_docs).distinct()
    some = rows.join(F.broadcast(chosen), "k", "left_semi")
    word = some.select(F.explode(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,19}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w")).distinct()
    lower, upper = F.lower("w"), F.upper("w")
    ordinary = word.select(F.explode(F.array("w", lower, upper, F.concat(lower, F.lit("_"), lower), F.concat(lower, F.initcap("w")), F.concat(upper, F.lit("_"), upper), F.concat(lower, F.lit("-"), lower), F.concat(lower, F.lit("/"), lower), F.concat(lower, F.lit("="), lower), F.concat(lower, F.lit("2")))).alias("value"), F.lit(False).alias("random"))
    digest = spark.range(strings).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("x"))
    drawn = digest.select(F.explode(F.array("x", F.base64(F.unhex("x")), F.translate(F.base64(F.unhex("x")), "+/", "-_"))).alias("value"), F.lit(True).alias("random"))
    return ordinary.union(drawn)


def pair_ratios(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each pair of ASCII codes; a table of fixed size."""
    chars = F.transform(F.split("value", ""), lambda c: F.ascii(c))
    pairs = samples.select("random", F.explode(F.zip_with(F.slice(chars, 1, F.char_length("value") - 1), F.slice(chars, 2, F.char_length("value") - 1), lambda a, b: a * _CODES + b)).alias("pair"))
    rows = pairs.where(F.col("pair").between(0, _CODES * _CODES - 1)).groupBy("random", "pair").count().collect()  # at most 2 * 128 * 128 rows
    count = {True: [0] * _CODES * _CODES, False: [0] * _CODES * _CODES}
    for r in rows:
        count[r["random"]][r["pair"]] = r["count"]

    def logs(n: list[int]) -> list[float]:
        out = []
        for a in range(_CODES):
            row = n[a * _CODES : (a + 1) * _CODES]
            total = sum(row) + smoothing * 66
            out += [math.log((x + smoothing) / total) for x in row]
        return out

    return [a - b for a, b in zip(logs(count[True]), logs(count[False]), strict=True)]


def _mean_ratio(run: Column, table: Column) -> Column:
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    n = F.char_length(run)
    pairs = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: a * _CODES + b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.element_at(table, p + 1)) / (n - 1)


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind: array<struct<start, rank, end>>."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", 2, ASSIGN_LEAST), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def _outside(run: Column, base: Column) -> Column:
    """The parts of a run, RUN_LEAST characters or longer, that no base span touches."""
    hits = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    begins = F.array_distinct(F.concat(F.array(run["start"]), F.transform(hits, lambda b: b["end"])))
    until = lambda a: F.coalesce(F.array_min(F.filter(F.transform(hits, lambda b: b["start"]), lambda s: s >= a)), run["end"])
    parts = F.transform(begins, lambda a: F.struct(a.alias("start"), run["rank"].alias("rank"), until(a).alias("end")))
    return F.filter(parts, lambda p: (p["end"] - p["start"] >= RUN_LEAST) & ~F.exists(hits, lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"])))


def _random_spans(text: Column, base: Column, table: Column, ratio: float) -> Column:
    runs = _spans(text, RUN, "random")
    free = F.flatten(F.transform(runs, lambda r: _outside(r, base)))
    letters = F.filter(free, lambda r: F.substr(text, r["start"] + 1, r["end"] - r["start"]).rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"))
    return F.filter(letters, lambda r: _mean_ratio(F.substr(text, r["start"] + 1, r["end"] - r["start"]), table) >= ratio)


def train(docs: DataFrame) -> list[float]:
    return pair_ratios(labelled_samples(docs))


def find_secrets(docs: DataFrame, table: list[float] | None = None, ratio: float = RATIO) -> DataFrame:
    """``docs`` with base and spans: arrays of struct(start, rank, end), rank being the place in KINDS."""
    values = F.from_json(F.lit(json.dumps(table if table is not None else train(docs))), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("base", base_spans(text))
    return out.withColumn("spans", F.array_sort(F.concat("base", _random_spans(text, F.col("base"), values, ratio))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(rank: int):
    return lambda s: s["rank"] == rank


def span_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text."""
    found = find_secrets(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; touching and overlapping spans become one."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    found = find_secrets(rows, train(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] > s["at"], F.concat(F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).when(s["at"] == 0, F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    cleaned = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text))))
    new = F.when(F.size("spans") > 0, cleaned).otherwise(F.col("text"))
    return found.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
