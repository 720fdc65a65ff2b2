"""Mixing sources to target weights with hash-threshold histograms, in DataFrame expressions only.

Every document has a 60-bit hash of its id. A source's mix takes whole copies of all its documents as far as its
target allows, then one more copy of the documents below a hash threshold. The threshold is found without sorting:
a histogram sums the words by source and hash bucket, the bucket in which the budget ends is refined by the next bits
of the hash, and only its rows take part in the next histogram. Lower budgets give lower thresholds, so mixes are
nested. At the boundary hash itself the remaining words are shared evenly among rows of equal size, larger sizes
first, so a source's taken words meet its target to less than one word for each row there; with distinct ids that is
one row, of which the mix takes the first words, and the target is met exactly up to rounding.

Defined cases: a null or blank text has no word and nothing is taken from it. A null source is a source of its own and
comes last. Rows that repeat a ``doc_id`` share a hash. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each histogram resolves, and all bits used.
BITS, ALL_BITS = 12, 60
#: Sources up to which their table may be broadcast.
SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, no target above ``most`` times its size.

    ``weights`` repeat over the sources by code point, null last. What a source can't take is dealt again by weight:
    the result is the level L at which the least of L * weight and the caps sums up to the total.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * share
    lower = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("total", total).withColumn("full", F.coalesce(F.sum("cap").over(lower), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0)))
    # the level if exactly the sources of lower ratio are full; later ones give a lower level
    by = by.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy(F.lit(1)))
    return by.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(level, F.col("ratio"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, source, text)."""
    sizes = staged(sized(docs), "sizes")
    return taken_words(sizes, *mix_plan(sizes, weights, share, most)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, a copy that it takes in part included; same columns."""
    plan = mix_plan(staged(sized(docs).select("source", "size", "h"), "sizes"), **how)
    rows = docs.select(F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    out = taken_words(rows, *plan).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return out.select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select("row.*")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): size is the number of words, h the hash."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Copies and boundary hash of each source, and the shares of rows at the boundary hash.

    ``sizes``: a staged table (source, size, h).
    """
    targets = staged(source_targets(sizes, weights, share, most), "targets")
    targets = targets.withColumn("goal", F.round("target").cast("long"))
    size = F.nullif(F.col("source_size"), F.lit(0))
    targets = targets.withColumn("copies", F.least(F.floor(F.col("goal") / size), F.lit(int(most)))).fillna(0, ["copies"]).withColumn("budget", F.col("goal") - F.col("copies") * F.col("source_size"))
    # prefix: the hash bits fixed so far; left: words of the budget still free below that prefix's end
    edge = targets.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    rows, settled = sizes.select("source", "h", "size"), []
    for used in range(BITS, ALL_BITS + 1, BITS):
        key = F.shiftright("h", ALL_BITS - used)
        same = rows["source"].eqNullSafe(edge["s"])
        inside = rows.join(broadcast_if_small(edge, SOURCES), same & (F.shiftright(rows["h"], ALL_BITS - used + BITS) == edge["prefix"])).select("source", "h", "size", "left")
        cells = inside.groupBy("source", key.alias("cell")).agg(F.sum("size").alias("words"), F.max("left").alias("left"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        cells = cells.withColumn("upto", running)
        # the first bucket whose end passes the budget; none if the budget covers all
        crossing = cells.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("cell", "upto", "words", "left", "lo", "hi")).alias("c"))
        found = staged(crossing.select(F.col("source").alias("s"), F.col("c.cell").alias("prefix"), (F.col("c.left") - F.col("c.upto") + F.col("c.words")).alias("left"), "c.lo", "c.hi"), "edge")
        # a bucket of one hash needs no more bits
        settled.append(found.where("lo = hi").select("s", F.col("lo").alias("prefix"), "left"))
        edge = found.where("lo < hi").select("s", "prefix", "left")
        if edge.isEmpty():
            break
    edge = settled[0]
    for x in settled[1:]:
        edge = edge.union(x)
    edge = staged(edge, "edge")
    # rows at the boundary hash: one class per size
    rows = sizes.select("source", "h", "size")
    at_edge = rows.join(broadcast_if_small(edge, SOURCES), rows["source"].eqNullSafe(edge["s"]) & (rows["h"] == edge["prefix"])).groupBy("source", "h", "size", "left").agg(F.count("*").alias("n"))
    classes = at_edge.groupBy("source", "h").agg(F.max("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("classes"))
    dealt = "array<struct<size:bigint,each:bigint>>"
    start = F.struct(F.col("left"), F.array().cast(dealt).alias("out"))

    def deal(s: Column, c: Column) -> Column:
        """A class takes an even share of what is left; the words that don't divide go on to the next class."""
        each = F.least(c["size"], F.floor(F.greatest(s["left"], F.lit(0)) / c["n"]))
        return F.struct((s["left"] - each * c["n"]).alias("left"), F.concat(s["out"], F.array(F.struct(c["size"].alias("size"), each.alias("each")))).alias("out"))

    parts = classes.select("source", "h", F.inline(F.aggregate("classes", start, deal, lambda s: s["out"]))).select(F.col("source").alias("s2"), F.col("h").alias("h2"), F.col("size").alias("size2"), "each")
    parts = staged(parts, "parts")
    plan = targets.select(F.col("source").alias("s1"), "source_size", "target", "copies", "budget", F.lit(int(most)).alias("limit"))
    plan = staged(plan.join(edge, plan["s1"].eqNullSafe(edge["s"]), "left").select("s1", "source_size", "target", "copies", "budget", "limit", F.col("prefix").alias("boundary")), "plan")
    return plan, parts


def taken_words(rows: DataFrame, plan: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` (with source, size, h) with source_size, target and taken."""
    out = rows.join(broadcast_if_small(plan, SOURCES), rows["source"].eqNullSafe(plan["s1"]))
    out = out.join(broadcast_if_small(parts, SOURCES), F.col("s1").eqNullSafe(F.col("s2")) & (F.col("h") == F.col("h2")) & (F.col("size") == F.col("size2")), "left")
    extra = F.when(F.col("boundary").isNull(), F.when(F.col("budget") > 0, F.col("size")).otherwise(0)).when(F.col("h") < F.col("boundary"), F.col("size")).when(F.col("h") == F.col("boundary"), F.coalesce("each", F.lit(0))).otherwise(0)
    return out.withColumn("taken", F.least(F.col("copies") * F.col("size") + extra, F.col("limit") * F.col("size")).cast("long"))
