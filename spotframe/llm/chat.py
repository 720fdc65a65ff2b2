"""Chat formatting in DataFrame expressions only.

A conversation's turns are collected as structs and sorted by turn, then role, then text. Adjacent turns of one role
make one block; the blocks' strings are concatenated:

    prompt block   [INST]role\\ntext<sep>text[/INST]
    answer block   <s>role\\ntext<sep>text</s>

``<sep>`` stands between the turns of a block, so that each turn can be read back. Control strings inside texts and
roles are escaped with a backslash code, so a text can neither end its block nor open another. The loss mask is a list
of spans [start, end) in code points of the formatted string: the texts of answer turns, without marks.

Defined cases: null text or role is empty. Turns of equal number follow role, then text; repeated rows are turns of
their own. A null conv_id is one conversation. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

ANSWER = "assistant"
_TURN = "array<struct<role:string,text:string>>"


def escape(x: Column) -> Column:
    """Backslashes and control strings as codes; the result holds no control string."""
    x = F.replace(x, F.lit("\\"), F.lit("\\b"))
    x = F.regexp_replace(x, r"<(/?s>|sep>)", r"\\l$1")
    return F.regexp_replace(x, r"\[(/?INST\])", r"\\k$1")


def unescape(x: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\k", "["), ("\\w", "\n"), ("\\b", "\\")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return x


def blocks_of(turns: Column) -> Column:
    """Adjacent turns of one role as struct(role, texts)."""
    n = F.size(turns)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss is array<struct<start, end>>. ``rows``: conv_id, turn, role, text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    safe = F.transform("turns", lambda t: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\w")).alias("role"), escape(t["text"]).alias("text")))
    blocks = turns.withColumn("turns", safe).withColumn("blocks", blocks_of(F.col("turns")))

    def segments(b: Column) -> Column:
        """Strings of a block with whether each is under the loss mask."""
        answer = b["role"] == ANSWER
        head = F.struct(F.concat(F.when(answer, "<s>").otherwise("[INST]"), b["role"], F.lit("\n")).alias("s"), F.lit(False).alias("loss"))
        tail = F.struct(F.when(answer, "</s>").otherwise("[/INST]").alias("s"), F.lit(False).alias("loss"))
        between = F.struct(F.lit("<sep>").alias("s"), F.lit(False).alias("loss"))
        inner = F.flatten(F.transform(b["texts"], lambda x, i: F.when(i == 0, F.array(F.struct(x.alias("s"), answer.alias("loss")))).otherwise(F.array(between, F.struct(x.alias("s"), answer.alias("loss"))))))
        return F.concat(F.array(head), inner, F.array(tail))

    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.char_length(p["s"])
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"))))).otherwise(s["out"]).alias("out"))

    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), F.aggregate("parts", start, step, lambda s: s["out"]).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, r"</s>|\[/INST\]", -1), lambda b: F.char_length(b) > 0)

    def turns(b: Column) -> Column:
        body = F.regexp_replace(b, r"^(?:<s>|\[INST\])", "")
        role = unescape(F.substring_index(body, "\n", 1))
        texts = F.split(F.regexp_replace(body, r"^[^\n]*\n", ""), "<sep>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(pieces, turns)).cast(_TURN)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substr(formatted, s["start"] + 1, s["end"] - s["start"])), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from (conv_id, formatted, loss)."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("under", read_loss(F.col("formatted"), F.col("loss")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.char_length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def format_and_read(rows: DataFrame) -> DataFrame:
    """Format ``rows``, write the result to the shared folder, and digest what is read back."""
    return digests(staged(format_conversations(rows), "chat"))
