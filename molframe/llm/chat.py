r"""Conversations as training text with a loss mask, in Spark expressions only.

A conversation's turns are collected as structs and sorted. Neighbouring turns of one role are merged into one block:

    <|turn|>user<|text|>first<|part|>second<|end|>
    <|turn|>assistant<|text|>answer<|end|>

each block on a line of its own. Marks begin with `<|`. Inside roles and texts a backslash is written as two and `<|` as
`<\|`, so texts hold no mark, and what was written can be read back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", r"\|"))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted): `segments` holds the text piece by piece, with `loss` true for the pieces that are
    assistant texts; `formatted` is all pieces joined.

    Turns stand by turn, then role, then text; null roles and texts are empty, null turns come first, rows that repeat
    each count as a turn. Rows of a null conv_id are one conversation. A conversation is one row, so it is as large as
    its text. Other columns are not read."""
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        opening = F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        before = F.when(i == 0, opening).when(F.get(F.col("turns"), i - 1)["role"] == t["role"], F.lit(PART)).otherwise(F.concat(F.lit(END), opening))
        return F.array(F.struct(before.alias("text"), F.lit(False).alias("loss")), F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))

    pieces = F.flatten(F.transform("turns", piece))
    closed = F.concat(pieces, F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))
    out = turns.select("conv_id", closed.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs of role and text, merged ones apart again."""
    blocks = F.filter(_split(formatted, TURN), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        halves = _split(block, TEXT)
        body = F.substring_index(F.get(halves, F.lit(1)), END, 1)
        return F.transform(_split(body, PART), lambda p: F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
