"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, runs of turns with the same
role become one segment, and segments are concatenated under a template.  Control strings
begin with ``<|``; texts are escaped so that they never contain one, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TURN, TEXT, PART, END = "<s>", "<|turn|>", "<|text|>", "<|part|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """The text without any ``<|``: backslashes are doubled, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, n_segments, loss_spans``, one row per conversation.

    Turns are ordered by turn, then role, then text; null role or text counts as empty,
    null turns come first and rows without a conversation id form one of their own.
    Repeated rows are turns of their own.  ``loss_spans`` are the code-point ranges (end
    exclusive) of ``formatted`` that hold texts of role ``learn``.  A conversation is one
    row of the result, so its turns must fit in one.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    heads = t.withColumn("h", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[i - 1].role)"))
    segments = heads.select("conv_id", F.expr("transform(h, (a, k) -> slice(t, a + 1, coalesce(get(h, k + 1), size(t)) - a))").alias("s"))
    #: pieces of the output, in order: what is written, and whether the loss covers it
    piece = lambda text, loss: F.struct(text.alias("w"), F.lit(loss).alias("l") if isinstance(loss, bool) else loss.alias("l"))

    def of(seg: Column) -> Column:
        role = seg[0]["role"]
        body = F.transform(seg, lambda x, k: F.array(piece(F.when(k > 0, F.lit(PART)).otherwise(F.lit("")), False), piece(escape(x["text"]), role == learn)))
        return F.concat(F.array(piece(F.concat(F.lit(TURN), escape(role), F.lit(TEXT)), False)), F.flatten(body), F.array(piece(F.lit(END), False)))

    pieces = segments.select("conv_id", F.size("s").alias("n_segments"), F.concat(F.array(piece(F.lit(OPEN), False)), F.flatten(F.transform("s", of))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def advance(acc: Column, x: Column) -> Column:
        to = acc["at"] + F.length(x["w"])
        span = F.struct(acc["at"].alias("start"), to.alias("end"))
        return F.struct(to.alias("at"), F.when(x["l"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select("conv_id", F.array_join(F.transform("p", lambda x: x["w"]), "").alias("formatted"), "n_segments", F.aggregate("p", start, advance, lambda a: a["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, as an array of ``role, text``."""
    segments = F.slice(F.split(formatted, "<\\|turn\\|>", -1), 2, 1 << 30)

    def turns(seg: Column) -> Column:
        role = unescape(F.substring_index(seg, TEXT, 1))
        body = F.substring_index(F.substring_index(seg, TEXT, -1), END, 1)
        return F.transform(F.split(body, "<\\|part\\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(segments, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
