"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role
are merged into one block, and the blocks are concatenated:

    <|turn|>user<|text|>Hi.<|more|>And another line.<|end|>\\n<|turn|>assistant<|text|>...<|end|>\\n

``<|more|>`` parts the texts of turns that were merged, so the turns can be read back as
they were. Control strings inside roles and texts get a backslash after their first
character (and one more for each backslash that is there already), which ``unescape``
takes off again; after that no control string is left in them.

Defined results: a null text or role is empty; equal turn numbers are ordered by role,
then text, nulls first; rows with a null conversation id form one conversation; an
empty table gives an empty table; further columns of the input are not looked at. A
conversation is one row of the result, so it has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"

# What follows the first character of a control string: of this template, and of two
# others whose strings must not pass through unescaped either.
_REST = r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """``(conv, formatted, segments)``: one row per conversation.

    ``segments`` are structs ``(text, loss)`` whose texts make up ``formatted``; the
    loss mask covers those with ``loss`` true, the texts of role ``learn``.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    collected = turns.groupBy(F.col(conv)).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col(turn).alias("turn"), blank(role).alias("role"), escape(blank(text)).alias("text"),
        ))).alias("t")
    )
    # Positions at which a block begins; block k holds the turns up to the next of them.
    heads = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]),
    )
    blocks = F.transform("heads", lambda h, k: F.struct(
        F.get("t", h)["role"].alias("role"),
        F.transform(
            F.slice("t", h + 1, F.coalesce(F.get("heads", k + 1), F.size("t")) - h), lambda x: x["text"]
        ).alias("texts"),
    ))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def written(b: Column) -> Column:
        no = F.lit(False)
        return F.concat(
            F.array(segment(F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT)), no)),
            F.flatten(F.transform(b["texts"], lambda x, i: F.concat(
                F.when(i > 0, F.array(segment(F.lit(MORE), no))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")),
                F.array(segment(x, b["role"] == learn)),
            ))),
            F.array(segment(F.lit(END), no)),
        )

    return (
        collected.withColumn("heads", heads)
        .withColumn("blocks", blocks)
        .withColumn("segments", F.flatten(F.transform("blocks", written)))
        .select(
            F.col(conv),
            F.array_join(F.col("segments")["text"], "").alias("formatted"),
            "segments",
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs ``(role, text)``, in order."""
    blocks = F.split(formatted, r"<\|end\|>\n")
    kept = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        parts = F.split(b, r"<\|(?:text|more)\|>", -1)
        role = unescape(F.substring(F.get(parts, F.lit(0)), len(TURN) + 1, F.lit(2**31 - 1)))
        return F.transform(
            F.slice(parts, F.lit(2), F.size(parts) - 1),
            lambda x: F.struct(role.alias("role"), unescape(x).alias("text")),
        )

    return F.flatten(F.transform(kept, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def loss_lengths(segments: Column) -> Column:
    """The mask over ``formatted`` as structs ``(length, loss)`` in code points."""
    return F.transform(segments, lambda s: F.struct(F.length(s["text"]).alias("length"), s["loss"].alias("loss")))
