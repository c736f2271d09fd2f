"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written as ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside roles and texts are escaped by a
``~`` after their first character (``<|end|>`` becomes ``<~|end|>``, ``<~|end|>`` becomes ``<~~|end|>``), which is
undone exactly. Newlines in roles are percent-encoded, so the first newline of a turn ends its role.

Null conv_id: its rows form one conversation. Null role or text: empty. Null turn: before the others. Rows that tie
on turn: by role, then text. Repeated rows: repeated turns. Very long texts: whole, like any other; a conversation's turns are
one row, and its examples, each with its context, follow one by one. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
CONTROL = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_FIRST = sorted({c[0] for c in CONTROL})
assert not any(f in c[1:] or c[1:].startswith("~") for f in _FIRST for c in CONTROL)
_STARTS = "[" + "".join(re.escape(f) for f in _FIRST) + "]"
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE, UNESCAPE = rf"({_STARTS})(~*(?:{_RESTS}))", rf"({_STARTS})~(~*(?:{_RESTS}))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "$1~$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def _role_escaped(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_examples(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row for each reply of role ``trainable``: conv_id, example (from 0), context, target, rest, loss_start, loss_length.

    context holds all preceding turns, target the reply's turn, of whose code points those from loss_start (in context
    followed by target, from 1) on, loss_length of them, are trainable. rest holds what follows the last reply, on the
    last example only. A conversation without such replies has one row with all turns in rest and an empty target.
    The rows of a conversation stay where its turns were gathered: one shuffle of the turns, none of the examples.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), _role_escaped(t["role"]), F.lit("\n"))
    pieces = grouped.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t, i: F.struct(i.alias("i"), (t["role"] == trainable).alias("reply"), head(t).alias("head"), escaped(t["text"]).alias("body")),
        ).alias("turns"),
    )
    whole = lambda part: F.array_join(F.transform(part, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    replies = F.transform(F.filter("turns", lambda t: t["reply"]), lambda t: t["i"])
    none = F.lit(-1).cast("int")
    spread = pieces.select(
        "conv_id", "turns", F.size(replies).alias("n"), F.posexplode(F.when(F.size(replies) > 0, replies).otherwise(F.array(none))).alias("example", "at")
    )
    found = F.col("at") >= 0
    last = F.col("example") >= F.col("n") - 1
    rows = spread.select(
        "conv_id",
        "example",
        F.when(found, F.get("turns", F.col("at"))).alias("reply"),
        F.when(found, whole(F.slice("turns", F.lit(1), F.greatest(F.col("at"), F.lit(0))))).otherwise("").alias("context"),
        F.when(last, whole(F.slice("turns", F.col("at") + 2, F.size("turns")))).otherwise("").alias("rest"),
    )
    head, body = F.col("reply")["head"], F.col("reply")["body"]
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        "context",
        F.coalesce(F.concat(head, body, F.lit(END + "\n")), F.lit("")).alias("target"),
        "rest",
        F.when(F.col("reply").isNotNull(), F.length("context") + F.length(head) + 1).cast("long").alias("loss_start"),
        F.coalesce(F.length(body), F.lit(0)).cast("long").alias("loss_length"),
    )


def parsed_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    return F.transform(
        F.filter(F.split(formatted, re.escape(TURN)), lambda p, i: i > 0),
        lambda p: F.struct(
            _role_unescaped(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(
                F.substr(
                    p,
                    F.length(F.substring_index(p, "\n", 1)) + 2,
                    F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END) - 1,
                )
            ).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: what the turns, the text under the loss mask and the format were."""
    # The mask lies in context followed by target; what is trainable is part of the target.
    start = (F.col("loss_start") - F.length("context")).cast("int")
    span = F.when(F.col("loss_length") > 0, F.substr("target", start, F.col("loss_length").cast("int"))).otherwise("")
    # Of the growing contexts only the last one is kept.
    last = F.max_by(F.struct("context", "target", "rest"), "example")
    gathered = examples.groupBy("conv_id").agg(
        last.alias("last"), F.array_sort(F.collect_list(F.struct("example", unescaped(span).alias("loss")))).alias("parts"), F.count("loss_start").alias("n_examples")
    )
    gathered = gathered.select(
        "conv_id", F.concat("last.context", "last.target", "last.rest").alias("whole"), F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"), "n_examples"
    ).withColumn("turns", parsed_turns(F.col("whole")))
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(read.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
        "n_examples",
    )
