"""Conversations as training text with a loss mask, in Spark expressions only.

Adjacent turns of one role become one block:

    <s>role[ROLE]text[NEXT]text</s>

The marks and other known control strings are escaped inside roles and texts by a backslash after their first
character (a control string that already has backslashes there gets one more), so `parse` gives back the very
turns. The loss mask lists the spans of assistant texts in the formatted text, in code points.

Turns are gathered in two steps: chunks of `CHUNK` consecutive turn numbers first, whose blocks are formatted in
their own group, then the chunks of a conversation. A long conversation is spread over many groups, and only its
formatted pieces meet in one row, which is the result. Turns are sorted by number, then role and text, nulls first.
A null text or role is empty, a null turn number sorts first, a null conversation is a conversation of its own.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
OPEN, ROLE, NEXT, CLOSE = "<s>", "[ROLE]", "[NEXT]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|ROLE\]|NEXT\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|ROLE\]|NEXT\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"

#: Turn numbers that one chunk covers.
CHUNK = 64


def escape(text: Column) -> Column:
    """Control strings made harmless; every other text is unchanged."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of `escape`."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _spanned(turns: Column, target: str) -> Column:
    """One chunk: its text between the first and the last mark, spans of target texts, first and last role.

    The running state holds the text so far, so a turn of the previous turn's role continues its block.
    """
    empty = F.struct(
        F.lit("").alias("body"),
        F.lit(None).cast("string").alias("first"),
        F.lit("").alias("last"),
        F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"),
        F.lit(0).alias("n"),
    )

    def step(state, turn):
        new = F.concat(F.lit(CLOSE + OPEN), turn["role"], F.lit(ROLE))
        mark = F.when(state["n"] == 0, F.lit("")).when(state["last"] == turn["role"], F.lit(NEXT)).otherwise(new)
        before = F.concat(state["body"], mark)
        start = F.length(before)
        span = F.struct(start.alias("start"), (start + F.length(turn["text"])).alias("stop"))
        return F.struct(
            F.concat(before, turn["text"]).alias("body"),
            F.coalesce(state["first"], turn["role"]).alias("first"),
            turn["role"].alias("last"),
            F.when(turn["role"] == target, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
            (state["n"] + 1).alias("n"),
        )

    return F.aggregate(turns, empty, step)


def format_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """One row per conversation: `conv`, n_turns, formatted text, loss_spans (start, stop; code points)."""
    rows = turns.select(
        F.col(conv).alias("__conv"),
        F.floor(F.col(turn) / CHUNK).alias("__chunk"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("__turn"),
    )
    chunks = (
        rows.groupBy("__conv", "__chunk")
        .agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
        .select("__conv", "__chunk", _spanned(F.col("__turns"), target).alias("__part"))
    )
    gathered = chunks.groupBy("__conv").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("__chunk", "__part"))), lambda c: c["__part"]
        ).alias("__parts")
    )

    def mark(part, i):
        previous = F.get(F.col("__parts"), i - 1)["last"]
        new = F.concat(F.lit(OPEN), part["first"], F.lit(ROLE))
        return F.when(i == 0, new).when(previous == part["first"], F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), new))

    marked = gathered.withColumn("__marks", F.transform("__parts", mark))
    lengths = F.transform("__parts", lambda p, i: F.length(F.get("__marks", i)) + F.length(p["body"]))
    starts = F.aggregate(
        lengths,
        F.expr("cast(array(0) as array<int>)"),
        lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)),
    )
    offset = marked.withColumn("__starts", starts)
    spans = F.flatten(
        F.transform(
            "__parts",
            lambda p, i: F.transform(
                p["spans"],
                lambda s: F.struct(
                    (s["start"] + F.get("__starts", i) + F.length(F.get("__marks", i))).alias("start"),
                    (s["stop"] + F.get("__starts", i) + F.length(F.get("__marks", i))).alias("stop"),
                ),
            ),
        )
    )
    pieces = F.transform("__parts", lambda p, i: F.concat(F.get("__marks", i), p["body"]))
    return offset.select(
        F.col("__conv").alias(conv),
        F.aggregate("__parts", F.lit(0).cast("bigint"), lambda n, p: n + p["n"]).alias("n_turns"),
        F.concat(F.array_join(pieces, ""), F.lit(CLOSE)).alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, in order: array of (role, text)."""
    blocks = F.split(F.substring(formatted, len(OPEN) + 1, 2**31 - 1), CLOSE + f"({OPEN}|$)")
    whole = F.filter(blocks, lambda b: F.contains(b, F.lit(ROLE)))

    def turns(block):
        role = unescape(F.substring_index(block, ROLE, 1))
        texts = F.split(F.substring(block, F.instr(block, ROLE) + len(ROLE), 2**31 - 1), r"\[NEXT\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(whole, turns))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"])))
