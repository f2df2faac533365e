"""Chat formatting: conversations as one reversible training text each, in Spark expressions only.

A conversation becomes blocks ``<turn ROLE>\\n … </turn>\\n``.  Adjacent turns of one role are merged into one block that
keeps the parts apart; a part is ``<loss>…</loss>`` if its role is trained on and ``<text>…</text>`` otherwise, so the
loss mask is part of the text.  In roles and texts ``\\``, ``<`` and ``>`` are written ``\\b``, ``\\l`` and ``\\g``: no
control string can occur inside a text, and reading back is exact.

Defined cases: null texts and roles are empty; turns are ordered by (turn, role, text) with null turns first, so ties
have one order and repeated rows stay repeated; rows without a conversation id form one conversation; an empty table
gives no rows; further columns are ignored.  A conversation is one output row, which is the unit that a task holds; all
steps inside it are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings and escapes.
CONTROL = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
TURN_END = "</turn>\n"
LOSS, TEXT = "loss", "text"


def escape(c: Column) -> Column:
    for plain, code in CONTROL:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(CONTROL):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _part(text: Column, trained: Column) -> Column:
    tag = F.when(trained, F.lit(LOSS)).otherwise(F.lit(TEXT))
    return F.concat(F.lit("<"), tag, F.lit(">"), escape(text), F.lit("</"), tag, F.lit(">"))


def merged_turns(turns: Column) -> Column:
    """Sorted (role, text) structs → array of (role, texts): adjacent turns of one role become one entry."""
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i).getField("role") != F.get(turns, i - 1).getField("role"))
    )
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(turns, s).getField("role").alias("role"),
            F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), n) - s), lambda t: t.getField("text")).alias("texts"),
        ),
    )


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """(conv, formatted): one row per conversation."""
    entry = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    turns = rows.select(F.col(conv).alias(conv), entry.alias("entry")).groupBy(conv).agg(F.sort_array(F.collect_list("entry")).alias("turns"))
    runs = turns.select(conv, merged_turns(F.col("turns")).alias("runs"))
    block = F.transform(
        "runs",
        lambda r: F.concat(
            F.lit("<turn "), escape(r.getField("role")), F.lit(">\n"),
            F.array_join(F.transform(r.getField("texts"), lambda t: _part(t, r.getField("role").isin(*trained))), ""),
            F.lit(TURN_END),
        ),
    )
    return runs.select(conv, F.array_join(block, "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """formatted → the original turns in order, as (role, text, trained)."""
    blocks = F.filter(F.split(formatted, TURN_END, -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, "^<turn ([^>]*)>", 1))
        parts = F.filter(F.split(b, "<", -1), lambda p: p.startswith(LOSS + ">") | p.startswith(TEXT + ">"))
        return F.transform(
            parts,
            lambda p: F.struct(
                role.alias("role"),
                unescape(F.substring_index(F.concat(p, F.lit("<")), "<", 1).substr(F.lit(len(LOSS) + 2), F.length(p))).alias("text"),
                p.startswith(LOSS + ">").alias("trained"),
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_spans(formatted: Column) -> Column:
    """Code point spans [start, end) of the formatted text that count for the loss."""
    pieces = F.split(formatted, "<", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    open_tag = len(LOSS) + 1

    def step(acc: Column, p: Column) -> Column:
        at = acc.getField("at")
        start, end = at + open_tag, at + F.char_length(p)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = acc.getField("spans")
        return F.struct(
            (end + 1).alias("at"), F.when(p.startswith(LOSS + ">"), F.concat(spans, span)).otherwise(spans).alias("spans")
        )

    return F.aggregate(pieces, zero, step).getField("spans")
