"""Chat formatting: typed content parts become one marked text per block of turns, with a loss mask.

A turn's content is a string or an array of parts ``struct<type, text, ref, units>``. The visitor turns a text
part into escaped text and an image, audio or document part into a placeholder, records what the placeholder
stands for, and counts the tokens it will expand to. Everything is a DataFrame expression.

Template: ``<turn role="ROLE">CONTENT</turn>`` and a line break. Texts and roles have ``&``, ``<`` and ``"``
written as ``&amp;``, ``&lt;`` and ``&quot;``, so a raw ``<`` always belongs to the template and reading back is exact.

A conversation is one formatted text; by request it is a sequence of parts, each with the turns of one block of turn
numbers, so that no task has to hold a whole conversation; the parts in order are the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Turn numbers in a block, for conversations that are too long to be one text.
BLOCK_TURNS = 64
#: Tokens that one unit of an attachment expands to: an image patch, a second of audio, a page.
UNIT_TOKENS = {"image": 1, "audio": 25, "document": 600}
#: Characters counted as one token of plain text.
CHARS_PER_TOKEN = 4
PART = "struct<type:string,text:string,ref:string,units:bigint>"

_OPEN, _ROLE_END, _CLOSE = '<turn role="', '">', "</turn>\n"


def escape(text: Column) -> Column:
    out = text
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(written))
    return out


def unescape(text: Column) -> Column:
    out = text
    for raw, written in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(written), F.lit(raw))
    return out


def _parts(df: DataFrame, content: str) -> Column:
    """The content as typed parts; a plain string is one text part, null has none."""
    column = F.col(f"`{content}`")
    if isinstance(df.schema[content].dataType, T.ArrayType):
        return F.coalesce(column, F.expr(f"cast(array() as array<{PART}>)"))
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(column.cast("string"), F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"),
    )
    return F.array(part)


def _kind(part: Column) -> Column:
    """text, image, audio, document, or other for anything else."""
    kind = F.lower(F.coalesce(part["type"], F.lit("other")))
    return F.when(kind.isin("text", *UNIT_TOKENS), kind).otherwise("other")


def _visit(parts: Column) -> tuple[Column, Column, Column]:
    """Written content, attachments in order, and expanded token count of one turn."""
    is_text = lambda p: _kind(p) == "text"
    written = F.transform(
        parts,
        lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<"), _kind(p), F.lit(" "), i.cast("string"), F.lit("/>"))
        ),
    )

    def tokens(p: Column) -> Column:
        units = F.coalesce(p["units"], F.lit(0))
        attached = F.lit(0).cast("bigint")
        for kind, each in UNIT_TOKENS.items():
            attached = F.when(_kind(p) == kind, units * each).otherwise(attached)
        chars = F.length(F.coalesce(p["text"], F.lit("")))
        return F.when(is_text(p), F.ceil(chars / CHARS_PER_TOKEN)).otherwise(attached)

    attached = F.filter(
        F.transform(parts, lambda p, i: F.struct(i.alias("place"), _kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens"))),
        lambda a: a["type"] != "text",
    )
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n + tokens(p))
    return F.array_join(written, ""), attached, total


def format_chat(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", loss_role: str = "assistant", block_turns: int | None = None) -> DataFrame:
    """One row per conversation, or with ``block_turns`` per conversation and block of turn numbers: conversation, part, n_turns, formatted, loss_spans,
    attachments, n_tokens.

    loss_spans are (start, end) in code points of ``formatted``, the end exclusive, one for each turn of
    ``loss_role`` over its content. attachments are (turn, place, type, ref, tokens). Turns stand in the order
    of their number, then role, then content; repeated rows stay. Null turn numbers come first, a null role is
    the empty role, null content is empty, unknown part types leave a placeholder without tokens. An empty table
    gives no rows; other columns of the input play no part.
    """
    written, attached, tokens = _visit(F.col("__parts"))
    turns = (
        df.select(
            F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), _parts(df, content).alias("__parts"),
        )
        .select("conversation", "turn", "role", written.alias("content"), attached.alias("attached"), tokens.alias("tokens"))
        .withColumn("part", F.lit(0).cast("bigint") if block_turns is None else F.floor(F.col("turn") / block_turns))
    )
    blocks = turns.groupBy("conversation", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content", "attached", "tokens"))).alias("turns")
    )
    head = lambda t: F.concat(F.lit(_OPEN), escape(t["role"]), F.lit(_ROLE_END))
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def mask(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(head(t))
        end = start + F.length(t["content"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(_CLOSE)).alias("at"),
            F.when(t["role"] == loss_role, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    return blocks.select(
        "conversation", "part", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(_CLOSE))), "").alias("formatted"),
        F.aggregate("turns", none, mask, lambda done: done["spans"]).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(
            t["turn"].alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"),
        )))).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>, unescaped; placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, _OPEN, -1), F.lit(2), F.greatest(F.size(F.split(formatted, _OPEN, -1)) - 1, F.lit(0)))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, _ROLE_END, 1)).alias("role"),
            unescape(F.substring_index(p.substr(F.instr(p, _ROLE_END) + len(_ROLE_END), F.length(p)), _CLOSE, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["end"] - s["start"])))
