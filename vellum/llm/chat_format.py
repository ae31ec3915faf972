"""Chat formatting with typed content parts; DataFrame functions only.

A conversation's turns become one string. Each turn is ``<|im_start|>`` role newline
content ``<|im_end|>`` newline. A turn's content is an array of typed parts, which a
visitor flattens in order: text parts give their text, image, audio and document parts a
placeholder ``<|image|>``, ``<|audio|>`` or ``<|document|>`` and an entry in
``attachments`` (turn, place, kind, reference, expanded tokens). Control strings inside
roles and texts are escaped reversibly: ``&`` becomes ``&amp;``, ``<|`` ``&lt;|``, and in roles
also newline ``&#10;``. ``loss_spans`` gives start and end, in code points of the
formatted string, of each assistant turn's content.

Cases: null texts count as empty, null roles too; a null or empty part list is an empty
content; a part of a null or unknown kind counts as text; turns with equal numbers are ordered by role, then text; repeated rows
are turns of their own; a conversation's turns are gathered into one row, as its result
is one string; null conversation ids form one conversation; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PART = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escaped(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(out, F.lit("\n"), F.lit("&#10;")) if role else out


def unescaped(c: Column, role: bool = False) -> Column:
    if role:
        c = F.replace(c, F.lit("&#10;"), F.lit("\n"))
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    )


def visited(parts: Column) -> Column:
    """The content string of a list of parts."""
    def one(p: Column) -> Column:
        return F.when(p["kind"].isin(*KINDS), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escaped(p["text"]))

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(PART)), one), "")


def attachments(turns: Column) -> Column:
    """References to the parts that aren't text, in order, with the tokens they stand for."""
    def of(t: Column) -> Column:
        others = F.filter(F.coalesce(t["parts"], F.array().cast(PART)), lambda p: F.coalesce(p["kind"].isin(*KINDS), F.lit(False)))
        return F.transform(others, lambda p, i: F.struct(t["turn"].alias("turn"), i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).alias("tokens")))

    return F.flatten(F.transform(turns, of))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row for each conversation: conv, n_turns, formatted, loss_spans, attachments,
    expanded_tokens (of all attachments)."""
    rows = df.select(
        col(conv).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), col(parts).cast(PART).alias("parts")
    ).withColumn("content", visited(F.col("parts")))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "parts"))).alias("turns"))
    marked = turns.select(
        "conv", "turns",
        F.transform("turns", lambda t: F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n"), t["content"], F.lit(END), F.lit("\n"))).alias("pieces"),
    )
    ends = F.aggregate(
        "pieces", F.array(F.lit(0).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(p)))
    )
    # running ends grow as an array, a conversation has few turns; its texts are not copied
    spans = F.transform(
        "turns",
        lambda t, i: F.struct(
            (F.get("ends", i + 1) - len(END) - 1 - F.char_length(t["content"])).alias("start"), (F.get("ends", i + 1) - len(END) - 1).alias("end"), t["role"].alias("role")
        ),
    )
    listed = attachments(F.col("turns"))
    return marked.withColumn("ends", ends).select(
        "conv", F.size("turns").cast("long").alias("n_turns"), F.array_join("pieces", "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"),
        listed.alias("attachments"), F.aggregate(listed, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def read_back(formatted: Column) -> Column:
    """Turns (role, content still escaped) of a formatted string, in order."""
    roles, contents = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, contents, lambda r, c: F.struct(unescaped(r, True).alias("role"), c.alias("content")))


def lost(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
