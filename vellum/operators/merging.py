"""Joining pages into units: soft page breaks, repeated headers, boundaries, carry-over, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters that end a sentence, and what may follow them.
ENDS = r"[.!?。！？…:：;；][\"'”’»」』）)\]]*\s*$"
BLOCK_START = r"^\s*(?:#{1,6}\s|[-*+]\s|\d{1,3}[.)]\s|>|\||```|!\[|\[\^|<)"


def joins_next(tail: Column, head: Column) -> Column:
    """Whether a page's last line reads on in the next page's first line."""
    return F.coalesce((F.trim(tail) != "") & (F.trim(head) != "") & ~tail.rlike(ENDS) & ~tail.rlike(r"^\s*(?:#{1,6}\s|\|)") & ~head.rlike(BLOCK_START), F.lit(False))


def separator(tail: Column, head: Column) -> Column:
    """Nothing after a hyphen, before closing punctuation and between CJK characters; else a space."""
    cjk = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
    return F.when(tail.rlike(r"[-‐‑]\s*$") | head.rlike(r"^\s*[,.;:!?)\]»”’、。，；：！？]") | (tail.rlike(cjk + r"\s*$") & head.rlike(r"^\s*" + cjk)), "").otherwise(" ")


def edges(pages: DataFrame) -> DataFrame:
    """(book, page, text) with the first and last line that has text."""
    ls = F.filter(T.lines(F.col("text")), lambda x: F.trim(x) != "")
    return pages.select("book", "page", "text", F.get(ls, F.lit(0)).alias("head"), F.when(F.size(ls) > 0, F.element_at(ls, -1)).alias("tail"))


def soft_joins(pages: DataFrame) -> DataFrame:
    """(book, page, next_page, sep) of neighbouring pages that join."""
    w = Window.partitionBy("book").orderBy("page")
    rows = edges(pages).select("book", "page", "tail", F.lead("page").over(w).alias("next_page"), F.lead("head").over(w).alias("next_head"))
    return rows.where(joins_next(F.col("tail"), F.col("next_head"))).select("book", "page", "next_page", separator(F.col("tail"), F.col("next_head")).alias("sep"))


def boundary_preview(pages: DataFrame, n: int = 40) -> DataFrame:
    """Suspicious boundaries with the ends of both pages and a severity."""
    w = Window.partitionBy("book").orderBy("page")
    rows = edges(pages).select("book", "page", "tail", F.lead("head").over(w).alias("next_head"))
    hyphen, lower = F.col("tail").rlike(r"\p{L}[-‐‑]\s*$"), F.col("next_head").rlike(r"^\s*\p{Ll}")
    severity = F.when(hyphen & lower, "high").when(lower, "medium").otherwise("low")
    return rows.where(joins_next(F.col("tail"), F.col("next_head"))).select("book", "page", F.expr(f"right(tail, {n})").alias("tail"), F.substring("next_head", 1, n).alias("head"), severity.alias("severity"))


def merged(pages: DataFrame) -> DataFrame:
    """Runs of pages that join, as one text each: (book, first_page, last_page, n_pages, text). Runs are numbered
    over narrow rows; the texts of one run, not of a book, meet in a row."""
    w = Window.partitionBy("book").orderBy("page")
    rows = edges(pages).select("book", "page", "text", "head", F.lag("tail").over(w).alias("p_tail"))
    on = joins_next(F.col("p_tail"), F.col("head"))
    rows = rows.withColumn("sep", F.when(on, separator(F.col("p_tail"), F.col("head")))).withColumn("starts", (~on).cast("long"))
    rows = rows.withColumn("run", F.sum("starts").over(w))
    parts = F.sort_array(F.collect_list(F.struct("page", F.coalesce("sep", F.lit("")).alias("sep"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))))
    return rows.groupBy("book", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n_pages"), parts.alias("parts")).select(
        "book", "first_page", "last_page", "n_pages", F.array_join(F.transform("parts", lambda p: F.concat(p["sep"], p["text"])), "").alias("text")
    )


def leading_heading(text: Column) -> Column:
    """Second- or third-level heading that is the first text within 6 lines; else null."""
    first = F.get(F.filter(F.slice(T.lines(text), 1, 6), lambda x: F.trim(x) != ""), F.lit(0))
    return F.when(first.rlike(r"^#{2,3}\s+\S"), first)


def repeated_headers_removed(pages: DataFrame) -> DataFrame:
    """Pages whose leading heading is that of the page before lose it. Headings are compared as they
    came, so a header over three pages goes from the second and the third."""
    w = Window.partitionBy("book").orderBy("page")
    rows = pages.select("book", "page", "text", T.heading_key(leading_heading(F.col("text"))).alias("key"), leading_heading(F.col("text")).isNotNull().alias("has"))
    same = F.coalesce(F.col("has") & F.lag("has").over(w) & (F.col("key") == F.lag("key").over(w)), F.lit(False))
    return rows.withColumn("removed", same).select("book", "page", "removed", F.when(F.col("removed"), F.regexp_replace("text", r"\A\s*#{2,3}[^\n]*\n?", "")).otherwise(F.col("text")).alias("text"))


def unit_boundaries(units: DataFrame) -> DataFrame:
    """(book, unit, first_page, last_page, first_line, last_line): a unit followed on the next page below its first line
    reaches into that page, up to that line; an end that is set stays."""
    w = Window.partitionBy("book").orderBy("unit")
    nxt = F.lead("first_page").over(w), F.lead("first_line").over(w)
    reaches = F.coalesce((nxt[1] > 1) & (nxt[0] - F.col("last_page")).isin(0, 1) & F.col("last_line").isNull(), F.lit(False))
    rows = units.withColumn("n_page", nxt[0]).withColumn("n_line", nxt[1]).withColumn("reaches", reaches)
    return rows.select("book", "unit", "first_page", F.when(F.col("reaches"), F.col("n_page")).otherwise(F.col("last_page")).alias("last_page"), "first_line", F.when(F.col("reaches"), F.col("n_line")).otherwise(F.col("last_line")).alias("last_line"))


def unit_texts(units: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (book, page, line_no, line) of each unit's pages, cut at its first and last line: (book, unit, n_lines, text)."""
    pages = units.select("book", "unit", "first_page", "last_page", "first_line", "last_line", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    rows = lines.join(pages, ["book", "page"])
    inside = ((F.col("page") > F.col("first_page")) | (F.col("line_no") >= F.coalesce("first_line", F.lit(1)))) & ((F.col("page") < F.col("last_page")) | F.col("last_line").isNull() | (F.col("line_no") < F.col("last_line")))
    parts = F.sort_array(F.collect_list(F.struct("page", "line_no", "line")))
    return rows.where(inside).groupBy("book", "unit").agg(F.count(F.lit(1)).alias("n_lines"), parts.alias("p")).select("book", "unit", "n_lines", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))


def carryover_moved(units: DataFrame) -> DataFrame:
    """Text before a unit's first heading goes to the end of the unit before, ahead of that unit's notes: (book, unit, text)."""
    lead = F.regexp_extract("text", r"(?s)\A(.*?)(?=^#{1,6}\s|\z)".replace("(?s)", "(?sm)"), 1)
    w = Window.partitionBy("book").orderBy("unit")
    rows = units.withColumn("carry", F.when((F.row_number().over(w) > 1) & F.col("text").rlike(r"(?m)^#{1,6}\s"), lead).otherwise(F.lit("")))
    rows = rows.withColumn("own", F.expr("substring(text, char_length(carry) + 1)")).withColumn("gets", F.coalesce(F.regexp_replace(F.lead("carry").over(w), r"^\s+|\s+$", ""), F.lit("")))
    at = F.when(F.col("gets") == "", F.col("own")).when(F.col("own").rlike(r"(?m)^\[\^[^\]\n]+\]:"), F.regexp_replace("own", r"(?sm)\A(.*?)(^\[\^[^\]\n]+\]:.*)\z", "$1\u0000$2"))
    text = F.when(F.col("gets") == "", F.col("own")).when(at.isNotNull(), F.replace(at, F.lit("\u0000"), F.concat("gets", F.lit("\n\n")))).otherwise(F.concat("own", F.lit("\n\n"), "gets"))
    return rows.select("book", "unit", text.alias("text"))


def combined(parts: DataFrame) -> DataFrame:
    """One Markdown text for each book from (book, position, text), in order of position."""
    return parts.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("p")).select("book", F.array_join(F.transform("p", lambda x: F.trim(x["text"])), "\n\n").alias("text"))
