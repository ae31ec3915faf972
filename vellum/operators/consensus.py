"""Two scans of the same pages compared; what differs too much goes to review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markers import numbers
from ..functions.udfs import compared, nfkc


def compare(pages: DataFrame, most_ratio: float = 0.08, least_changed: int = 2, line_delta: int = 0) -> DataFrame:
    """(book, page, status, reasons, ratio, changed) of (book, page, primary, secondary). Reasons: an empty side, numbers of lines
    or the numbers in the texts that differ, or a share of edits above ``most_ratio`` with ``least_changed`` characters changed.
    Equal texts are settled in SQL; only the others reach the sequence matcher."""
    p, s = T.comparable(F.col("a")), T.comparable(F.col("b"))
    filled = lambda c: F.size(F.filter(T.lines(F.col(c)), lambda x: F.trim(x) != ""))
    rows = pages.select("book", "page", nfkc("primary").alias("a"), nfkc("secondary").alias("b"), filled("primary").alias("la"), filled("secondary").alias("lb"))
    rows = rows.select("book", "page", "la", "lb", p.alias("a"), s.alias("b"))
    same = rows.where("a = b").withColumn("d", F.struct(F.lit(1.0).alias("ratio"), F.lit(0).cast("long").alias("changed")))
    rows = same.unionByName(rows.where("a != b").withColumn("d", compared("a", "b")))
    ratio = F.bround(1 - F.col("d.ratio"), 6)
    empty = (F.col("a") == "") | (F.col("b") == "")
    reasons = F.when(empty, F.array(F.lit("empty"))).otherwise(
        F.array_compact(F.array(
            F.when(F.abs(F.col("la") - F.col("lb")) > line_delta, "lines"), F.when(numbers(F.col("a")) != numbers(F.col("b")), "numbers"),
            F.when((F.col("d.changed") >= least_changed) & (1 - F.col("d.ratio") > most_ratio), "text"),
        ))
    )
    out = rows.withColumn("reasons", reasons)
    return out.select("book", "page", F.when(F.size("reasons") > 0, "review_required").otherwise("agree").alias("status"), "reasons", ratio.alias("ratio"), F.col("d.changed").alias("changed"))


def duplicate_titles(headings: DataFrame, near: int = 5, least: float = 0.8) -> DataFrame:
    """Second-level headings (unit, line_no, level, title) within ``near`` lines of a first-level one that say the same, and headings equal to
    the one before of their level."""
    from pyspark.sql import Window

    w = Window.partitionBy("unit").orderBy("line_no")
    rows = headings.withColumn("p_line", F.lag("line_no").over(w)).withColumn("p_level", F.lag("level").over(w)).withColumn("p_title", F.lag("title").over(w))
    close = rows.where("p_level = 1 and level = 2 and line_no - p_line <= %d" % near).withColumn("ratio", compared(F.lower("title"), F.lower("p_title"))["ratio"])
    again = rows.where("level = p_level and title = p_title")
    return close.where(F.col("ratio") > least).select("unit", "line_no").unionByName(again.select("unit", "line_no")).distinct()
