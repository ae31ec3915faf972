"""Layout: page density, boxes, page regions, fonts, pagination, continuation of notes.

Boxes are (x0, y0, x1, y1) in page ratios. Blocks come as (book, page, block, label, x0,
y0, x1, y1, text, font_size, font)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markers import roman_value


def density_risk(pages: DataFrame, ratio: float = 0.3, least: int = 120, neighbours: int = 800) -> DataFrame:
    """Pages (book, page, chars, n_lines) with far less text than both neighbours: characters and
    lines under ``ratio`` of the neighbours' median. First and last pages are never risky."""
    ratio = min(0.95, max(0.05, ratio))
    w = Window.partitionBy("book").orderBy("page")
    near = [F.lag(c).over(w).alias(f"p_{c}") for c in ("chars", "n_lines")] + [F.lead(c).over(w).alias(f"n_{c}") for c in ("chars", "n_lines")]
    rows = pages.select("*", *near)
    few = lambda c: F.col(c) < ratio * (F.col(f"p_{c}") + F.col(f"n_{c}")) / 2
    risky = F.col("p_chars").isNotNull() & F.col("n_chars").isNotNull() & (F.col("chars") >= least) & (F.least("p_chars", "n_chars") >= neighbours) & few("chars") & few("n_lines")
    return rows.select("book", "page", "chars", F.coalesce(risky, F.lit(False)).alias("risky"))


def box_of_points(points: Column) -> Column:
    """Box around an array of points (x, y)."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def union_boxes(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Least box around all boxes of a group that have an area; groups without one are left out."""
    whole = blocks.where("x1 > x0 and y1 > y0")
    return whole.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def page_ratios(box: Column, width: Column, height: Column) -> Column:
    """A box [x0, y0, x1, y1] in pixels, or in thousandths where the page's size is null; null unless it has area."""
    w, h = F.coalesce(width, F.lit(1000.0)), F.coalesce(height, F.lit(1000.0))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    x0, y0, x1, y1 = clip(box[0] / w), clip(box[1] / h), clip(box[2] / w), clip(box[3] / h)
    return F.when((F.size(box) == 4) & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def horizontal_overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Shared width over the lesser width."""
    shared = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    return shared / F.greatest(F.least(a[1] - a[0], b[1] - b[0]), F.lit(1e-9))


def bottom_share(y0: Column, y1: Column, bottom: float = 0.75) -> Column:
    """Share of a box's height that lies below ``bottom``."""
    return F.greatest(F.lit(0.0), y1 - F.greatest(y0, F.lit(bottom))) / F.greatest(y1 - y0, F.lit(1e-9))


def placement(x0: Column, x1: Column) -> Column:
    """full, margins or columns."""
    return (
        F.when(x1 - x0 >= 0.72, "full").when(x1 <= 0.22, "left_margin").when(x0 >= 0.78, "right_margin")
        .when((x0 + x1) / 2 < 0.5, "left_column").otherwise("right_column")
    )


def after_table(blocks: DataFrame, gap: float = 0.035) -> DataFrame:
    """Blocks that follow a table on their page within ``gap``."""
    w = Window.partitionBy("book", "page").orderBy("block")
    near = (F.lag("label").over(w) == "Table") & (F.col("y0") - F.lag("y1").over(w)).between(-gap, gap)
    return blocks.withColumn("after_table", F.coalesce(near, F.lit(False)))


def font_profile(blocks: DataFrame) -> DataFrame:
    """Body size of each book, the size most characters have (of ties, the larger), and the sizes below it that 2 blocks or more have."""
    sizes = blocks.where("font_size is not null").groupBy("book", F.bround("font_size", 1).alias("size")).agg(F.sum(F.char_length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    body = sizes.groupBy("book").agg(F.max(F.struct("chars", "size")).alias("b")).select("book", F.col("b.size").alias("body"))
    notes = sizes.join(body, "book").where("size < body and n >= 2").groupBy("book").agg(F.sort_array(F.collect_set("size"), False).alias("note_sizes"))
    return body.join(notes, "book", "left").select("book", "body", F.coalesce("note_sizes", F.array().cast("array<double>")).alias("note_sizes"))


def tail_tolerance(blocks: DataFrame) -> DataFrame:
    """For each page: 1.5 times the median height of blocks in the lower half, or twice the median of close gaps."""
    w = Window.partitionBy("book", "page").orderBy("y0", "block")
    rows = blocks.where("y0 >= 0.5").withColumn("height", F.col("y1") - F.col("y0")).withColumn("gap", F.col("y0") - F.lag("y1").over(w))
    h = rows.groupBy("book", "page").agg(F.median("height").alias("h"))
    g = rows.join(h, ["book", "page"]).where("gap > 0 and gap <= 4 * h").groupBy("book", "page").agg(F.median("gap").alias("g"))
    return h.join(g, ["book", "page"], "left").select("book", "page", F.greatest(1.5 * F.col("h"), 2 * F.coalesce("g", F.lit(0.0)), F.lit(1e-6)).alias("tolerance"))


def running_headers(blocks: DataFrame, pages: int = 2) -> DataFrame:
    """Signatures of blocks in the top margin on ``pages`` pages or more: (book, signature, n_pages, first_page)."""
    rows = blocks.where("y0 <= 0.15 and y1 - y0 <= 0.06 and label in ('Page-Header', 'Section-Header')").withColumn("signature", T.match_title_key(F.col("text")))
    rows = rows.where(F.char_length("signature").between(5, 120) & ~F.col("text").rlike(r"(?i)^\s*(?:#{1,6}\s*)?(?:chapter|part|kapitel|teil|chapitre)\s+(?:\d+|[ivxlcdm]+)"))
    return rows.select("book", "page", "signature").distinct().groupBy("book", "signature").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page")).where(F.col("n_pages") >= pages)


def edge_furniture(blocks: DataFrame, edge: float = 0.05, pages: int = 2) -> DataFrame:
    """Edge blocks whose text is on ``pages`` pages or more and that aren't on the first of them; numbers stay."""
    rows = blocks.where((F.col("y0") <= edge) | (F.col("y1") >= 1 - edge)).withColumn("signature", T.title_match_key(F.col("text")))
    rows = rows.where((F.char_length("signature").between(1, 160)) & ~F.col("signature").rlike(r"^[0-9ivxlcdm .–-]+$"))
    first = rows.groupBy("book", "signature").agg(F.min("page").alias("first_page"), F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= pages)
    return rows.join(first, ["book", "signature"]).where("page > first_page").select("book", "page", "block", "signature", "first_page")


def pagination(labels: DataFrame) -> DataFrame:
    """Offset of physical from printed page numbers (book, page, printed): the most frequent, of ties the least; confidence by its count."""
    n = labels.select("book", (F.col("page") - F.col("printed")).alias("offset")).groupBy("book", "offset").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("book").agg(F.min(F.struct((-F.col("n")).alias("n"), "offset")).alias("b"))
    return best.select("book", "b.offset", (-F.col("b.n")).alias("n"), F.when(F.col("b.n") <= -3, "high").when(F.col("b.n") <= -2, "medium").otherwise("low").alias("confidence"))


def printed_labels(pages: DataFrame) -> DataFrame:
    """Printed numbers on first and last lines: (book, page, line_no, label, printed, kind)."""
    ls = F.filter(F.transform(T.lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select("book", "page", F.posexplode(ls).alias("i", "line"), F.size(ls).alias("n")).where("i < 2 or i >= n - 2")
    label = F.regexp_extract("line", r"(?i)^[-–— ]*([0-9]{1,4}|[ivxlcdm]{1,12})[-–— ]*$", 1)
    arabic = label.rlike("^[0-9]+$")
    value = F.when(arabic, label.cast("int")).otherwise(roman_value(label))
    return rows.select("book", "page", (F.col("i") + 1).alias("line_no"), label.alias("label"), value.alias("printed"), F.when(arabic, "arabic").otherwise("roman").alias("kind")).where("label != '' and printed is not null")


def numeric_regions(notes: DataFrame, gap: float = 0.045, overlap: float = 0.2, bottom: float = 0.75) -> DataFrame:
    """Runs of notes with consecutive numbers (book, page, block, key, box): next key, at most 3 blocks on, close and above
    one another; of 2 or more, reaching near the bottom. (book, page, region, n, first_key, last_key, box)."""
    w = Window.partitionBy("book", "page").orderBy("block")
    near = (F.col("key") == F.lag("key").over(w) + 1) & (F.col("block") - F.lag("block").over(w) <= 3) & (F.abs(F.col("y0") - F.lag("y1").over(w)) <= gap)
    wide = horizontal_overlap((F.col("x0"), F.col("x1")), (F.lag("x0").over(w), F.lag("x1").over(w))) >= overlap
    rows = notes.withColumn("starts", (~F.coalesce(near & wide, F.lit(False))).cast("int")).withColumn("region", F.sum("starts").over(w))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    found = rows.groupBy("book", "page", "region").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), *box)
    return found.where((F.col("n") >= 2) & (F.col("y1") >= bottom - 0.16))


def note_regions(blocks: DataFrame, gap: float = 0.035, overlap: float = 0.2) -> DataFrame:
    """Neighbouring candidate blocks in one placement, joined: (book, page, region, n, text, box)."""
    w = Window.partitionBy("book", "page").orderBy("block")
    side = placement(F.col("x0"), F.col("x1"))
    rows = blocks.withColumn("side", side)
    linked = (F.col("block") == F.lag("block").over(w) + 1) & (F.col("side") == F.lag("side").over(w)) & (F.abs(F.col("y0") - F.lag("y1").over(w)) <= gap)
    linked = linked & (horizontal_overlap((F.col("x0"), F.col("x1")), (F.lag("x0").over(w), F.lag("x1").over(w))) >= overlap)
    rows = rows.withColumn("starts", (~F.coalesce(linked, F.lit(False))).cast("int")).withColumn("region", F.sum("starts").over(w))
    return rows.groupBy("book", "page", "region").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), "\n").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def same_candidate(a: str, b: str) -> Column:
    """Whether two candidates, columns ``a.*`` and ``b.*``, are one: keys alike and .20 of the lesser height shared, or .60 without keys."""
    shared = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0")))
    part = shared / F.greatest(F.least(F.col(f"{a}.y1") - F.col(f"{a}.y0"), F.col(f"{b}.y1") - F.col(f"{b}.y0")), F.lit(1e-9))
    keyed = F.col(f"{a}.key").isNotNull() & F.col(f"{b}.key").isNotNull()
    return F.when(keyed, (F.col(f"{a}.key") == F.col(f"{b}.key")) & (part >= 0.2)).otherwise(part >= 0.6)


def layout_summary(blocks: DataFrame) -> DataFrame:
    """For each page: blocks, labels with counts, keys of notes in order, range of y and the 20 bins of y that are used."""
    labels = blocks.groupBy("book", "page", "label").agg(F.count(F.lit(1)).alias("n"))
    labels = labels.groupBy("book", "page").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))
    key = F.regexp_extract("text", r"^\s*(?:\[\^?)?([0-9]{1,4})[\].)]", 1)
    rest = blocks.withColumn("key", F.when((F.col("label") == "Footnote") & (key != ""), key)).groupBy("book", "page").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.transform(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("block", "key")))), lambda x: x["key"]).alias("keys"),
        F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.sort_array(F.collect_set(F.least(F.floor(F.col("y0") * 20), F.lit(19)))).alias("bins"),
    )
    return rest.join(labels, ["book", "page"])


def layouts_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """What differs in the summaries of two scans of a page; a diagnosis, not a decision."""
    x, y = a.alias("a"), b.alias("b")
    both = x.join(y, ["book", "page"], "full_outer")
    reasons = F.array_compact(F.array(
        F.when((F.size("a.keys") > 0) != (F.size("b.keys") > 0), "notes in one only"), F.when(F.col("a.keys") != F.col("b.keys"), "keys"), F.when(F.col("a.bins") != F.col("b.bins"), "bins"),
        F.when((F.abs(F.col("a.top") - F.col("b.top")) > 0.1) | (F.abs(F.col("a.bottom") - F.col("b.bottom")) > 0.1), "range"),
        F.when(F.col("a.n_blocks").isNull() | F.col("b.n_blocks").isNull(), "one side only"),
    ))
    return both.select("book", "page", reasons.alias("reasons"))


def ochiai(a: Column, b: Column) -> Column:
    """Shared words over the geometric mean of both counts, for arrays of distinct words."""
    n = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def content_words(c: Column, least: int = 4) -> Column:
    """Distinct lower-case words of ``least`` letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(c), f"[^{T.WORD_CHARS}]+"), lambda w: F.char_length(w) >= least))


def continuation_score(rows: DataFrame) -> DataFrame:
    """Score of each page's first unnumbered note block as a continuation of the last note of the
    page before, from columns p_label, label, p_x0, x0, p_width, width, p_font, font, p_family, family, body_ratio,
    p_open (no sentence end), starts_open (lower case), citation, kind, before_number, number_gap, furniture, inline_review."""
    delta = lambda a, b: F.abs(F.col(a) - F.col(b))
    size = delta("p_font", "font") / F.greatest("p_font", "font")
    score = (
        F.lit(3)
        + F.when(F.col("label") == F.col("p_label"), 2).when(F.col("label").isin("Footnote", "Text"), 1).otherwise(0)
        + F.when(delta("p_x0", "x0") <= 0.03, 2).when(delta("p_x0", "x0") <= 0.08, 1).otherwise(0)
        + F.when(delta("p_width", "width") <= 0.08, 1).otherwise(0)
        + F.when(size <= 0.1, 2).when(size <= 0.2, 1).otherwise(0)
        + F.when(F.col("p_family") == F.col("family"), 1).otherwise(0)
        + F.when(F.col("body_ratio") <= 0.9, 1).when(F.col("body_ratio") >= 0.98, -1).otherwise(0)
        + F.when(F.col("p_open"), 2).otherwise(-4)
        + F.when(F.col("starts_open"), 1).otherwise(0)
        + F.when(F.col("citation"), 3).otherwise(0)
        + F.when(F.col("kind") == "body_strong", -6).when(F.col("kind") == "body", -4).when(F.col("kind") == "footnote", 2).otherwise(0)
        + F.when(F.col("before_number"), 1).otherwise(0)
        + F.when(F.col("number_gap"), 1).otherwise(0)
        + F.when(F.col("furniture"), -5).otherwise(0)
    )
    rows = rows.withColumn("score", score)
    return rows.withColumn("confidence", F.when(F.col("inline_review"), "low").when(F.col("score") >= 9, "high").when(F.col("score") >= 5, "medium").otherwise("low"))


def hypothesis(fragment: Column, body: Column, note: Column, body_open: Column) -> Column:
    """Whether a fragment reads on from the body or from a note: (body_score, note_score, verdict)."""
    words = content_words(fragment)
    b = F.bround(ochiai(words, content_words(body)) + F.when(body_open, 0.04).otherwise(0.0), 3)
    n = F.bround(ochiai(words, content_words(note)), 3)
    verdict = F.when((b >= 0.08) & (b - n >= 0.035), "body").when((n >= 0.08) & (n - b >= 0.035), "note").otherwise("open")
    return F.struct(b.alias("body_score"), n.alias("note_score"), verdict.alias("verdict"))


def windows_across(candidates: DataFrame) -> DataFrame:
    """Neighbouring pages that both have candidates: (book, page, next_page)."""
    p = candidates.select("book", "page").distinct()
    return p.join(p.select("book", (F.col("page") - 1).alias("page")), ["book", "page"], "left_semi").select("book", "page", (F.col("page") + 1).alias("next_page"))


def linked_chains(links: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive pages that one note covers (book, key, page): (book, key, first_page, last_page, n)."""
    w = Window.partitionBy("book", "key").orderBy("page")
    rows = links.select("book", "key", "page").distinct().withColumn("run", F.col("page") - F.row_number().over(w))
    out = rows.groupBy("book", "key", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least).drop("run")


def illustration_pages(blocks: DataFrame, area: float = 0.55, chars: int = 180) -> DataFrame:
    """Pages that are an illustration: a large one, one with little text, one alone, or a blank page."""
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    visual = F.col("label").isin("Picture", "Figure", "Image")
    p = blocks.groupBy("book", "page").agg(
        F.coalesce(F.max(F.when(visual, own)), F.lit(0.0)).alias("largest"), F.count_if(visual).alias("n_visual"),
        F.coalesce(F.sum(F.when(~visual, F.char_length(F.trim("text")))), F.lit(0)).alias("chars"), F.bool_or(F.col("label") == "Blank-Page").alias("blank"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("largest") >= area, "large"), F.when((F.col("n_visual") > 0) & (F.col("chars") <= chars), "little text"), F.when((F.col("n_visual") > 0) & (F.col("chars") == 0), "alone"), F.when(F.col("blank"), "blank")))
    return p.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def excluded_blocks(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Blocks on pages of typed units (book, first, last, type). Units are spread over their pages, so that it is an equi-join."""
    pages = units.select("book", "type", F.explode(F.sequence("first", "last")).alias("page"))
    return blocks.join(pages.groupBy("book", "page").agg(F.min("type").alias("type")), ["book", "page"]).select("book", "page", "block", "type")


def text_layer(pages: DataFrame) -> DataFrame:
    """Kind of a book's text layer from (book, chars, fonts, image_share): native, mixed or scanned."""
    p = pages.groupBy("book").agg(F.median("chars").alias("chars"), F.avg((F.col("fonts") > 0).cast("int")).alias("with_fonts"), F.avg((F.col("image_share") >= 0.8).cast("int")).alias("images"))
    kind = F.when((F.col("chars") < 50) | (F.col("with_fonts") < 0.2), "scanned_or_low_text").when(F.col("images") >= 0.5, "searchable_ocr_or_mixed").otherwise("native_text")
    return p.withColumn("kind", kind)
