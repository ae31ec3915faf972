"""Tables of contents as path tables: (book, node_id, parent_id, path ARRAY<INT>, title, first, last).

A path has the 1-based place at each level, so arrays sort in preorder and a prefix is an ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def paths(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Paths of nodes (book, node_id, parent_id, position): roots first, then level by level. A level is a join; the
    number of joins is the depth, and a node that no root reaches is left out."""
    w = Window.partitionBy("book", "parent_id").orderBy("position", "node_id")
    placed = edges.withColumn("nth", F.row_number().over(w).cast("int"))
    level = placed.where("parent_id is null").select("book", "node_id", F.array("nth").alias("path"))
    out = level
    for _ in range(rounds):
        up = level.select(F.col("book").alias("b"), F.col("node_id").alias("p"), F.col("path").alias("above"))
        level = placed.join(up, (F.col("book") == F.col("b")) & (F.col("parent_id") == F.col("p"))).select("book", "node_id", F.concat("above", F.array("nth")).alias("path"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {rounds} levels, or a circle")


def prefixes(path: Column) -> Column:
    """All ancestors' paths, longest last, without the path itself."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, 1, n))).otherwise(F.array().cast("array<array<int>>"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select("book", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), ["book", "node_id"], "left_anti")


def identity_errors(nodes: DataFrame) -> DataFrame:
    """(book, node_id, problem): ids that are missing or come twice."""
    n = nodes.groupBy("book", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("problem", F.when(F.col("node_id").isNull(), "missing").when(F.col("n") > 1, "duplicate")).where("problem is not null").select("book", "node_id", "problem")


def anchor(node_id: Column, title: Column, given: Column) -> Column:
    """A given anchor, or the title's slug with the start of the id's digest."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(T.collapsed(title)), f"[^{T.WORD_CHARS}]+", "-"), "^-+|-+$", "")
    return F.coalesce(given, F.concat(F.when(slug == "", "node").otherwise(F.substring(slug, 1, 40)), F.lit("-"), F.substring(F.sha2(node_id.cast("binary"), 256), 1, 8)))


def owners(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """File of each node: its own unit, else that of the longest ancestor with one, else that of the least
    descendant with one: (book, path, owner, rule). Prefixes are exploded, so that all are equi-joins."""
    u = units.select("book", F.col("path").alias("up"), "file")
    up = nodes.select("book", "path", F.explode(F.concat(prefixes(F.col("path")), F.array("path"))).alias("up")).join(u, ["book", "up"])
    above = up.groupBy("book", "path").agg(F.max_by("file", F.size("up")).alias("above"), F.max(F.size("up")).alias("depth"))
    down = u.select("book", F.explode(prefixes(F.col("up"))).alias("path"), "up", "file").groupBy("book", "path").agg(F.min_by("file", "up").alias("below"))
    rows = nodes.select("book", "path").join(above, ["book", "path"], "left").join(down, ["book", "path"], "left")
    rule = F.when(F.col("depth") == F.size("path"), "own").when(F.col("above").isNotNull(), "ancestor").when(F.col("below").isNotNull(), "descendant").otherwise("none")
    return rows.select("book", "path", F.coalesce("above", "below").alias("owner"), rule.alias("rule"))


def units_at(nodes: DataFrame, depth: int) -> DataFrame:
    """Units of ``depth`` levels: (book, path, first, last, n_nodes)."""
    rows = nodes.withColumn("unit", F.slice("path", 1, depth))
    return rows.groupBy("book", "unit").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n_nodes")).withColumnRenamed("unit", "path")


def gaps(nodes: DataFrame) -> DataFrame:
    """Pages of parents that no child covers: (book, path, gap_first, gap_last). Children are swept in order."""
    kids = nodes.where(F.size("path") > 1).select("book", F.expr("slice(path, 1, size(path) - 1)").alias("path"), F.col("first").alias("f"), F.col("last").alias("l"))
    rows = nodes.select("book", "path", "first", "last").join(kids, ["book", "path"])
    w = Window.partitionBy("book", "path").orderBy("f", "l")
    before = F.coalesce(F.max("l").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("first") - 1)
    inner = rows.withColumn("gap_first", before + 1).withColumn("gap_last", F.col("f") - 1).select("book", "path", "gap_first", "gap_last")
    end = rows.groupBy("book", "path", "last").agg((F.max("l") + 1).alias("gap_first")).select("book", "path", "gap_first", F.col("last").alias("gap_last"))
    return inner.unionByName(end).where("gap_first <= gap_last")


def range_errors(nodes: DataFrame) -> DataFrame:
    """(book, path, problem): inverted ranges, children outside parents, siblings that overlap or go back."""
    w = Window.partitionBy("book", F.expr("slice(path, 1, size(path) - 1)")).orderBy("path")
    up = nodes.select("book", F.col("path").alias("parent"), F.col("first").alias("pf"), F.col("last").alias("pl"))
    rows = nodes.select("book", "path", "first", "last", F.lag("first").over(w).alias("s_first"), F.lag("last").over(w).alias("s_last"), F.expr("slice(path, 1, size(path) - 1)").alias("parent")).join(up, ["book", "parent"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("last") < F.col("first"), "inverted"), F.when((F.col("first") < F.col("pf")) | (F.col("last") > F.col("pl")), "outside parent"),
        F.when(F.col("first") < F.col("s_first"), "goes back"), F.when(F.col("first") < F.col("s_last"), "overlap"),
    ))
    return rows.select("book", "path", F.explode(found).alias("problem"))


def navigation(nodes: DataFrame) -> DataFrame:
    """Nodes without hidden ones; their children take their place: (book, node_id, path, depth). ``path`` is the old one, which
    still sorts in preorder; ``depth`` leaves hidden ancestors out, added up through exploded prefixes."""
    hidden = nodes.where("hidden").select("book", F.col("path").alias("up"))
    rows = nodes.where("not hidden").select("book", "node_id", "path")
    lost = rows.select("book", "path", F.explode(prefixes(F.col("path"))).alias("up")).join(hidden, ["book", "up"]).groupBy("book", "path").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(lost, ["book", "path"], "left").select("book", "node_id", "path", (F.size("path") - F.coalesce("n", F.lit(0))).cast("int").alias("depth"))


def renumbered(nodes: DataFrame) -> DataFrame:
    """``navigation`` with the visible parent and the place among its children: (book, node_id, parent_id, position, path, depth).
    The parent is the longest visible prefix; siblings are numbered in preorder, and their paths follow by ``paths``."""
    shown = navigation(nodes)
    up = shown.select("book", "node_id", F.explode(prefixes(F.col("path"))).alias("up"))
    over = up.join(shown.select("book", F.col("path").alias("up"), F.col("node_id").alias("p")), ["book", "up"])
    parent = over.groupBy("book", "node_id").agg(F.max_by("p", F.size("up")).alias("parent_id"))
    placed = shown.join(parent, ["book", "node_id"], "left")
    return placed.withColumn("position", F.row_number().over(Window.partitionBy("book", "parent_id").orderBy("path")).cast("long")).select("book", "node_id", "parent_id", "position", "path", "depth")


def depth(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("book").agg(F.max(F.size("path")).alias("depth"), F.count(F.lit(1)).alias("n_nodes"))


def same_tree(a: DataFrame, b: DataFrame) -> DataFrame:
    """(book, node_id, problem) where two trees don't have the same ids at the same paths."""
    x, y = a.select("book", "node_id", F.col("path").alias("p")), b.select("book", "node_id", F.col("path").alias("q"))
    both = x.join(y, ["book", "node_id"], "full_outer")
    return both.withColumn("problem", F.when(F.col("q").isNull(), "missing").when(F.col("p").isNull(), "added").when(F.col("p") != F.col("q"), "moved")).where("problem is not null").select("book", "node_id", "problem")


def scope_of_lines(lines: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scope of each line (unit, line_no): the one (unit, scope, first_line) that starts last at or before it. Scopes and lines
    are put in one order and the last scope seen is carried forward, instead of a join on a range."""
    rows = lines.select("unit", "line_no", F.lit(None).cast("string").alias("scope"), F.lit(1).alias("kind")).unionByName(scopes.select("unit", F.col("first_line").alias("line_no"), F.col("scope").cast("string"), F.lit(0).alias("kind")))
    w = Window.partitionBy("unit").orderBy("line_no", "kind", "scope").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("in_scope", F.last("scope", True).over(w)).where("kind = 1").select("unit", "line_no", F.col("in_scope").alias("scope"))


def titled(scopes: DataFrame, headings: DataFrame) -> DataFrame:
    """Scopes (book, scope, title) and headings (book, heading, title) that share a variant of a title: (book, scope, heading, status),
    unmatched and ambiguous ones included."""
    s = scopes.select("book", "scope", F.explode(T.title_variants(F.col("title"))).alias("key")).distinct()
    h = headings.select("book", "heading", F.explode(T.title_variants(F.col("title"))).alias("key")).distinct()
    pairs = s.join(h, ["book", "key"]).select("book", "scope", "heading").distinct()
    n = pairs.groupBy("book", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("heading").alias("heading"))
    rows = scopes.select("book", "scope").join(n, ["book", "scope"], "left")
    return rows.select("book", "scope", F.when(F.col("n") == 1, F.col("heading")).alias("heading"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("status"))


def outline(nodes: DataFrame, budget: int) -> DataFrame:
    """Deepest level whose titles, all above included, fit a budget of estimated tokens: (book, depth)."""
    rows = nodes.select("book", F.size("path").alias("depth"), T.estimated_tokens(F.col("title")).alias("tokens")).groupBy("book", "depth").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy("book").orderBy("depth"))
    return rows.withColumn("so_far", running).where(F.col("so_far") <= budget).groupBy("book").agg(F.max("depth").alias("depth"))


def tokens_of_nodes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Estimated tokens of the pages (book, page, tokens) of each node; ranges are two prefix sums, not a join on a range."""
    w = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    sums = pages.groupBy("book", "page").agg(F.sum("tokens").alias("tokens")).withColumn("upto", F.sum("tokens").over(w)).select("book", "page", "upto")
    marks = nodes.select("book", "path", (F.col("first") - 1).alias("page"), F.lit(-1).alias("sign")).unionByName(nodes.select("book", "path", F.col("last").alias("page"), F.lit(1).alias("sign")))
    both = marks.select("book", "page", "path", "sign", F.lit(None).cast("long").alias("upto")).unionByName(sums.select("book", "page", F.lit(None).cast("array<int>").alias("path"), F.lit(0).alias("sign"), "upto"))
    w2 = Window.partitionBy("book").orderBy("page", F.col("path").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("v", F.coalesce(F.last("upto", True).over(w2), F.lit(0).cast("long"))).where("path is not null")
    return filled.groupBy("book", "path").agg(F.sum(F.col("sign") * F.col("v")).cast("long").alias("tokens"))


def ncx(nodes: DataFrame) -> DataFrame:
    """Navigation points of a book in preorder as one XML text; depth goes by nesting of the path."""
    esc = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    w = Window.partitionBy("book").orderBy("path")
    nxt = F.coalesce(F.size(F.lead("path").over(w)), F.lit(1))
    order = F.row_number().over(w)
    point = F.concat(F.lit('<navPoint id="n'), order.cast("string"), F.lit('" playOrder="'), order.cast("string"), F.lit('"><navLabel><text>'), esc, F.lit('</text></navLabel><content src="'), F.col("href"), F.lit('"/>'))
    rows = nodes.select("book", "path", F.concat(point, F.repeat(F.lit("</navPoint>"), F.greatest(F.lit(0), F.size("path") - nxt + 1).cast("int"))).alias("x"))
    whole = rows.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("path", "x"))).alias("p"), F.max(F.size("path")).alias("depth"))
    return whole.select("book", F.concat(F.lit("<navMap>"), F.array_join(F.transform("p", lambda p: p["x"]), ""), F.lit("</navMap>")).alias("ncx"), "depth")


def html_list(nodes: DataFrame) -> DataFrame:
    """Navigation of a book (path, title, href) as nested HTML lists in preorder: (book, html). A node opens a list if the next one lies
    deeper, and closes as many as the next one lies higher."""
    def esc(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    own, nxt = F.size("path"), F.coalesce(F.size(F.lead("path").over(Window.partitionBy("book").orderBy("path"))), F.lit(1))
    item = F.concat(F.lit('<li><a href="'), esc(F.col("href")), F.lit('">'), esc(F.col("title")), F.lit("</a>"))
    end = F.when(nxt > own, F.lit("<ul>")).otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ul></li>"), F.greatest(F.lit(0), own - nxt))))
    rows = nodes.select("book", "path", F.concat(item, end).alias("x"))
    whole = rows.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("path", "x"))).alias("p"))
    return whole.select("book", F.concat(F.lit("<ul>"), F.array_join(F.transform("p", lambda p: p["x"]), ""), F.lit("</ul>")).alias("html"))


HEADING_LIKE = r"(?i)^\s*(?:#{1,6}\s+|\*\*?[^*]+\*\*?|__?[^_]+__?|<(?:em|i)\b|(?:chapter|part|book|volume|section)\s+)"


def title_at(lines: Column, start: Column, end: Column, title: Column, anchor_line: Column | None = None) -> Column:
    """Whether the title stands at the anchor (the start if not given) of the lines from ``start`` to before ``end``, 1-based: as the first line with
    text, or as the first headings of the run of headings there. Later lines prove nothing."""
    at = start if anchor_line is None else F.coalesce(anchor_line, start)
    rows = F.filter(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.greatest(end - at, F.lit(0)).cast("int")), lambda x: F.trim(x) != "")
    others = F.array_position(F.transform(rows, lambda x: ~x.rlike(HEADING_LIKE)), True)
    run = F.transform(F.when(others > 0, F.slice(rows, F.lit(1), (others - 1).cast("int"))).otherwise(rows), lambda x: F.trim(F.regexp_replace(x, r"^\s*#{1,6}\s*", "")))
    target = T.toc_label(title)
    joined = F.exists(F.transform(run, lambda _, i: F.slice(run, F.lit(1), i + 1)), lambda part: T.toc_label(F.array_join(part, " ")) == target)
    plain = (others == 1) & (T.toc_label(F.get(rows, F.lit(0))) == target)
    return F.coalesce((start >= 1) & (end > start) & at.between(start, end) & (target != "") & (joined | plain), F.lit(False))
