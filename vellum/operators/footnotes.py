"""Notes: references and definitions, their pairing, numbering, boundaries and link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KEY = r"[A-Za-z0-9_-]+"


def visible(text: Column) -> Column:
    """Text without code and comments; line breaks stay."""
    blank = lambda c, p: F.regexp_replace(c, p, "")
    return blank(blank(blank(F.coalesce(text, F.lit("")), r"(?s)```.*?(?:```|\z)"), r"(?s)<!--.*?-->"), r"`[^`\n]*`")


def scan(files: DataFrame) -> DataFrame:
    """Occurrences (file, kind, key, line_no, place, content) in files (file, text): kind is ref or def; a number with a
    letter n, as 197n67, stands for the note."""
    rows = files.select("file", F.posexplode(T.lines(visible(F.col("text")))).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    definition = F.regexp_extract("line", rf"^\s{{0,3}}\[\^({KEY})\]:", 1)
    rows = rows.withColumn("def", definition).withColumn("rest", F.when(definition != "", F.regexp_replace("line", rf"^\s{{0,3}}\[\^{KEY}\]:", "")).otherwise(F.col("line")))
    key = lambda k: F.regexp_replace(k, r"^[0-9]+n(?=[0-9]+$)", "")
    defs = rows.where("def != ''").select("file", F.lit("def").alias("kind"), key(F.col("def")).alias("key"), "line_no", F.lit(0).alias("place"), F.trim("rest").alias("content"))
    refs = rows.select("file", "line_no", F.posexplode(F.regexp_extract_all("rest", F.lit(rf"\[\^({KEY})\](?!:)"), F.lit(1))).alias("place", "k"))
    return defs.unionByName(refs.select("file", F.lit("ref").alias("kind"), key(F.col("k")).alias("key"), "line_no", (F.col("place") + 1).alias("place"), F.lit(None).cast("string").alias("content")))


def occurrences(marks: DataFrame, by: list[str]) -> DataFrame:
    """Numbers marks of one kind and key within ``by``."""
    return marks.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "kind", "key").orderBy("file", "line_no", "place")))


def pairs(marks: DataFrame) -> DataFrame:
    """Reference to definition, per scope and key: one definition is shared by all references, else the n-th goes to the n-th;
    what is left over is linked to nothing, unless the scope has no definition of the key at all: then definitions of scopes
    without references of that key serve in order. (scope, key, nth, file, line_no, def_file, def_line, via)."""
    rows = occurrences(marks, ["book", "scope"])
    refs = rows.where("kind = 'ref'").select("book", "scope", "key", "nth", "file", "line_no")
    defs = rows.where("kind = 'def'").select("book", "scope", "key", F.col("nth").alias("d"), F.col("file").alias("def_file"), F.col("line_no").alias("def_line"))
    n_defs = defs.groupBy("book", "scope", "key").agg(F.count(F.lit(1)).alias("n_defs"))
    local = refs.join(n_defs, ["book", "scope", "key"], "left").withColumn("d", F.when(F.col("n_defs") == 1, 1).when(F.col("n_defs").isNotNull(), F.col("nth")))
    linked = local.join(defs, ["book", "scope", "key", "d"], "left")
    free = defs.join(refs.select("book", "scope", "key").distinct(), ["book", "scope", "key"], "left_anti")
    w = Window.partitionBy("book", "key").orderBy("def_file", "def_line")
    free = free.withColumn("g", F.row_number().over(w)).select("book", "key", "g", F.col("def_file").alias("g_file"), F.col("def_line").alias("g_line"))
    orphan = F.col("n_defs").isNull()
    linked = linked.withColumn("g", F.when(orphan, F.row_number().over(Window.partitionBy("book", "key", orphan).orderBy("file", "line_no", "nth"))))
    out = linked.join(free, ["book", "key", "g"], "left")
    via = F.when(F.col("def_file").isNotNull(), F.when(F.col("n_defs") == 1, "shared").otherwise("ordinal")).when(F.col("g_file").isNotNull(), "global").otherwise("none")
    return out.select("book", "scope", "key", "nth", "file", "line_no", F.coalesce("def_file", "g_file").alias("def_file"), F.coalesce("def_line", "g_line").alias("def_line"), via.alias("via"))


def graph(marks: DataFrame) -> DataFrame:
    """Broken links (book, key, problem): references without definition, definitions without reference, definitions that come twice."""
    n = marks.groupBy("book", "key").agg(F.count_if(F.col("kind") == "ref").alias("refs"), F.count_if(F.col("kind") == "def").alias("defs"))
    return n.select("book", "key", F.explode(F.array_compact(F.array(F.when(F.col("defs") == 0, "no definition"), F.when(F.col("refs") == 0, "no reference"), F.when(F.col("defs") > 1, "defined twice")))).alias("problem"))


def style(marks: DataFrame) -> DataFrame:
    """GLOBAL where a file of definitions only (no references, or over 10 keys and 3 times as many as references) serves files of references only, under
    a tenth of the keys has no partner and no key two definitions; else LOCAL: (book, style)."""
    per = marks.groupBy("book", "file").agg(F.count_if(F.col("kind") == "ref").alias("refs"), F.countDistinct(F.when(F.col("kind") == "def", F.col("key"))).alias("defs"))
    shape = per.groupBy("book").agg(F.bool_or((F.col("defs") > 0) & ((F.col("refs") == 0) | ((F.col("defs") > 10) & (F.col("defs") > 3 * F.col("refs"))))).alias("notes"), F.bool_or((F.col("refs") > 0) & (F.col("defs") == 0)).alias("body"))
    keys = marks.groupBy("book", "key").agg(F.bool_or(F.col("kind") == "ref").alias("r"), F.count_if(F.col("kind") == "def").alias("d"))
    fit = keys.groupBy("book").agg(F.count_if(F.col("r") & (F.col("d") == 0)).alias("lost"), F.count_if(F.col("d") > 0).alias("known"), F.bool_or(F.col("d") > 1).alias("twice"))
    rows = shape.join(fit, "book")
    return rows.select("book", F.when(F.col("notes") & F.col("body") & ~F.col("twice") & (F.col("lost") < 0.1 * F.col("known")), "GLOBAL").otherwise("LOCAL").alias("style"))


def numbering(notes: DataFrame) -> DataFrame:
    """Findings on the numbers of notes (scope, place, number, section, page): gaps with the missing numbers, and falls that no new section
    or page explains. (scope, place, finding, missing)."""
    w = Window.partitionBy("scope").orderBy("place")
    rows = notes.withColumn("prev", F.lag("number").over(w)).withColumn("p_section", F.lag("section").over(w)).withColumn("p_page", F.lag("page").over(w))
    gap = F.col("number") - F.col("prev") > 1
    fall = (F.col("number") < F.col("prev")) & (F.col("section") == F.col("p_section")) & (F.col("page") == F.col("p_page"))
    missing = F.when(gap, F.sequence(F.col("prev") + 1, F.col("number") - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.where(gap | fall).select("scope", "place", F.when(gap, "gap").otherwise("fall").alias("finding"), missing.cast("array<bigint>").alias("missing"))


def across_files(files: DataFrame, n: int = 20) -> DataFrame:
    """Notes whose only reference in the last ``n`` lines of a file has no definition there, and whose only definition stands in the first
    ``n`` lines of the next file: (book, file, next_file, key)."""
    w = Window.partitionBy("book").orderBy("position")
    order = files.select("book", "file", "position", F.lead("file").over(w).alias("next_file"), F.size(T.lines(visible(F.col("text")))).alias("n_lines"))
    marks = scan(files).join(order.select("book", "file", "n_lines"), "file")
    refs = marks.where(F.expr(f"kind = 'ref' and line_no > n_lines - {n}")).groupBy("book", "file", "key").agg(F.count(F.lit(1)).alias("n_refs"))
    own = marks.where("kind = 'def'").select("book", "file", "key").distinct()
    defs = marks.where(F.expr(f"kind = 'def' and line_no <= {n}")).groupBy("book", F.col("file").alias("next_file"), "key").agg(F.count(F.lit(1)).alias("n_defs"))
    rows = refs.where("n_refs = 1").join(own, ["book", "file", "key"], "left_anti").join(order.select("book", "file", "next_file"), ["book", "file"])
    return rows.join(defs.where("n_defs = 1"), ["book", "next_file", "key"]).select("book", "file", "next_file", "key")


def markers_bound(definitions: DataFrame, markers: DataFrame) -> DataFrame:
    """Body marker of each definition (book, key, position): the last marker of its key before it. As-of join, by carrying the last
    marker forward through one order of both. (book, key, position, marker)."""
    rows = definitions.select("book", "key", "position", F.lit(1).alias("kind")).unionByName(markers.select("book", "key", "position", F.lit(0).alias("kind")))
    w = Window.partitionBy("book", "key").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("marker", F.last(F.when(F.col("kind") == 0, F.col("position")), True).over(w)).where("kind = 1").select("book", "key", "position", "marker")


def definition_blocks(files: DataFrame) -> DataFrame:
    """Definitions with the indented lines that go on: (file, key, first_line, n_lines, content)."""
    rows = files.select("file", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    key = F.regexp_extract("line", rf"^\s{{0,3}}\[\^({KEY})\]:", 1)
    w = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("key", F.when(key != "", key)).withColumn("goes_on", F.col("line").rlike(r"^(?:\s{2,}|\t)\S") | (F.trim("line") == ""))
    rows = rows.withColumn("run", F.sum(F.when(F.col("key").isNotNull() | ~F.col("goes_on"), 1).otherwise(0)).over(w))
    made = rows.groupBy("file", "run").agg(F.max("key").alias("key"), F.min("line_no").alias("first_line"), F.count_if(F.trim("line") != "").alias("n_lines"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    content = F.regexp_replace(F.array_join(F.transform("ls", lambda x: F.trim(x["line"])), "\n"), rf"\A\[\^{KEY}\]:\s*|\s+\z", "")
    return made.where("key is not null").select("file", "key", "first_line", "n_lines", content.alias("content"))


def ambiguous_definition(line: Column, previous: Column) -> Column:
    """Whether a numbered line may be a note or the continuation of one: the line before has no sentence end."""
    return F.coalesce(line.rlike(r"^\s*[0-9]{1,4}[.)]?\s+\p{L}") & (F.trim(previous) != "") & ~previous.rlike(r"[.!?。！？”\"')\]]\s*$"), F.lit(False))


def edit_errors(edits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Edits (name, start, end, replacement) out of range, overlapping the one before, or given twice: (name, start, end, problem)."""
    w = Window.partitionBy("name").orderBy("start", "end")
    rows = edits.join(lengths, "name", "left").withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("twin", F.lag(F.struct("start", "end")).over(w) == F.struct("start", "end"))
    problem = F.when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("length")), "range").when(F.coalesce("twin", F.lit(False)), "duplicate").when(F.col("before") > F.col("start"), "overlap")
    return rows.withColumn("problem", problem).where("problem is not null").select("name", "start", "end", "problem")


def edited(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts (name, text) after their edits, put in from the right: (name, text)."""
    e = edits.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement")), False).alias("edits"))
    put = lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"].cast("int")), x["replacement"], t.substr((x["end"] + 1).cast("int"), F.char_length(t)))
    return texts.join(e, "name", "left").select("name", F.aggregate(F.coalesce("edits", F.array().cast("array<struct<start:bigint,end:bigint,replacement:string>>")), F.col("text"), put).alias("text"))
