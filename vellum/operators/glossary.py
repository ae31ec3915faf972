"""Terminology: forms, their occurrences in texts, overlaps, projections and conflicts.

Forms come as (entry, form, target, priority, allow_short). Matching goes by words: forms and texts are cut into
normalised words, n-grams of the lengths that forms have are looked up by equi-join, so cost grows with texts, not with
texts times forms."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import fold

MOST_WORDS = 12


def words(c: Column) -> Column:
    """Normalised words in order."""
    return F.filter(F.split(F.lower(F.translate(c, "‘’“”‐‑–—", "''\"\"----")), f"[^{T.WORD_CHARS}']+"), lambda w: w != "")


def phrase(c: Column) -> Column:
    return F.array_join(words(c), " ")


def usable(forms: DataFrame) -> DataFrame:
    """Forms with their phrase and number of words; of 3 characters, or 2 if short ones are allowed."""
    rows = forms.withColumn("phrase", phrase(F.col("form"))).withColumn("n", F.size(words(F.col("form"))))
    return rows.where((F.char_length("phrase") >= F.when(F.coalesce("allow_short", F.lit(False)), 2).otherwise(3)) & (F.col("n") >= 1))


def grams(ws: Column, n: int) -> Column:
    """Runs of ``n`` words of an array, in order, each joined by spaces; one pass per word of the run."""
    out = ws
    for k in range(1, n):
        out = F.zip_with(out, F.slice(ws, k + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(ws) - (n - 1))) if n > 1 else out


def occurrences(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(unit, start, end, entry, form, priority) for every occurrence of a form in texts (unit, text); places count words. n-grams are
    built for the lengths that forms have, ``MOST_WORDS`` at most; longer forms are looked up by so many words and the rest is compared."""
    forms = usable(forms).select("entry", "form", "phrase", "n", "priority")
    sizes = sorted(r["n"] for r in forms.select("n").distinct().collect()) or [1]
    found = None
    for n in [n for n in sizes if n <= MOST_WORDS]:
        rows = texts.select("unit", F.posexplode(grams(words(F.col("text")), n)).alias("start", "phrase"))
        hits = rows.join(forms.where(F.col("n") == n), "phrase").select("unit", "start", (F.col("start") + n).alias("end"), "entry", "form", "priority")
        found = hits if found is None else found.unionByName(hits)
    if sizes[-1] > MOST_WORDS:
        hits = _longer(texts, forms.where(F.col("n") > MOST_WORDS))
        found = hits if found is None else found.unionByName(hits)
    return found


def _longer(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """Occurrences of forms of more than ``MOST_WORDS`` words. Equal rows of texts are looked up once and met again by their text's digest."""
    head = F.array_join(F.slice(F.split("phrase", " "), 1, MOST_WORDS), " ")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    rows = texts.select("unit", "text").distinct().select(F.col("unit").alias("at"), sha.alias("sha"), F.posexplode(grams(words(F.col("text")), MOST_WORDS)).alias("start", "head"))
    near = rows.join(forms.withColumn("head", head), "head").drop("head")
    both = near.join(texts.select("unit", "text", sha.alias("own")), F.col("at").eqNullSafe(F.col("unit")) & (F.col("sha") == F.col("own")))
    whole = both.where(F.array_join(F.slice(words(F.col("text")), F.col("start") + 1, F.col("n")), " ") == F.col("phrase"))
    return whole.select("unit", "start", (F.col("start") + F.col("n")).alias("end"), "entry", "form", "priority")


def contained(texts: DataFrame, passages: DataFrame, anchor: int = 5) -> DataFrame:
    """(unit, item) where a text contains a passage (item, text) literally, wherever it begins or ends. Candidates share words inside the
    passage, which are whole words of a text that contains it: the second to at most the ``anchor + 1``th, found by equi-join.
    Passages of less than three words share their first characters, at most 3. The literal test follows. Empty passages are not sought."""
    def inner(c: Column) -> Column:
        return F.split(c, r"[ \n]+")

    n = F.least(F.lit(anchor), F.size(inner(F.col("text"))) - 2)
    own = passages.where("text != ''").select("item", F.col("text").alias("passage"), F.greatest(n, F.lit(0)).alias("n"), F.array_join(F.slice(inner(F.col("text")), F.lit(2), F.greatest(n, F.lit(0))), " ").alias("gram"))
    short = own.where("n = 0").withColumn("n", F.least(F.lit(3), F.char_length("passage"))).withColumn("gram", F.expr("substring(passage, 1, n)"))
    found = None
    for n in sorted(r["n"] for r in own.where("n > 0").select("n").distinct().collect()):
        rows = texts.select("unit", F.explode(F.array_distinct(grams(inner(F.col("text")), n))).alias("gram")).join(own.where(F.col("n") == n), "gram").select("unit", "item", "passage")
        found = rows if found is None else found.unionByName(rows)
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):
        cut = F.transform(F.sequence(F.lit(1), F.char_length("text") - (n - 1)), lambda i: F.substring(F.col("text"), i, F.lit(n)))  # noqa: B023
        rows = texts.where(F.char_length("text") >= n).select("unit", F.explode(F.array_distinct(cut)).alias("gram")).join(short.where(F.col("n") == n), "gram").select("unit", "item", "passage")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return texts.join(passages, F.lit(False)).select("unit", "item")
    pairs = found.select("unit", "item", "passage").distinct()
    return pairs.join(texts.select("unit", "text"), "unit").where(F.contains("text", F.col("passage"))).select("unit", "item").distinct()


def resolved(found: DataFrame) -> DataFrame:
    """Occurrences that stay when overlaps go: by priority, then length, then place, each taken unless a taken one overlaps it.
    (unit, start, end, entry, form, kept). Rows of a unit come in that order as a stream."""
    order = found.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("priority"), F.desc(F.col("end") - F.col("start")), "start", "end", "entry", "form")).cast("long"))

    def start():
        return [], []

    def step(taken, row):
        if row is None:
            return taken, []
        starts, ends = taken  # of taken occurrences, which never overlap, in order of place
        at = bisect_right(ends, row["start"])
        free = at == len(starts) or row["end"] <= starts[at]
        if free:
            starts.insert(at, row["start"])
            ends.insert(at, row["end"])
        return taken, [(row["unit"], row["start"], row["end"], row["entry"], row["form"], free)]

    given = order.select("unit", "rank", F.col("start").cast("long"), F.col("end").cast("long"), F.col("entry").cast("string"), "form")
    return fold(given, ["unit"], ["rank"], start, step, "unit long, start long, end long, entry string, form string, kept boolean")


def unit_context(found: DataFrame) -> DataFrame:
    """Terms of each unit: (unit, entries in order, n)."""
    return found.groupBy("unit").agg(F.sort_array(F.collect_set("entry")).alias("entries"), F.count(F.lit(1)).alias("n"))


def ordered(entries: DataFrame) -> DataFrame:
    """Entries by falling priority, then length of the longest form, then name, with their place."""
    rows = entries.groupBy("entry").agg(F.max("priority").alias("priority"), F.max(F.char_length("form")).alias("longest"), F.min(phrase(F.col("form"))).alias("name"))
    # numbered within groups that are in the same order, after the sizes of all groups before
    rows = rows.withColumn("start", F.substring("name", 1, 2))
    group = ["priority", "longest", "start"]
    order = [F.desc("priority"), F.desc("longest"), F.asc("start")]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.orderBy(*order)) - F.col("n")).drop("n")
    out = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("name", "entry"))).alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group])
    return out.select("entry", *[F.col(f"r.{c}") for c in ("priority", "longest")], "name", (F.col("before") + F.col("nth")).alias("place"))


def projected(terms: DataFrame, source: str, target: str) -> DataFrame:
    """Terms (entry, lang, preferred, forms ARRAY, policy) of both languages: (entry, form, target, policy); the policy is the target's."""
    s = terms.where(F.col("lang") == source).select("entry", F.explode(F.array_distinct(F.concat(F.array("preferred"), F.coalesce("forms", F.array().cast("array<string>"))))).alias("form"))
    t = terms.where(F.col("lang") == target).select("entry", F.col("preferred").alias("target"), "policy")
    return s.join(t, "entry")


def conflicts(projection: DataFrame) -> DataFrame:
    """Normalised forms with two targets: (phrase, targets)."""
    rows = projection.select(phrase(F.col("form")).alias("phrase"), "target").distinct().groupBy("phrase").agg(F.sort_array(F.collect_list("target")).alias("targets"))
    return rows.where(F.size("targets") > 1)


def scope_conflicts(entries: DataFrame) -> DataFrame:
    """Same form, other target, in scopes (book, or one chapter) that overlap: (phrase, a, b) of entries (entry, form, target, chapter or null)."""
    e = entries.select("entry", phrase(F.col("form")).alias("phrase"), "target", "chapter")
    n = e.groupBy("phrase", "chapter").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    wide = n.where("chapter is null").select("phrase", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    rows = n.join(wide, "phrase", "left")
    lo, hi = F.least("lo", "b_lo"), F.greatest("hi", "b_hi")
    return rows.where(lo != hi).select("phrase", "chapter", lo.alias("a"), hi.alias("b"))


def entity_errors(entities: DataFrame) -> DataFrame:
    """Entities (name, target, kind) without a part, or named twice: (name, problem)."""
    n = entities.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.trim("target"), F.lit(""))).alias("t"))
    return n.withColumn("problem", F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name").when(F.col("t") == "", "no target").when(F.col("n") > 1, "twice")).where("problem is not null").select("name", "problem")
