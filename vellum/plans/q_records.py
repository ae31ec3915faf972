"""Queries of text functions and of audits, receipts, terms and pages as records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits as A
from ..operators import glossary as G
from ..operators import html_units as H
from ..operators import layout as Y
from ..operators import leases as B
from ..operators import lines as L
from ..operators import merging, receipts, toc
from .q_lines import LINES, docs
from .q_tables import _B, _TREE, _WORDS, blocks, forms, leases, pages, pathed
from .session import table


# texts


def toc_labels(spark, sf_dir):
    """Names of parts written as Markdown and HTML labels."""
    name = F.col("p_name")
    label = F.concat(F.lit(" ## [*"), name, F.lit("*](x.md)[^3] <b>`a`</b> &amp; &lt;"), "p_type", F.lit("&gt;  ![i](j.png)"))
    return table(spark, sf_dir, "part").select("p_partkey", T.toc_label(label).alias("label"))


def numbered_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_name")).otherwise(F.lit(""))).alias("title"), F.when(F.col("p_partkey") % 5 == 0, F.lit("IV.")).otherwise(F.col("p_brand")).alias("label"))
    return p.select("p_partkey", T.numbered_title(F.col("title"), F.col("label")).alias("numbered"), F.coalesce(T.label_stripped(F.col("title"), F.col("label")), F.lit("-")).alias("stripped"))


def scope_keys(spark, sf_dir):
    """Keys of titles with marks and quotes around them, and the variants they are known by."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" **"), F.when(F.col("p_partkey") % 2 == 0, F.lit("Chapter 7: ")).otherwise(F.lit("")), F.lit("“"), "p_name", F.lit("”**")).alias("title"))
    return p.select("p_partkey", T.scope_title_key(F.col("title")).alias("key"), F.array_join(F.sort_array(T.title_variants(F.col("title"))), "|").alias("variants"))


def tex_structure(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tex = F.concat(F.lit(r"\section{"), "p_name", F.lit(r"} \label{s"), F.col("p_partkey").cast("string"), F.lit(r"} see \eqref{e} \citep[p.~3]{"), "p_brand", F.lit(r"} $$x$$ \begin{quote}\textbf{b}\end{quote} \[y\]"))
    return p.select("p_partkey", F.array_join(T.tex_tokens(tex), " ").alias("tokens"))


def fenced_texts(spark, sf_dir):
    """Documents in one outer fence, which goes, or in two, which stay."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```markdown\n"), "text", F.lit("\n```\n"))).otherwise(F.concat(F.lit("```\na\n```\n"), "text", F.lit("\n```")))
    return docs(spark, sf_dir).where("text is not null").select("doc_id", F.sha2(T.outer_fence_stripped(t).cast("binary"), 256).alias("sha"))


def split_superscripts(spark, sf_dir):
    n = (F.col("doc_id") % 1000).cast("string")
    t = F.concat(F.lit("a<sup>"), n, F.lit(", 7;8</sup>"), F.coalesce("text", F.lit("")), F.lit("<sup>9</sup> b<sup> 1 , 2 </sup>"))
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.superscripts_split(t).cast("binary"), 256).alias("sha"))


def untrusted_fences(spark, sf_dir):
    """Documents between markers, and passages of the benchmark that a prompt shows outside them."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("unit"), T.fenced(F.concat("text", F.lit("</untrusted> x"))).alias("f"))
    return d.select(F.col("unit").alias("doc_id"), T.outside_fences(F.col("f")).alias("outside"), F.char_length("f").cast("long").alias("chars"))


def fence_leaks(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("unit"), "text")
    leak = F.when(F.col("unit") % 3 == 0, F.concat(F.lit("Copy: "), "text")).otherwise(F.lit("Copy nothing"))
    prompts = b.select("unit", F.concat(leak, F.lit("\n"), T.fenced(F.col("text"))).alias("prompt"))
    return A.fence_leaks(prompts, b.select("unit", F.col("text").alias("snippet"))).select(F.col("unit").alias("item_id"), F.sha2(F.col("snippet").cast("binary"), 256).alias("sha"))


def blank_page_lines(spark, sf_dir):
    """Lines that stay when images of blank pages, and remarks after them, go from documents given such lines."""
    more = F.concat(F.lit("\n![Blank page "), F.col("doc_id").cast("string"), F.lit("](b.png)\n*This page is blank.*\n![Figure](f.png)\nThis page is blank."))
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", F.concat("text", more).alias("text"))
    out = L.blank_pages_cleaned(L.unit_lines(d).select(F.col("doc_id").alias("unit"), "line_no", "line"))
    return out.groupBy(F.col("unit").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).cast("long").alias("chars"))


def page_number_lines(spark, sf_dir):
    """Numbers put on the first line of documents, taken out where the line was reviewed."""
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", F.concat(F.lit("- "), (F.col("doc_id") % 900).cast("string"), F.lit(" -\n"), "text").alias("text"))
    ls = L.unit_lines(d).select(F.col("doc_id").alias("unit"), "line_no", "line")
    reviewed = ls.where("line_no = 1").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit")).distinct(), "unit", "left_semi").select("unit", "line_no")
    return L.page_numbers_removed(ls, reviewed).groupBy(F.col("unit").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"))


# pairs of texts


def structure_audit(spark, sf_dir):
    """Structure that differs between documents and versions with another heading, a link, a rule."""
    source = F.concat(F.lit("# A\n\n## B\n\n[x](y)\n\n---\n\n"), F.col("text"))
    k = F.col("doc_id") % 4
    target = F.when(k == 0, F.replace(source, F.lit("## B"), F.lit("### B"))).when(k == 1, F.replace(source, F.lit("[x](y)"), F.lit("x"))).when(k == 2, F.concat(source, F.lit("\n\n![p](q)"))).otherwise(source)
    d = docs(spark, sf_dir).where("text is not null").select("doc_id", A.structure_errors(source, target).alias("e"))
    return d.select("doc_id", F.array_join("e", ",").alias("errors"))


def note_mark_audit(spark, sf_dir):
    k = F.col("doc_id") % 4
    source = F.concat(F.lit("a[^1] b[^2]<sup>3</sup>\n\n[^1]: c\n\n"), F.coalesce("text", F.lit("")))
    target = F.when(k == 0, F.replace(source, F.lit("[^2]"), F.lit("[^3]"))).when(k == 1, F.replace(source, F.lit("<sup>3</sup>"), F.lit("3"))).when(k == 2, F.concat(source, F.lit(" ［^4］"))).otherwise(source)
    return docs(spark, sf_dir).select("doc_id", F.array_join(A.note_mark_errors(source, target), ",").alias("errors"))


def html_line_errors(spark, sf_dir):
    """Lines of pages against a version without bold tags, whose seventh lines are gone."""
    p = pages(spark, sf_dir).select(F.col("page_id").alias("unit"), F.posexplode(F.split("html", "\n", -1)).alias("line_no", "text"))
    made = p.where("line_no % 7 != 6").withColumn("text", F.regexp_replace("text", "(?i)</?p>", ""))
    return H.line_errors(p, made).groupBy(F.col("unit").alias("page_id"), "problem").agg(F.count(F.lit(1)).alias("n"))


def audited_pairs(spark, sf_dir):
    """Documents with a label as targets of all documents."""
    d = docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return A.aligned_pairs(d, t, "doc_id").select("doc_id", "missing", F.char_length("source").cast("long").alias("n_source"), F.coalesce(F.char_length("target"), F.lit(-1)).cast("long").alias("n_target"))


# records


def reusable_checkpoints(spark, sf_dir):
    """Documents whose label says quality and whose content is that of the receipt."""
    now = receipts.receipts(docs(spark, sf_dir), "doc_id", "text", "now").select("name", "sha256")
    done = now.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("valid")), "name")
    done = done.withColumn("sha256", F.when(F.col("name") % 3 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return receipts.reusable(now, done).select(F.col("name").alias("doc_id"))


def memory_union(spark, sf_dir):
    """Brands of parts by size, joined by those of the parts with an even key."""
    p = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("id"), F.col("p_brand").alias("value"), "p_partkey")
    return receipts.union_by_id(p.drop("p_partkey"), p.where("p_partkey % 2 = 0").drop("p_partkey"), "id", "value")


def scan_progress(spark, sf_dir):
    """Orders as scans of seven pages, their lines as pages done, failed or empty."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    number = F.col("l_linenumber").cast("int")
    some = lambda c: F.sort_array(F.collect_list(F.when(c, number)))
    scans = li.groupBy(F.col("l_orderkey").alias("book")).agg(
        F.lit(7).alias("total"), some(F.col("flag") != "A").alias("done"), some(F.col("flag") == "A").alias("failed"), some((F.col("flag") == "R") & (F.col("status") == "F")).alias("empty"), some(number == 1).alias("allowed"),
    )
    return receipts.progress(scans).select("book", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing", "failed", "unexplained")], "complete")


def retry_schedule(spark, sf_dir):
    """When each event's task may try again, by the kind of its failure."""
    e = leases(spark, sf_dir)
    w = Window.partitionBy("task").orderBy("at", "event_id")
    e = e.withColumn("attempt", F.row_number().over(w)).withColumn("after", F.when(F.col("event_id") % 11 == 0, F.lit(45)))
    reset = F.when(F.col("event_id") % 2 == 0, F.timestamp_seconds(F.unix_timestamp("at") + 7200))
    r = B.retry_at(F.col("at"), F.when(F.col("owner") == "error", "quota").otherwise("transient"), F.col("attempt"), F.col("after"), reset)
    return e.select("event_id", r.alias("r")).select("event_id", F.coalesce(F.unix_timestamp("r.at"), F.lit(-1).cast("long")).alias("at_s"), "r.blocked")


def free_slots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("active"), F.max(F.when(F.col("o_orderstatus") == "F", 2)).alias("temporary"))
    return n.select("o_custkey", B.slots(F.lit(8), F.lit(5), F.coalesce("temporary", F.lit(5)), F.col("active")).cast("long").alias("free"))


def scope_conflicts(spark, sf_dir):
    """Brands as forms, types as targets, sizes as chapters; those of size 1 hold for the whole book."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.col("p_brand").alias("form"), F.col("p_type").alias("target"), F.when(F.col("p_size") > 1, F.col("p_size").cast("long")).alias("chapter"))
    return G.scope_conflicts(e).select("phrase", F.coalesce("chapter", F.lit(0).cast("long")).alias("chapter"), "a", "b")


def entity_errors(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 10 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("target"), F.lit("place").alias("kind"))
    return G.entity_errors(e)


def unit_glossaries(spark, sf_dir):
    """Terms of each document, and how often they come."""
    f = G.occurrences(docs(spark, sf_dir).select(F.col("doc_id").alias("unit"), "text"), forms(spark, sf_dir).where("form like '% %'"))
    return G.unit_context(f).select(F.col("unit").alias("doc_id"), F.array_join("entries", ",").alias("entries"), "n")


# pages


def layout_differences(spark, sf_dir):
    """Layouts of orders against a scan that lost its last blocks and moved some others."""
    a = blocks(spark, sf_dir)
    b = a.where("block < 5").withColumn("y1", F.when(F.col("page") % 2 == 0, F.col("y1") + 0.2).otherwise(F.col("y1")))
    return Y.layouts_differ(Y.layout_summary(a), Y.layout_summary(b)).select("page", F.array_contains("reasons", "range").alias("moved"), F.array_contains("reasons", "bins").alias("bins"), F.array_contains("reasons", "one side only").alias("lone"))


def candidate_matches(spark, sf_dir):
    """Blocks of a page in two scans that are one: the second has half of the keys, and lies lower."""
    a = blocks(spark, sf_dir).select("page", "block", "y0", "y1", F.when(F.col("label") == "Footnote", F.regexp_extract("text", "[0-9]+", 0)).alias("key"))
    b = a.withColumn("y0", F.col("y0") + F.col("block") / 256).withColumn("y1", F.col("y1") + F.col("block") / 256).withColumn("key", F.when(F.col("page") % 2 == 0, F.col("key")))
    both = a.alias("a").join(b.alias("b"), ["page", "block"])
    return both.select("page", "block", Y.same_candidate("a", "b").alias("same"))


def excluded_blocks(spark, sf_dir):
    """Blocks on the pages of typed units of five orders' keys each."""
    u = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).cast("string").alias("book"), (F.col("c_custkey") * 20).alias("first"), (F.col("c_custkey") * 20 + 9).alias("last"), F.col("c_mktsegment").alias("type"))
    return Y.excluded_blocks(blocks(spark, sf_dir), u).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("n_pages"))


def text_layers(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.concat("source", F.lit(":"), "lang").alias("book"), F.col("n_chars").alias("chars"), (F.col("doc_id") % 4).alias("fonts"), ((F.col("doc_id") % 10) / 10).alias("image_share"))
    return Y.text_layer(d).select("book", F.col("chars").cast("double").alias("chars"), "kind")


def toc_outline(spark, sf_dir):
    return toc.outline(pathed(spark, sf_dir), 400).select("book", F.col("depth").cast("long").alias("depth"))


def toc_renumbered(spark, sf_dir):
    p = pathed(spark, sf_dir).withColumn("hidden", (F.col("node_id").like("n%")) & (F.col("position") % 2 == 0))
    return toc.renumbered(p.drop("parent_id", "position")).select("node_id", F.coalesce("parent_id", F.lit("-")).alias("parent_id"), "position")


def combined_markdown(spark, sf_dir):
    """Turns of conversations as parts of one text each."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("position"), F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("  ")).alias("text"))
    return merging.combined(c).select(F.col("book").alias("conv_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def union_boxes(spark, sf_dir):
    return Y.union_boxes(blocks(spark, sf_dir), ["page", "label"]).select("page", "label", *[F.bround(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def part_groups(spark, sf_dir):
    """Line items as part files of their orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit(".part"), F.col("l_linenumber").cast("string"))
    return receipts.parts_by_base(li.select(name.alias("name")), "name").select("base", "n", F.array_join("names", " ").alias("names"))


def pending_reasons(spark, sf_dir):
    """Reasons of documents whose receipts, made for labelled ones, are of another content for a third."""
    now = receipts.receipts(docs(spark, sf_dir), "doc_id", "text", "now").select("name", "sha256")
    done = now.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("valid")), "name")
    done = done.withColumn("sha256", F.when(F.col("name") % 3 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return receipts.reason_counts(receipts.pending(now, done))


def schema_versions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    recorded = F.when(F.col("p_size") % 7 == 0, F.lit("x")).otherwise(F.concat((F.col("p_size") % 3).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(".1")).otherwise(F.lit(""))))
    return p.select("p_partkey", receipts.same_major(recorded, F.lit("2.4")).alias("same"))


def review_states(spark, sf_dir):
    """Orders as files: their line items' flags are review signals, shipped ones escalated; orders without 'F' are missing or invalid."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_returnflag").alias("kind"), "l_linestatus").distinct()
    up = li.select("file", "kind", F.when(F.col("l_linestatus") == "F", "human_review_required").otherwise("retry").alias("state"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), "o_orderstatus", "o_custkey")
    bad = o.where("o_orderstatus = 'P'").select("file", F.when(F.col("o_custkey") % 2 == 0, "prepared_context").otherwise("syntax").alias("kind"), F.when(F.col("o_custkey") % 3 > 0, "rebuild").otherwise("").alias("action"))
    out = receipts.review_state(li.select("file", "kind").distinct(), o.where("o_orderstatus = 'O'").select("file"), bad, up)
    return out.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files"))


def toc_html(spark, sf_dir):
    return toc.html_list(pathed(spark, sf_dir).withColumn("href", F.concat("node_id", F.lit(".xhtml")))).select("book", F.sha2("html", 256).alias("sha"), F.char_length("html").cast("long").alias("chars"))


def titles_at_anchor(spark, sf_dir):
    """Whether documents show a title of two headings at their start, that comes later, or not at all in others."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.lit("# The Long\n\n## Road\n")).when(k == 1, F.lit("The Long Road\n")).when(k == 2, F.lit("some text\n# The Long Road\n")).otherwise(F.lit("# The\n"))
    ls = T.lines(F.concat(head, F.coalesce("text", F.lit(""))))
    return docs(spark, sf_dir).select("doc_id", toc.title_at(ls, F.lit(1), F.lit(6), F.lit("The *Long* Road")).alias("there"), toc.title_at(ls, F.lit(1), F.lit(6), F.lit("The Long Road"), F.lit(2)).alias("second"))


QUERIES = {
    f.__name__: f
    for f in (
        toc_labels, numbered_titles, scope_keys, tex_structure, fenced_texts, split_superscripts, untrusted_fences, fence_leaks, blank_page_lines, page_number_lines, structure_audit, note_mark_audit,
        html_line_errors, audited_pairs, reusable_checkpoints, memory_union, scan_progress, retry_schedule, free_slots, scope_conflicts, entity_errors, unit_glossaries, layout_differences, candidate_matches,
        excluded_blocks, text_layers, toc_outline, toc_renumbered, combined_markdown,
        union_boxes, part_groups, pending_reasons, schema_versions, review_states, toc_html, titles_at_anchor,
    )
}

_COLLAPSED = r"trim(regexp_replace({}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ')"

ORACLE_SQL = {
    "toc_labels": f"SELECT p_partkey, {_COLLAPSED.format("p_name || ' a & <' || p_type || '> i'")} AS label FROM part",
    "numbered_titles": f"""
WITH t AS (SELECT p_partkey, {_COLLAPSED.format("p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE '' END")} AS t FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'IV. ' ELSE '' END || t AS numbered, CASE WHEN p_partkey % 5 != 0 AND p_partkey % 3 = 0 THEN substr(t, strpos(t, ' ') + 1) ELSE '-' END AS stripped FROM t""",
    "scope_keys": """
WITH n AS (SELECT p_partkey, lower(p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'chapter 7: “' || n || '”' ELSE n END AS key, CASE WHEN p_partkey % 2 = 0 THEN 'chapter 7: “' || n || '”|“' || n || '”' ELSE n END AS variants FROM n""",
    "tex_structure": r"""SELECT p_partkey, '\label{s' || p_partkey || '} \eqref{e} \citep[p.~3]{' || p_brand || '} $$ $$ \begin{quote} \end{quote} \[ \]' AS tokens FROM part""",
    "fenced_texts": """
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 1 THEN '```' || chr(10) || 'a' || chr(10) || '```' || chr(10) || text || chr(10) || '```' WHEN contains(text, '```') THEN '```markdown' || chr(10) || text || chr(10) || '```' || chr(10) ELSE text END) AS sha
FROM documents WHERE text IS NOT NULL""",
    "split_superscripts": """
SELECT doc_id, sha256('a<sup>' || doc_id % 1000 || '</sup><sup>7</sup><sup>8</sup>' || coalesce(text, '') || '<sup>9</sup> b<sup>1</sup><sup>2</sup>') AS sha FROM documents""",
    "untrusted_fences": "SELECT doc_id, '' AS outside, CAST(25 + coalesce(length(text) + 20, 0) AS BIGINT) AS chars FROM documents",
    "fence_leaks": f"SELECT item_id, sha256({_COLLAPSED.format('text')}) AS sha FROM benchmark WHERE item_id % 3 = 0 AND length({_COLLAPSED.format('text')}) >= 3",
    "blank_page_lines": r"""
WITH x AS (SELECT doc_id, regexp_replace(text || chr(10) || 'E', '\r\n?', chr(10), 'g') AS x FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, length(x) AS c, length(x) - length(replace(x, chr(10), '')) AS n FROM x)
SELECT doc_id, CAST(n + 2 AS BIGINT) AS n_lines, CAST(c - n - 1 + length('![Figure](f.png)This page is blank.') AS BIGINT) AS chars FROM n""",
    "page_number_lines": f"""
WITH x AS (SELECT doc_id, '- ' || doc_id % 900 || ' -' || chr(10) || text AS text FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, len({LINES}) - (doc_id IN (SELECT doc_id FROM labels))::INT AS n FROM x)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines FROM n WHERE n > 0""",
    "structure_audit": "SELECT doc_id, (['levels', 'links', 'images', ''])[doc_id % 4 + 1] AS errors FROM documents WHERE text IS NOT NULL",
    "note_mark_audit": "SELECT doc_id, (['marks differ', 'superscripts differ', 'other notation', ''])[doc_id % 4 + 1] AS errors FROM documents",
    "html_line_errors": """
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages)
SELECT page_id, CASE WHEN n % 7 = 0 THEN 'missing' ELSE 'tags' END AS problem, count(*) AS n FROM l WHERE n % 7 = 0 OR regexp_matches(line, '(?i)</?p>') GROUP BY ALL""",
    "audited_pairs": """
SELECT doc_id, l IS NULL AS missing, CAST(length(coalesce(text, '')) AS BIGINT) AS n_source, CAST(CASE WHEN l IS NULL THEN -1 ELSE length(coalesce(text, '')) END AS BIGINT) AS n_target
FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS l FROM labels) USING (doc_id)""",
    "reusable_checkpoints": "SELECT doc_id FROM documents WHERE doc_id % 3 != 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "memory_union": "SELECT p_type || '/' || p_size AS id, min(p_brand) AS value, count(DISTINCT p_brand) > 1 AS conflict FROM part GROUP BY 1",
    "scan_progress": """
WITH l AS (SELECT l_orderkey AS book, l_linenumber AS n, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL),
o AS (SELECT book, unnest(range(1, 8)) AS n FROM (SELECT DISTINCT book FROM l)), x AS (SELECT o.book, o.n, l.n IS NULL AS missing, coalesce(f = 'A', false) AS failed, coalesce(f = 'R' AND s = 'F' AND o.n > 1, false) AS odd FROM o LEFT JOIN l ON l.book = o.book AND l.n = o.n)
SELECT book, coalesce(string_agg(n, ',' ORDER BY n) FILTER (missing), '') AS missing, coalesce(string_agg(n, ',' ORDER BY n) FILTER (failed), '') AS failed, coalesce(string_agg(n, ',' ORDER BY n) FILTER (odd), '') AS unexplained,
  NOT bool_or(missing OR failed OR odd) AS complete FROM x GROUP BY book""",
    "retry_schedule": """
WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type = 'error' AS quota, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT *, (quota AND event_id % 2 = 1 AND event_id % 11 != 0) OR k > 5 AS blocked FROM e)
SELECT event_id, blocked, CASE WHEN blocked THEN -1 WHEN event_id % 11 = 0 THEN s + 45 WHEN quota THEN s + 7200 ELSE s + CAST(least(30 * pow(2, least(k, 20) - 1), 3600) AS BIGINT) END AS at_s FROM r""",
    "free_slots": "SELECT o_custkey, CAST(greatest(0, CASE WHEN bool_or(o_orderstatus = 'F') THEN 2 ELSE 5 END - count(*)) AS BIGINT) AS free FROM orders GROUP BY o_custkey",
    "scope_conflicts": """
WITH e AS (SELECT lower(replace(p_brand, '#', ' ')) AS phrase, CASE WHEN p_size > 1 THEN p_size END AS c, p_type AS t FROM part),
p AS (SELECT DISTINCT a.phrase, a.c, b.t FROM (SELECT DISTINCT phrase, c FROM e) a JOIN e b ON a.phrase = b.phrase AND (b.c IS NULL OR b.c IS NOT DISTINCT FROM a.c))
SELECT phrase, CAST(coalesce(c, 0) AS BIGINT) AS chapter, min(t) AS a, max(t) AS b FROM p GROUP BY phrase, c HAVING count(*) > 1""",
    "entity_errors": """
SELECT p_name AS name, CASE WHEN bool_or(p_size % 10 = 0) THEN 'no target' ELSE 'twice' END AS problem FROM part GROUP BY p_name HAVING bool_or(p_size % 10 = 0) OR count(*) > 1""",
    "unit_glossaries": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), f AS (SELECT CAST(item_id AS VARCHAR) AS entry, array_to_string(list_slice({_WORDS}, 1, 2), ' ') AS form FROM benchmark),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS form FROM d) SELECT doc_id, string_agg(DISTINCT entry, ',' ORDER BY entry) AS entries, count(*) AS n FROM g JOIN f USING (form) GROUP BY doc_id""",
    "layout_differences": f"""
WITH {_B}, a AS (SELECT page, min(y0) AS t, max(y1) AS u, list_sort(list_distinct(list(least(floor(y0 * 20), 19)))) AS bins FROM b GROUP BY page),
c AS (SELECT page, min(y0) AS t, max(CASE WHEN page % 2 = 0 THEN y1 + 0.2::DOUBLE ELSE y1 END) AS u, list_sort(list_distinct(list(least(floor(y0 * 20), 19)))) AS bins FROM b WHERE block < 5 GROUP BY page)
SELECT a.page, coalesce(abs(a.t - c.t) > 0.1::DOUBLE OR abs(a.u - c.u) > 0.1::DOUBLE, false) AS moved, coalesce(a.bins != c.bins, false) AS bins, c.page IS NULL AS lone FROM a LEFT JOIN c ON a.page = c.page""",
    "candidate_matches": f"""
WITH {_B}, s AS (SELECT page, block, y0, y1, y0 + block / 256.0::DOUBLE AS z0, y1 + block / 256.0::DOUBLE AS z1, label = 'Footnote' AND page % 2 = 0 AS keyed FROM b)
SELECT page, block, greatest(0, least(y1, z1) - greatest(y0, z0)) / greatest(least(y1 - y0, z1 - z0), 1e-9::DOUBLE) >= CASE WHEN keyed THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END AS same FROM s""",
    "excluded_blocks": f"""
WITH {_B}, u AS (SELECT CAST(c_custkey % 100 AS VARCHAR) AS book, c_custkey AS k, c_mktsegment AS type FROM customer)
SELECT type, count(*) AS n, count(DISTINCT page) AS n_pages FROM b JOIN u ON b.book = u.book AND CAST(floor(page / 20) AS BIGINT) = k AND page % 20 <= 9 GROUP BY type""",
    "text_layers": """
WITH b AS (SELECT source || ':' || lang AS book, median(n_chars) AS chars, avg((doc_id % 4 > 0)::INT) AS f, avg((doc_id % 10 >= 8)::INT) AS i FROM documents GROUP BY 1)
SELECT book, CAST(chars AS DOUBLE) AS chars, CASE WHEN chars < 50 OR f < 0.2 THEN 'scanned_or_low_text' WHEN i >= 0.5 THEN 'searchable_ocr_or_mixed' ELSE 'native_text' END AS kind FROM b""",
    "toc_outline": f"""
WITH RECURSIVE {_TREE}, d AS (SELECT len(path) AS d, sum(ceil(length(title) / 4.0)) AS n FROM p GROUP BY 1), r AS (SELECT d, sum(n) OVER (ORDER BY d) AS n FROM d) SELECT 'world' AS book, CAST(max(d) AS BIGINT) AS depth FROM r WHERE n <= 400""",
    "toc_renumbered": f"""
WITH RECURSIVE {_TREE}, v AS (SELECT * FROM p WHERE NOT (node_id LIKE 'n%' AND position % 2 = 0)),
a AS (SELECT v.node_id, v.path, coalesce(arg_max(u.node_id, len(u.path)), '-') AS parent_id FROM v LEFT JOIN v u ON len(u.path) < len(v.path) AND list_slice(v.path, 1, len(u.path)) = u.path GROUP BY ALL)
SELECT node_id, parent_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY path) AS BIGINT) AS position FROM a""",
    "union_boxes": f"""
WITH {_B} SELECT page, label, round_even(min(x0), 6) AS x0, round_even(min(y0), 6) AS y0, round_even(max(x1), 6) AS x1, round_even(max(y1), 6) AS y1 FROM b WHERE x1 > x0 AND y1 > y0 GROUP BY page, label""",
    "part_groups": """
SELECT 'order_' || l_orderkey AS base, count(*) AS n, string_agg('order_' || l_orderkey || '.part' || l_linenumber, ' ' ORDER BY l_linenumber) AS names FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey""",
    "pending_reasons": """
WITH d AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
SELECT CASE WHEN q IS NULL THEN 'missing' WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'invalid' END AS reason, count(*) AS n FROM documents LEFT JOIN d USING (doc_id) WHERE NOT coalesce(q = 1 AND doc_id % 3 != 0, false) GROUP BY 1""",
    "schema_versions": "SELECT p_partkey, p_size % 3 = 2 AND p_size % 7 != 0 AS same FROM part",
    "review_states": """
WITH l AS (SELECT l_orderkey AS f, l_returnflag AS kind, CASE WHEN bool_or(l_linestatus = 'F') THEN 'ask_human' ELSE 'retry_subagent' END AS action FROM lineitem GROUP BY ALL),
o AS (SELECT o_orderkey AS f, CASE WHEN o_orderstatus = 'O' THEN 'missing_output' WHEN o_custkey % 2 = 0 AND o_custkey % 3 > 0 THEN 'prepared_context' ELSE 'invalid_output' END AS kind, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT kind, action, count(*) AS n, count(DISTINCT f) AS n_files FROM (SELECT * FROM l UNION ALL SELECT f, kind, CASE WHEN kind = 'prepared_context' THEN 'rebuild' ELSE 'retry_subagent' END FROM o) GROUP BY ALL""",
    "toc_html": f"""
WITH RECURSIVE {_TREE}, n AS (SELECT path, len(path) AS d, coalesce(len(lead(path) OVER (ORDER BY path)), 1) AS nd, '<li><a href="' || node_id || '.xhtml">' || title || '</a>' AS a FROM p),
w AS (SELECT '<ul>' || string_agg(a || CASE WHEN nd > d THEN '<ul>' ELSE '</li>' || repeat('</ul></li>', d - nd) END, '' ORDER BY path) || '</ul>' AS h FROM n) SELECT 'world' AS book, sha256(h) AS sha, CAST(length(h) AS BIGINT) AS chars FROM w""",
    "titles_at_anchor": "SELECT doc_id, doc_id % 4 < 2 AS there, doc_id % 4 = 2 AS second FROM documents",
    "combined_markdown": """
SELECT conv_id, sha256(string_agg(trim(coalesce(text, ''), ' '), chr(10) || chr(10) ORDER BY turn, ' ' || coalesce(text, '') || '  ')) AS sha FROM conversations GROUP BY conv_id""",
}
