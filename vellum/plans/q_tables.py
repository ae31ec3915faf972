"""Queries on pages, events, trees, glossaries, notes and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import footnotes as N
from ..operators import glossary as G
from ..operators import html_units as H
from ..operators import layout as Y
from ..operators import leases as B
from ..operators import lines as L
from ..operators import toc
from .q_lines import LINES
from .session import table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# HTML


def html_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.coalesce(H.title(F.col("html")), F.lit("")).alias("title"))


def html_links(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.posexplode(H.hrefs(F.col("html"))).alias("i", "href")).select("page_id", (F.col("i") + 1).cast("long").alias("nth"), "href")


def html_tag_sequence(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.array_join(H.tag_names(F.col("html")), " ").alias("tags"))


def html_protected_tokens(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.size(H.protected_tokens(F.col("html"))).cast("long").alias("n"), F.sha2(F.array_join(H.protected_tokens(F.col("html")), "|").cast("binary"), 256).alias("sha"))


def html_plain_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.sha2(H.plain_text(F.col("html")).cast("binary"), 256).alias("sha"))


def html_visible_text(spark, sf_dir):
    return H.document_text(pages(spark, sf_dir)).select("page_id", F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def html_units(spark, sf_dir):
    return H.unit_lines(H.compress(pages(spark, sf_dir))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.char_length("text")).alias("chars"))


def html_codec_roundtrip(spark, sf_dir):
    """Pages after compress and decompress, by their digests."""
    c = H.compress(pages(spark, sf_dir))
    return H.decompress(c, H.unit_lines(c)).select("page_id", F.char_length("html").cast("long").alias("chars"), F.sha2(F.col("html").cast("binary"), 256).alias("sha"))


def html_cleaned(spark, sf_dir):
    c = H.cleaned(pages(spark, sf_dir))
    return c.select("page_id", F.size(H.tag_names(F.col("html"))).cast("long").alias("n_tags"), F.col("html").rlike(r"(?i)<script|onclick|javascript:").alias("active"))


def mask_restore_roundtrip(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "html", H.masked(F.col("html")).alias("m"))
    return p.select("page_id", F.size("m.tokens").cast("long").alias("n"), (H.restored(F.col("m.masked"), F.col("m.tokens")) == F.col("html")).alias("same"))


def broken_internal_links(spark, sf_dir):
    p = pages(spark, sf_dir).select(F.col("page_id").alias("page"), F.concat(F.lit("/p"), F.col("page_id").cast("string")).alias("path"), "html")
    return H.broken_links(p)


# events


def leases(spark, sf_dir) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "release").otherwise("claim")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("task"), F.col("event_type").alias("owner"), action.alias("action"), "value", "props")


def event_props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("again"))


def lease_replay(spark, sf_dir):
    return B.renewals(leases(spark, sf_dir)).groupBy("task").agg(F.count_if(F.col("status") == "claimed").alias("claimed"), F.count_if(F.col("status") == "renewed").alias("renewed"))


def lease_protocol(spark, sf_dir):
    """All statuses of the protocol over claims that share files by their key in props."""
    e = leases(spark, sf_dir).withColumn("digest", F.concat("owner", F.lit(":"), (F.col("event_id") % 3).cast("string"))).withColumn("owner", (F.col("event_id") % 2).cast("string"))
    e = e.withColumn("files", F.array((F.get_json_object("props", "$.k").cast("long") % 4).cast("string"))).withColumn("task", (F.col("event_id") % 50).cast("string"))
    return B.replayed(e).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def lease_latest(spark, sf_dir):
    e = leases(spark, sf_dir)
    last = e.agg(F.max("at").alias("t")).first()["t"]
    out = B.latest(e, str(last)) if last else B.latest(e, "2000-01-01")
    return out.select("task", "owner", "status", F.col("seconds_left").cast("long").alias("seconds_left"))


def lease_sessions(spark, sf_dir):
    return B.sessions(leases(spark, sf_dir)).select("task", F.col("nth").cast("long").alias("nth"), "n", F.unix_timestamp("first").alias("first_s"), F.unix_timestamp("last").alias("last_s"))


def escalation_state(spark, sf_dir):
    e = leases(spark, sf_dir).select("task", F.get_json_object("props", "$.k").alias("file"), F.lit("x").alias("kind"), "at", "event_id", (F.col("owner") == "purchase").alias("resolved"))
    return B.escalated(e).select("task", "file", F.col("n").cast("long").alias("n"), "state")


def backoff_deadline(spark, sf_dir):
    w = Window.partitionBy("task").orderBy("at", "event_id")
    e = leases(spark, sf_dir).withColumn("attempt", F.row_number().over(w))
    return e.select("event_id", F.col("attempt").cast("long").alias("attempt"), B.delay(F.col("attempt")).alias("seconds"), (F.unix_timestamp("at") + B.delay(F.col("attempt"))).alias("at_s"))


def inactive_topk(spark, sf_dir):
    e = leases(spark, sf_dir).withColumn("status", F.when(F.col("owner") == "view", "active").otherwise("inactive"))
    return B.inactive_kept(e, 3).select("task", "event_id", "status")


def lease_conflicts(spark, sf_dir):
    e = leases(spark, sf_dir).select(F.col("event_id").alias("lease"), F.array(F.get_json_object("props", "$.k"), F.concat(F.lit("u"), "task")).alias("files"))
    return B.conflicts(e)


# trees


def tree(spark, sf_dir) -> DataFrame:
    """Regions, their nations, their customers as one table of nodes."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("position"), F.col("r_name").alias("title"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_nationkey").cast("long"), F.col("n_name"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_custkey").cast("long"), F.col("c_name"))
    return r.union(n).union(c).select(F.lit("world").alias("book"), "*")


def pathed(spark, sf_dir) -> DataFrame:
    t = tree(spark, sf_dir)
    return toc.paths(t.select("book", "node_id", "parent_id", "position")).join(t.drop("book"), "node_id")


def toc_paths(spark, sf_dir):
    return pathed(spark, sf_dir).select("node_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), F.size("path").cast("long").alias("depth"))


def toc_leaves(spark, sf_dir):
    return toc.leaves(tree(spark, sf_dir)).select("node_id", "title")


def toc_depth(spark, sf_dir):
    return toc.depth(pathed(spark, sf_dir)).select("book", F.col("depth").cast("long").alias("depth"), "n_nodes")


def toc_owner(spark, sf_dir):
    """Units are the regions with an even number and customers of every fifth key; the rest is owned through them."""
    p = pathed(spark, sf_dir)
    u = p.where("(parent_id is null and position % 2 = 0) or (node_id like 'c%' and position % 5 = 0)").select("book", "path", F.col("node_id").alias("file"))
    return toc.owners(p, u).select(F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), F.coalesce("owner", F.lit("-")).alias("owner"), "rule")


def toc_navigation(spark, sf_dir):
    p = pathed(spark, sf_dir).withColumn("hidden", (F.col("node_id").like("n%")) & (F.col("position") % 2 == 0))
    return toc.navigation(p).select("node_id", F.col("depth").cast("long").alias("depth"))


def toc_units(spark, sf_dir):
    p = pathed(spark, sf_dir).withColumn("first", F.col("position")).withColumn("last", F.col("position") + 1)
    return toc.units_at(p, 2).select(F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "first", "last", "n_nodes")


def toc_anchors(spark, sf_dir):
    return tree(spark, sf_dir).select("node_id", toc.anchor(F.col("node_id"), F.col("title"), F.when(F.col("position") % 3 == 0, F.lit("given"))).alias("anchor"))


def toc_identity(spark, sf_dir):
    t = tree(spark, sf_dir)
    return toc.identity_errors(t.unionByName(t.where("position % 10 = 0"))).select("node_id", "problem")


def toc_moves(spark, sf_dir):
    p = pathed(spark, sf_dir).select("book", "node_id", "path")
    q = p.where("node_id != 'c7'").withColumn("path", F.when(F.col("node_id") == "n3", F.array(F.lit(9), F.lit(9))).otherwise(F.col("path")))
    return toc.same_tree(p, q).select("node_id", "problem")


def interval_scope(spark, sf_dir):
    """Lines of documents in scopes that start at lines 1, 4 and 9."""
    d = L.unit_lines(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("unit"), "line_no")
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.explode(F.array(F.lit(2), F.lit(4), F.lit(9))).alias("first_line")).withColumn("scope", F.concat(F.lit("s"), "first_line"))
    out = toc.scope_of_lines(d, s)
    return out.groupBy("unit", F.coalesce("scope", F.lit("-")).alias("scope")).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("unit", "doc_id")


def token_ranges(spark, sf_dir):
    """Characters of the documents of a source from each to 100 ids on, by prefix sums."""
    d = table(spark, sf_dir, "documents")
    n = d.select(F.col("source").alias("book"), F.array(F.col("doc_id").cast("int")).alias("path"), F.col("doc_id").alias("first"), (F.col("doc_id") + 100).alias("last"))
    return toc.tokens_of_nodes(n, d.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("n_chars").alias("tokens"))).select("book", F.col("path")[0].cast("long").alias("doc_id"), "tokens")


def title_key_join(spark, sf_dir):
    """Titles of pages with first lines of documents that share a variant."""
    s = pages(spark, sf_dir).select(F.lit("b").alias("book"), F.col("page_id").alias("scope"), F.concat(F.lit("Chapter "), F.col("page_id").cast("string"), F.lit(": "), H.title(F.col("html"))).alias("title"))
    h = pages(spark, sf_dir).where("page_id % 3 != 0").select(F.lit("b").alias("book"), F.col("page_id").alias("heading"), H.title(F.col("html")).alias("title"))
    return toc.titled(s, h).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# glossaries


def forms(spark, sf_dir) -> DataFrame:
    """First three words of the benchmark's passages as forms."""
    b = table(spark, sf_dir, "benchmark")
    ws = G.words(F.col("text"))
    one = b.select(F.col("item_id").cast("string").alias("entry"), F.array_join(F.slice(ws, 1, 2), " ").alias("form"), (F.col("item_id") % 3).cast("int").alias("priority"), F.lit(False).alias("allow_short"))
    return one.unionByName(b.select(F.col("item_id").cast("string"), F.array_join(F.slice(ws, 2, 1), " ").alias("form"), F.lit(1).alias("priority"), F.lit(False).alias("allow_short")).toDF("entry", "form", "priority", "allow_short"))


def units(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text")


def benchmark_containment(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    return G.contained(units(spark, sf_dir), b).select(F.col("unit").alias("doc_id"), F.col("item").alias("item_id"))


def glossary_hits(spark, sf_dir):
    f = G.occurrences(units(spark, sf_dir), forms(spark, sf_dir).where("form like '% %'"))
    return f.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("n_docs"))


def glossary_resolved(spark, sf_dir):
    f = G.resolved(G.occurrences(units(spark, sf_dir), forms(spark, sf_dir)))
    return f.groupBy("unit").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("suppressed")).withColumnRenamed("unit", "doc_id")


def glossary_order(spark, sf_dir):
    return G.ordered(forms(spark, sf_dir)).select("entry", "priority", F.col("longest").cast("long").alias("longest"), F.col("place").cast("long").alias("place"))


def glossary_conflicts(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("entry"), F.col("p_brand").alias("form"), F.col("p_type").alias("target"))
    return G.conflicts(c).select("phrase", F.size("targets").cast("long").alias("n"))


def glossary_projection(spark, sf_dir):
    c = table(spark, sf_dir, "part")
    t = c.select(F.col("p_partkey").alias("entry"), F.explode(F.array(F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("preferred")), F.struct(F.lit("de").alias("lang"), F.concat(F.lit("de "), "p_brand").alias("preferred")))).alias("x"), "p_size", "p_type")
    t = t.select("entry", "x.lang", "x.preferred", F.array("p_type").alias("forms"), F.when(F.col("x.lang") == "de", "fixed").otherwise("free").alias("policy")).where("lang = 'en' or entry % 4 != 0")
    return G.projected(t, "en", "de").groupBy("target", "policy").agg(F.count(F.lit(1)).alias("n"))


# notes, on documents given marks


def marked(spark, sf_dir) -> DataFrame:
    """Documents whose numbers became references, with a definition for some."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.col("text"), F.lit(" a[^"), (F.col("doc_id") % 7).cast("string"), F.lit("] b[^"), (F.col("doc_id") % 5).cast("string"), F.lit("]\n\n[^"), (F.col("doc_id") % 3).cast("string"), F.lit("]: note "), F.col("doc_id").cast("string"))
    return d.select(F.col("source").alias("book"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), F.col("doc_id").alias("position"), body.alias("text"))


def scoped(spark, sf_dir) -> DataFrame:
    f = marked(spark, sf_dir)
    return N.scan(f).join(f.select("file", "book", F.concat("book", F.lit("-"), (F.col("position") % 2).cast("string")).alias("scope")), "file")


def note_occurrences(spark, sf_dir):
    return N.pairs(scoped(spark, sf_dir)).groupBy("scope", "key", "via").agg(F.count(F.lit(1)).alias("n"))


def note_graph(spark, sf_dir):
    m = scoped(spark, sf_dir).withColumn("book", F.col("scope"))
    return N.graph(m)


def note_style(spark, sf_dir):
    return N.style(scoped(spark, sf_dir))


def note_boundaries(spark, sf_dir):
    return N.across_files(marked(spark, sf_dir))


def note_numbering(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("place"), (F.col("doc_id") % 83).alias("number"), (F.col("doc_id") % 2).alias("section"), F.lit(1).alias("page"))
    out = N.numbering(d)
    return out.select("scope", "place", "finding", F.size("missing").cast("long").alias("n_missing"))


def note_definitions(spark, sf_dir):
    return N.definition_blocks(marked(spark, sf_dir)).select("file", "key", F.col("first_line").cast("long").alias("first_line"), "n_lines", "content")


def marker_asof(spark, sf_dir):
    """Events of each user: the last view before every error."""
    e = table(spark, sf_dir, "events").select(F.lit("b").alias("book"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("position"), "event_type")
    out = N.markers_bound(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"))
    return out.select("key", "position", F.coalesce("marker", F.lit(-1).cast("long")).alias("marker"))


def text_edits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars > 40").select(F.col("doc_id").alias("name"), "text")
    e = d.select("name", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((0, 3, "<<"), (10, 10, "+"), (20, 30, ""))])).alias("e")).select("name", "e.*")
    return N.edited(d, e).select(F.col("name").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def edit_audit(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 15).cast("long").alias("end"))
    n = o.select("name").distinct().withColumn("length", F.lit(70).cast("long"))
    return N.edit_errors(o, n)


# layout, on line items as blocks


def blocks(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_discount", "l_tax", "l_suppkey", "l_linestatus", "l_quantity")])
    x0 = (F.col("l_linenumber") % 2) * 0.5
    y0 = F.col("l_linenumber") * 0.1
    return li.select(
        (F.col("l_orderkey") % 100).cast("string").alias("book"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("block"), F.when(F.col("l_returnflag") == "R", "Footnote").when(F.col("l_returnflag") == "A", "Picture").otherwise("Text").alias("label"),
        x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_discount") * 4 + 0.1).alias("x1"), (y0 + 0.02 + F.col("l_tax") / 2).alias("y1"), F.concat(F.lit("["), F.col("l_suppkey").cast("string"), F.lit("] "), "l_linestatus").alias("text"), (F.col("l_quantity") % 5 + 8).alias("font_size"), F.col("l_linestatus").alias("font"),
        F.col("l_suppkey").alias("key"),
    )


def layout_pages(spark, sf_dir):
    s = Y.layout_summary(blocks(spark, sf_dir))
    return s.select("page", "n_blocks", F.array_join("keys", ",").alias("keys"), F.bround("top", 6).alias("top"), F.bround("bottom", 6).alias("bottom"), F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"))


def layout_fonts(spark, sf_dir):
    f = Y.font_profile(blocks(spark, sf_dir))
    return f.select("book", "body", F.array_join(F.col("note_sizes").cast("array<string>"), ",").alias("note_sizes"))


def layout_regions(spark, sf_dir):
    return Y.note_regions(blocks(spark, sf_dir)).select("page", F.col("region").cast("long").alias("region"), "n", F.col("text"))


def layout_tails(spark, sf_dir):
    return Y.tail_tolerance(blocks(spark, sf_dir)).select("page", F.bround("tolerance", 6).alias("tolerance"))


def layout_placement(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return b.groupBy(Y.placement(F.col("x0"), F.col("x1")).alias("placement")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.bround(Y.bottom_share(F.col("y0"), F.col("y1")), 4)).alias("share")).select("placement", "n", F.bround("share", 2).alias("share"))


def layout_illustrations(spark, sf_dir):
    return Y.illustration_pages(blocks(spark, sf_dir)).select("page", F.array_join("reasons", ",").alias("reasons"))


def page_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("book"), F.col("l_orderkey").alias("page"), (F.col("l_orderkey") - F.col("l_linenumber")).alias("printed"))
    return Y.pagination(d)


def page_chains(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("book"), F.col("l_suppkey").alias("key"), F.floor(F.col("l_orderkey") / 7).alias("page"))
    return Y.linked_chains(d, 2)


def windows_across(spark, sf_dir):
    return Y.windows_across(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 3).alias("book"), F.floor(F.col("o_orderkey") / 3).alias("page")))


QUERIES = {
    f.__name__: f
    for f in (
        html_title, html_links, html_tag_sequence, html_protected_tokens, html_plain_text, html_visible_text, html_units, html_codec_roundtrip, html_cleaned, mask_restore_roundtrip, broken_internal_links,
        event_props_json, lease_replay, lease_protocol, lease_latest, lease_sessions, escalation_state, backoff_deadline, inactive_topk, lease_conflicts, toc_paths, toc_leaves, toc_depth, toc_owner, toc_navigation,
        toc_units, toc_anchors, toc_identity, toc_moves, interval_scope, token_ranges, title_key_join, benchmark_containment, glossary_hits, glossary_resolved, glossary_order, glossary_conflicts, glossary_projection,
        note_occurrences, note_graph, note_style, note_boundaries, note_numbering, note_definitions, marker_asof, text_edits, edit_audit, layout_pages, layout_fonts, layout_regions, layout_tails, layout_placement,
        layout_illustrations, page_offsets, page_chains, windows_across,
    )
}

_E = "SELECT event_id, ts AS tm, CAST(user_id AS VARCHAR) AS task, event_type AS owner, CASE WHEN event_type = 'error' THEN 'release' ELSE 'claim' END AS action, props FROM events"
_TREE = """
t AS (SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(r_regionkey AS BIGINT) AS position, r_name AS title FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name FROM customer),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY position, node_id) AS INT) AS nth FROM t),
p AS (SELECT node_id, parent_id, position, title, [nth] AS path FROM o WHERE parent_id IS NULL UNION ALL SELECT o.node_id, o.parent_id, o.position, o.title, list_append(p.path, o.nth) FROM o JOIN p ON o.parent_id = p.node_id)"""
_PATH = "array_to_string(path, '.')"
_B = """
b AS (SELECT CAST(l_orderkey % 100 AS VARCHAR) AS book, l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS block, CASE l_returnflag WHEN 'R' THEN 'Footnote' WHEN 'A' THEN 'Picture' ELSE 'Text' END AS label, (l_linenumber % 2) * 0.5::DOUBLE AS x0,
  l_linenumber * 0.1::DOUBLE AS y0, (l_linenumber % 2) * 0.5::DOUBLE + l_discount * 4 + 0.1::DOUBLE AS x1, l_linenumber * 0.1::DOUBLE + 0.02::DOUBLE + l_tax / 2 AS y1, '[' || l_suppkey || '] ' || l_linestatus AS text, l_quantity % 5 + 8 AS font_size, l_suppkey AS key FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_suppkey) AS l_suppkey, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber))"""
_WORDS = r"list_filter(regexp_split_to_array(lower(translate(text, '‘’“”‐‑–—', '''''\"\"----')), '[^\p{L}\p{N}\p{M}_'']+'), lambda x: x != '')"
_MARKED = """
m AS (SELECT source AS book, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file, doc_id AS position, source || '-' || doc_id % 2 AS scope, [CAST(doc_id % 7 AS VARCHAR), CAST(doc_id % 5 AS VARCHAR)] AS refs, CAST(doc_id % 3 AS VARCHAR) AS def FROM documents)"""

ORACLE_SQL = {
    "title_key_join": r"""
WITH s AS (SELECT page_id, lower(trim(regexp_replace(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '[\s\x{85}\p{Z}]+', ' ', 'g'), ' ')) AS k FROM pages), n AS (SELECT k, count(*) AS n FROM s WHERE page_id % 3 != 0 AND k != '' GROUP BY k)
SELECT CASE WHEN n.n IS NULL THEN 'unmatched' WHEN n.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, count(*) AS n FROM s LEFT JOIN n USING (k) GROUP BY 1""",
    "layout_pages": f"""
WITH {_B}, k AS (SELECT *, regexp_extract(text, '^\\s*(?:\\[\\^?)?([0-9]{{1,4}})[\\].)]', 1) AS note FROM b)
SELECT page, count(*) AS n_blocks, coalesce(string_agg(note, ',' ORDER BY block) FILTER (label = 'Footnote' AND note != ''), '') AS keys, round_even(min(y0), 6) AS top, round_even(max(y1), 6) AS bottom,
  array_to_string(list_sort(list_distinct(list(CAST(least(floor(y0 * 20), 19) AS BIGINT)))), ',') AS bins FROM k GROUP BY page""",
    "layout_tails": f"""
WITH {_B}, r AS (SELECT page, y1 - y0 AS height, y0 - lag(y1) OVER (PARTITION BY page ORDER BY y0, block) AS gap FROM b WHERE y0 >= 0.5), h AS (SELECT page, median(height) AS h FROM r GROUP BY page),
g AS (SELECT page, median(gap) AS g FROM r JOIN h USING (page) WHERE gap > 0 AND gap <= 4 * h GROUP BY page)
SELECT page, round_even(greatest(1.5 * h, 2 * coalesce(g, 0), 1e-6), 6) AS tolerance FROM h LEFT JOIN g USING (page)""",
    "layout_placement": f"""
WITH {_B}, p AS (SELECT CASE WHEN x1 - x0 >= 0.72 THEN 'full' WHEN x1 <= 0.22 THEN 'left_margin' WHEN x0 >= 0.78 THEN 'right_margin' WHEN (x0 + x1) / 2 < 0.5 THEN 'left_column' ELSE 'right_column' END AS placement,
  round_even(greatest(0, y1 - greatest(y0, 0.75)) / greatest(y1 - y0, 1e-9), 4) AS share FROM b) SELECT placement, count(*) AS n, round_even(sum(share), 2) AS share FROM p GROUP BY placement""",
    "layout_illustrations": f"""
WITH {_B}, p AS (SELECT page, coalesce(max(CASE WHEN label = 'Picture' THEN (x1 - x0) * (y1 - y0) END), 0) AS largest, count(*) FILTER (label = 'Picture') AS n, coalesce(sum(length(trim(text))) FILTER (label != 'Picture'), 0) AS chars FROM b GROUP BY page),
r AS (SELECT page, array_to_string(list_filter([CASE WHEN largest >= 0.55 THEN 'large' END, CASE WHEN n > 0 AND chars <= 180 THEN 'little text' END, CASE WHEN n > 0 AND chars = 0 THEN 'alone' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p)
SELECT page, reasons FROM r WHERE reasons != ''""",
    "glossary_order": f"""
WITH w AS (SELECT CAST(item_id AS VARCHAR) AS entry, item_id % 3 AS p, {_WORDS} AS ws FROM benchmark),
f AS (SELECT entry, p AS priority, array_to_string(list_slice(ws, 1, 2), ' ') AS form FROM w UNION ALL SELECT entry, 1, array_to_string(list_slice(ws, 2, 2), ' ') FROM w),
e AS (SELECT entry, max(priority) AS priority, max(length(form)) AS longest, min(form) AS name FROM f GROUP BY entry)
SELECT entry, CAST(priority AS INT) AS priority, CAST(longest AS BIGINT) AS longest, CAST(row_number() OVER (ORDER BY priority DESC, longest DESC, name) AS BIGINT) AS place FROM e""",
    "note_style": f"""
WITH {_MARKED}, f AS (SELECT book, file, len(refs) AS refs, 1 AS defs FROM m), sh AS (SELECT book, bool_or(defs > 0 AND (refs = 0 OR (defs > 10 AND defs > 3 * refs))) AS notes, bool_or(refs > 0 AND defs = 0) AS body FROM f GROUP BY book),
k AS (SELECT book, key, bool_or(r) AS r, count(*) FILTER (NOT r) AS d FROM (SELECT book, unnest(refs) AS key, true AS r FROM m UNION ALL SELECT book, def, false FROM m) GROUP BY ALL),
fit AS (SELECT book, count(*) FILTER (r AND d = 0) AS lost, count(*) FILTER (d > 0) AS known, bool_or(d > 1) AS twice FROM k GROUP BY book)
SELECT book, CASE WHEN notes AND body AND NOT twice AND lost < 0.1 * known THEN 'GLOBAL' ELSE 'LOCAL' END AS style FROM sh JOIN fit USING (book)""",
    "note_boundaries": f"""
WITH {_MARKED}, n AS (SELECT doc_id AS position, len({LINES}) + 2 AS n_lines FROM documents WHERE text IS NOT NULL), o AS (SELECT m.*, n_lines, lead(file) OVER (PARTITION BY book ORDER BY position) AS next_file FROM m JOIN n USING (position)),
r AS (SELECT book, file, key, next_file FROM (SELECT book, file, def, next_file, unnest(refs) AS key FROM o) GROUP BY book, file, key, next_file, def HAVING count(*) = 1 AND key != def)
SELECT r.book, r.file, r.next_file, r.key FROM r JOIN o d ON d.book = r.book AND d.file = r.next_file AND d.def = r.key AND d.n_lines <= 20""",
    "html_title": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{85}\p{Z}]+', ' ', 'g'), ' ') AS title FROM pages",
    "html_links": r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^<>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages) SELECT page_id, CAST(unnest(range(1, len(hs) + 1)) AS BIGINT) AS nth, unnest(hs) AS href FROM h""",
    "html_tag_sequence": r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '</?([A-Za-z][A-Za-z0-9:-]*)(?:\s[^<>]*)?/?>', 1), lambda x: lower(x)), ' ') AS tags FROM pages",
    "html_protected_tokens": r"""
WITH t AS (SELECT page_id, regexp_extract_all(html, '(<!--(?s:.)*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);|\{\{[^{}]*\}\})', 1) AS ts FROM pages)
SELECT page_id, CAST(len(ts) AS BIGINT) AS n, sha256(array_to_string(ts, '|')) AS sha FROM t""",
    "html_plain_text": r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM t)
SELECT page_id, sha256(trim(regexp_replace(x, '[\s\x{85}\p{Z}]+', ' ', 'g'), ' ')) AS sha FROM u""",
    "html_codec_roundtrip": "SELECT page_id, CAST(length(html) AS BIGINT) AS chars, sha256(html) AS sha FROM pages",
    "mask_restore_roundtrip": r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '(<!--(?s:.)*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);|\{\{[^{}]*\}\})', 1)) AS BIGINT) AS n, true AS same FROM pages""",
    "event_props_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events",
    "lease_replay": f"""
WITH e AS ({_E}), a AS (SELECT task, floor(epoch(tm)) - floor(epoch(lag(tm) OVER (PARTITION BY task ORDER BY tm, event_id))) AS age FROM e)
SELECT task, count(*) FILTER (age IS NULL OR age >= 900) AS claimed, count(*) FILTER (age < 900) AS renewed FROM a GROUP BY task""",
    "lease_latest": f"""
WITH e AS ({_E}), l AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY tm DESC, event_id DESC) AS r, floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(tm)) AS age FROM e)
SELECT task, owner, CASE WHEN action = 'release' THEN 'released' WHEN age >= 900 THEN 'expired' ELSE 'active' END AS status, CAST(greatest(0, 900 - age) AS BIGINT) AS seconds_left FROM l WHERE r = 1""",
    "lease_sessions": f"""
WITH e AS ({_E}), b AS (SELECT *, coalesce(floor(epoch(tm)) - floor(epoch(lag(tm) OVER w)) >= 900, true) AS s FROM e WINDOW w AS (PARTITION BY task ORDER BY tm, event_id)),
r AS (SELECT *, sum(s::INT) OVER (PARTITION BY task ORDER BY tm, event_id) AS nth FROM b)
SELECT task, CAST(nth AS BIGINT) AS nth, count(*) AS n, CAST(floor(epoch(min(tm))) AS BIGINT) AS first_s, CAST(floor(epoch(max(tm))) AS BIGINT) AS last_s FROM r GROUP BY task, nth""",
    "escalation_state": f"""
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS file, owner = 'purchase' AS resolved FROM ({_E})), r AS (SELECT *, sum(resolved::INT) OVER w AS era, last_value(resolved) OVER (PARTITION BY task, file ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM e WINDOW w AS (PARTITION BY task, file ORDER BY tm, event_id)),
g AS (SELECT task, file, max(era) AS era, any_value(last) AS last FROM r GROUP BY task, file), n AS (SELECT task, file, era, count(*) FILTER (NOT resolved) AS n FROM r GROUP BY task, file, era)
SELECT task, file, CAST(n AS BIGINT) AS n, CASE WHEN last THEN 'resolved' WHEN n >= 2 THEN 'human_review_required' ELSE 'retry' END AS state FROM g JOIN n USING (task, file, era)""",
    "backoff_deadline": f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY tm, event_id) AS attempt FROM ({_E})), d AS (SELECT *, CAST(least(30 * pow(2, least(attempt, 20) - 1), 3600) AS BIGINT) AS seconds FROM e)
SELECT event_id, attempt, seconds, CAST(floor(epoch(tm)) AS BIGINT) + seconds AS at_s FROM d""",
    "inactive_topk": f"""
WITH e AS (SELECT *, CASE WHEN owner = 'view' THEN 'active' ELSE 'inactive' END AS status FROM ({_E}))
SELECT task, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY task, status ORDER BY tm DESC, event_id DESC) AS r FROM e) WHERE status = 'active' OR r <= 3""",
    "lease_conflicts": """
WITH f AS (SELECT DISTINCT event_id, unnest([json_extract_string(props, '$.k'), 'u' || user_id]) AS file FROM events) SELECT file, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM f GROUP BY file HAVING count(*) > 1""",
    "toc_paths": f"WITH RECURSIVE {_TREE} SELECT node_id, {_PATH} AS path, CAST(len(path) AS BIGINT) AS depth FROM p",
    "toc_leaves": f"WITH RECURSIVE {_TREE} SELECT node_id, title FROM t WHERE node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL)",
    "toc_depth": f"WITH RECURSIVE {_TREE} SELECT 'world' AS book, CAST(max(len(path)) AS BIGINT) AS depth, count(*) AS n_nodes FROM p",
    "toc_owner": f"""
WITH RECURSIVE {_TREE}, u AS (SELECT path, node_id AS file FROM p WHERE (parent_id IS NULL AND position % 2 = 0) OR (node_id LIKE 'c%' AND position % 5 = 0)),
up AS (SELECT p.path, arg_max(u.file, len(u.path)) AS f, max(len(u.path)) AS d FROM p JOIN u ON list_slice(p.path, 1, len(u.path)) = u.path GROUP BY p.path),
dn AS (SELECT p.path, arg_min(u.file, u.path) AS f FROM p JOIN u ON len(u.path) > len(p.path) AND list_slice(u.path, 1, len(p.path)) = p.path GROUP BY p.path)
SELECT {_PATH.replace('path', 'p.path')} AS path, coalesce(up.f, dn.f, '-') AS owner, CASE WHEN up.d = len(p.path) THEN 'own' WHEN up.f IS NOT NULL THEN 'ancestor' WHEN dn.f IS NOT NULL THEN 'descendant' ELSE 'none' END AS rule
FROM p LEFT JOIN up ON up.path = p.path LEFT JOIN dn ON dn.path = p.path""",
    "toc_navigation": f"""
WITH RECURSIVE {_TREE}, h AS (SELECT *, node_id LIKE 'n%' AND position % 2 = 0 AS hidden FROM p)
SELECT a.node_id, CAST(len(a.path) - (SELECT count(*) FROM h b WHERE b.hidden AND len(b.path) < len(a.path) AND list_slice(a.path, 1, len(b.path)) = b.path) AS BIGINT) AS depth FROM h a WHERE NOT a.hidden""",
    "toc_units": f"""
WITH RECURSIVE {_TREE} SELECT array_to_string(list_slice(path, 1, 2), '.') AS path, min(position) AS first, max(position + 1) AS last, count(*) AS n_nodes FROM p GROUP BY 1""",
    "toc_anchors": f"""
WITH RECURSIVE {_TREE} SELECT node_id, CASE WHEN position % 3 = 0 THEN 'given' ELSE substr(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) || '-' || substr(sha256(node_id), 1, 8) END AS anchor FROM t""",
    "toc_identity": f"WITH RECURSIVE {_TREE} SELECT node_id, 'duplicate' AS problem FROM t WHERE position % 10 = 0",
    "toc_moves": "SELECT 'c7' AS node_id, 'missing' AS problem UNION ALL SELECT 'n3', 'moved'",
    "interval_scope": f"""
WITH l AS (SELECT doc_id, unnest(range(1, len({LINES}) + 1)) AS n FROM documents) SELECT doc_id, CASE WHEN n >= 9 THEN 's9' WHEN n >= 4 THEN 's4' WHEN n >= 2 THEN 's2' ELSE '-' END AS scope, count(*) AS n FROM l GROUP BY 1, 2""",
    "token_ranges": """
SELECT a.source AS book, a.doc_id, CAST(sum(b.n_chars) AS BIGINT) AS tokens FROM documents a JOIN documents b ON a.source = b.source AND b.doc_id BETWEEN a.doc_id AND a.doc_id + 100 GROUP BY 1, 2""",
    "benchmark_containment": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "glossary_hits": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), f AS (SELECT CAST(item_id AS VARCHAR) AS entry, array_to_string(list_slice({_WORDS}, 1, 2), ' ') AS form FROM benchmark),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS form FROM d) SELECT entry, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM g JOIN f USING (form) GROUP BY entry""",
    "glossary_conflicts": r"""
WITH x AS (SELECT DISTINCT array_to_string(list_filter(regexp_split_to_array(lower(p_brand), '[^\p{L}\p{N}\p{M}_'']+'), lambda x: x != ''), ' ') AS phrase, p_type FROM part) SELECT phrase, count(*) AS n FROM x GROUP BY phrase HAVING count(*) > 1""",
    "glossary_projection": """
WITH f AS (SELECT p_partkey, p_brand, unnest(list_distinct([p_name, p_type])) AS form FROM part WHERE p_partkey % 4 != 0) SELECT 'de ' || p_brand AS target, 'fixed' AS policy, count(*) AS n FROM f GROUP BY p_brand""",
    "note_occurrences": f"""
WITH {_MARKED}, rf AS (SELECT book, scope, file, unnest(refs) AS key, unnest([1, 2]) AS place FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY book, scope, key ORDER BY file, place) AS nth FROM rf),
d AS (SELECT book, scope, def AS key, file, row_number() OVER (PARTITION BY book, scope, def ORDER BY file) AS nth FROM m), nd AS (SELECT book, scope, key, count(*) AS n FROM d GROUP BY ALL),
fr AS (SELECT book, key, file, row_number() OVER (PARTITION BY book, key ORDER BY file) AS g FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.book = d.book AND r.scope = d.scope AND r.key = d.key)),
orp AS (SELECT r.*, nd.n AS nd, CASE WHEN nd.n IS NULL THEN row_number() OVER (PARTITION BY r.book, r.key, nd.n IS NULL ORDER BY r.file, r.nth) END AS g FROM r LEFT JOIN nd USING (book, scope, key))
SELECT o.scope, o.key, CASE WHEN nd = 1 THEN 'shared' WHEN d.file IS NOT NULL THEN 'ordinal' WHEN fr.file IS NOT NULL THEN 'global' ELSE 'none' END AS via, count(*) AS n
FROM orp o LEFT JOIN d ON d.book = o.book AND d.scope = o.scope AND d.key = o.key AND d.nth = o.nth LEFT JOIN fr ON fr.book = o.book AND fr.key = o.key AND fr.g = o.g GROUP BY ALL""",
    "note_graph": f"""
WITH {_MARKED}, x AS (SELECT scope AS book, unnest(refs) AS key, 1 AS r, 0 AS d FROM m UNION ALL SELECT scope, def, 0, 1 FROM m), g AS (SELECT book, key, sum(r) AS r, sum(d) AS d FROM x GROUP BY ALL)
SELECT book, key, 'no definition' AS problem FROM g WHERE d = 0 UNION ALL SELECT book, key, 'no reference' FROM g WHERE r = 0 UNION ALL SELECT book, key, 'defined twice' FROM g WHERE d > 1""",
    "note_definitions": """
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file, CAST(doc_id % 3 AS VARCHAR) AS key, CAST(length(text) - length(replace(text, chr(10), '')) + 3 AS BIGINT) AS first_line, CAST(1 AS BIGINT) AS n_lines, 'note ' || doc_id AS content FROM documents""",
    "broken_internal_links": r"""
WITH l AS (SELECT page_id AS page, '/p' || page_id AS path, unnest(regexp_extract_all(html, '(?i)<a\s[^<>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
k AS (SELECT '/p' || page_id AS t FROM pages UNION SELECT '/p' || page_id || '#' || unnest(regexp_extract_all(html, '(?i)\s(?:id|name)\s*=\s*["'']([^"'']+)["'']', 1)) FROM pages)
SELECT page, href FROM l WHERE NOT regexp_matches(href, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)') AND CASE WHEN href LIKE '#%' THEN path || href ELSE href END NOT IN (SELECT t FROM k)""",
    "note_numbering": """
WITH w AS (SELECT source AS scope, doc_id AS place, doc_id % 83 AS n, doc_id % 2 AS s, lag(doc_id % 83) OVER o AS p, lag(doc_id % 2) OVER o AS ps FROM documents WINDOW o AS (PARTITION BY source ORDER BY doc_id))
SELECT scope, place, CASE WHEN n - p > 1 THEN 'gap' ELSE 'fall' END AS finding, CAST(CASE WHEN n - p > 1 THEN n - p - 1 ELSE 0 END AS BIGINT) AS n_missing FROM w WHERE n - p > 1 OR (n < p AND s = ps)""",
    "marker_asof": """
SELECT CAST(e.user_id AS VARCHAR) AS key, e.event_id AS position, coalesce((SELECT max(v.event_id) FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.event_id <= e.event_id), -1) AS marker FROM events e WHERE event_type = 'error'""",
    "text_edits": "SELECT doc_id, sha256('<<' || substr(text, 4, 7) || '+' || substr(text, 11, 10) || substr(text, 31)) AS sha FROM documents WHERE n_chars > 40",
    "edit_audit": """
WITH e AS (SELECT l_orderkey AS name, CAST(l_linenumber * 10 AS BIGINT) AS s, CAST(l_linenumber * 10 + CAST(l_quantity AS INT) % 15 AS BIGINT) AS x FROM lineitem),
w AS (SELECT *, max(x) OVER (PARTITION BY name ORDER BY s, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, lag(s) OVER (PARTITION BY name ORDER BY s, x) AS ps, lag(x) OVER (PARTITION BY name ORDER BY s, x) AS px FROM e)
SELECT name, s AS start, x AS "end", CASE WHEN x > 70 THEN 'range' WHEN coalesce(s = ps AND x = px, false) THEN 'duplicate' ELSE 'overlap' END AS problem FROM w WHERE x > 70 OR b > s OR coalesce(s = ps AND x = px, false)""",
    "layout_fonts": f"""
WITH {_B}, s AS (SELECT book, round_even(font_size, 1) AS size, sum(length(text)) AS chars, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT book, arg_max(size, chars * 100 + size) AS body FROM s GROUP BY book)
SELECT book, body, coalesce((SELECT string_agg(CAST(size AS VARCHAR), ',' ORDER BY size DESC) FROM s WHERE s.book = m.book AND size < body AND n >= 2), '') AS note_sizes FROM m""",
    "layout_regions": f"""
WITH {_B}, s AS (SELECT *, CASE WHEN x1 - x0 >= 0.72 THEN 'f' WHEN x1 <= 0.22 THEN 'l' WHEN x0 >= 0.78 THEN 'r' WHEN (x0 + x1) / 2 < 0.5 THEN 'c' ELSE 'd' END AS side FROM b),
w AS (SELECT *, coalesce(block = lag(block) OVER o + 1 AND side = lag(side) OVER o AND abs(y0 - lag(y1) OVER o) <= 0.035 AND greatest(0, least(x1, lag(x1) OVER o) - greatest(x0, lag(x0) OVER o)) / greatest(least(x1 - x0, lag(x1) OVER o - lag(x0) OVER o), 1e-9) >= 0.2, false) AS linked FROM s WINDOW o AS (PARTITION BY page ORDER BY block)),
r AS (SELECT *, sum((NOT linked)::INT) OVER (PARTITION BY page ORDER BY block) AS region FROM w) SELECT page, CAST(region AS BIGINT) AS region, count(*) AS n, string_agg(text, chr(10) ORDER BY block) AS text FROM r GROUP BY page, region""",
    "page_offsets": """
WITH n AS (SELECT l_orderkey % 100 AS book, CAST(l_linenumber AS BIGINT) AS "offset", count(*) AS n FROM lineitem GROUP BY ALL)
SELECT book, "offset", n, CASE WHEN n >= 3 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, "offset") AS r FROM n) WHERE r = 1""",
    "page_chains": """
WITH p AS (SELECT DISTINCT l_orderkey % 7 AS book, l_suppkey AS key, CAST(floor(l_orderkey / 7) AS BIGINT) AS page FROM lineitem), r AS (SELECT *, page - row_number() OVER (PARTITION BY book, key ORDER BY page) AS run FROM p)
SELECT book, key, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM r GROUP BY book, key, run HAVING count(*) >= 2""",
    "windows_across": """
WITH p AS (SELECT DISTINCT o_orderkey % 3 AS book, CAST(floor(o_orderkey / 3) AS BIGINT) AS page FROM orders WHERE o_orderstatus = 'F') SELECT a.book, a.page, a.page + 1 AS next_page FROM p a JOIN p b ON a.book = b.book AND b.page = a.page + 1""",
}
