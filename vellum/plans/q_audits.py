"""Queries of audits, receipts, packing, merging and similarity over documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits as A
from ..operators import layout, merging, packing, receipts
from .q_lines import LINES
from .session import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def books(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")


def turn_pairs(spark, sf_dir) -> DataFrame:
    """The n-th user turn with the n-th answer of a conversation."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    c = A.ordinal_in(c, ["conv_id", "role"], "turn", "nth")
    u = c.where("role = 'user'").select("conv_id", "nth", F.col("turn").alias("user_turn"), F.col("text").alias("source"))
    a = c.where("role = 'assistant'").select("conv_id", "nth", F.col("turn").alias("reply_turn"), F.col("text").alias("target"))
    return u.join(a, ["conv_id", "nth"], "left")


def turn_pairing(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", F.col("nth").cast("long").alias("nth"), "user_turn", F.coalesce("reply_turn", F.lit(-1).cast("long")).alias("reply_turn"), F.col("target").isNull().alias("missing"))


def refusal_scan(spark, sf_dir):
    """Pairs of turns; a refusal was added to the answers of every fifth conversation, and to both sides of every fifth after."""
    p = turn_pairs(spark, sf_dir).select("conv_id", F.concat("conv_id", F.lit(":"), "nth").alias("unit"), "source", "target")
    said = lambda c, *of: F.when((F.col("conv_id") % 5).isin(*of), F.concat(c, F.lit("\nI’m unable to help with this."))).otherwise(F.col(c))
    return A.refusals(p.select("unit", said("source", 1).alias("source"), said("target", 0, 1).alias("target"))).withColumn("line_no", F.col("line_no").cast("long"))


def bilingual_runs(spark, sf_dir):
    """Documents of one text, next to each other: the first run of long unchanged lines."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = docs(spark, sf_dir).select("doc_id", "text", F.lag("text").over(w).alias("before"))
    return d.select("doc_id", A.unchanged_run(F.col("before"), F.concat("before", F.lit("\nmore"))).alias("r")).where("r is not null").select("doc_id", F.col("r.start").cast("long").alias("start_line"), F.col("r.end").cast("long").alias("end_line"))


def text_diff_summary(spark, sf_dir):
    p = turn_pairs(spark, sf_dir).where("target is not null").select("conv_id", F.col("nth").cast("long").alias("nth"), A.diff_summary(F.col("source"), F.col("target")).alias("d"))
    return p.select("conv_id", "nth", F.col("d.source_lines").cast("long").alias("source_lines"), F.col("d.target_lines").cast("long").alias("target_lines"), F.col("d.lines_changed").alias("lines_changed"), F.col("d.headings_changed").alias("headings_changed"), F.col("d.fences_changed").alias("fences_changed"))


def missing_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("turn % 3 != 1").withColumn("n", F.col("turn") + 1)
    return receipts.missing_numbers(c, "conv_id", "n")


def identical_turns(spark, sf_dir):
    """Runs of turns of one conversation with equal texts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("turns", F.coalesce((F.lag("role").over(w) != F.col("role")).cast("long"), F.lit(1).cast("long")))
    c = c.withColumn("run", F.sum("turns").over(w))
    return c.groupBy("conv_id", "run").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


def duplicate_docs_sha(spark, sf_dir):
    return receipts.duplicate_groups(docs(spark, sf_dir), "doc_id", "text").select("sha256", "n", F.col("first_name").alias("first_doc"))


def duplicate_blocks(spark, sf_dir):
    """Lines as blocks: those a document has more often than its predecessor of the same source."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("unit"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("target"), F.replace(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("source"))
    out = A.duplicated_blocks(d)
    return out.select(F.col("unit").alias("doc_id"), F.sha2(F.col("block").cast("binary"), 256).alias("block"), "n_source", "n_target")


def source_fingerprint(spark, sf_dir):
    return receipts.fingerprint(docs(spark, sf_dir), "source", "doc_id", "text")


def set_digests(spark, sf_dir):
    return receipts.set_digest(docs(spark, sf_dir), "source", "lang")


def resume_pending(spark, sf_dir):
    """Receipts of a third of the documents are stale, of labelled ones valid by their label."""
    d = docs(spark, sf_dir)
    now = receipts.receipts(d, "doc_id", "text", "now").select("name", "sha256")
    done = now.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("valid")), "name")
    done = done.withColumn("sha256", F.when(F.col("name") % 3 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return receipts.pending(now, done)


def snapshot_diff(spark, sf_dir):
    now = receipts.receipts(docs(spark, sf_dir), "doc_id", "text", "now").select("name", "sha256")
    before = now.where("name % 7 != 0").withColumn("sha256", F.when(F.col("name") % 5 == 0, F.lit("other")).otherwise(F.col("sha256")))
    return receipts.changes(before, now.where("name % 11 != 0"))


def snapshot_current(spark, sf_dir):
    now = receipts.receipts(docs(spark, sf_dir), "doc_id", "text", "now").select("name", "sha256")
    return receipts.same_content(now, now.where("name % 11 != 0"))


def effective_decisions(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") > 1000, "body").otherwise("note").alias("role"), F.when(F.col("doc_id") % 2 == 0, "low").otherwise("high").alias("confidence"))
    e = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("role"), (F.col("toxic") == 1).alias("override"))
    return receipts.effective_decisions(d, e, ["doc_id"])


def undecided_docs(spark, sf_dir):
    return receipts.undecided(docs(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"])


def decision_bijection(spark, sf_dir):
    return receipts.bijection(docs(spark, sf_dir).where("doc_id % 4 != 3"), table(spark, sf_dir, "labels"), ["doc_id"])


def stats(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("source", "doc_id", T.estimated_tokens(t).alias("tokens"), F.octet_length(t).cast("long").alias("bytes"), F.size(F.filter(T.lines(t), lambda x: F.trim(x) != "")).cast("long").alias("lines"))


def unit_packing(spark, sf_dir):
    return packing.batches(stats(spark, sf_dir), "source", "doc_id")


def batch_queue(spark, sf_dir):
    s = stats(spark, sf_dir)
    return packing.batch_queue(packing.batches(s, "source", "doc_id"), s, "source", "doc_id")


def severity_class(spark, sf_dir):
    s = stats(spark, sf_dir)
    return s.select("doc_id", "tokens", packing.severity(F.col("tokens"), 500, 3000).alias("severity"))


def dispatch_waves(spark, sf_dir):
    s = stats(spark, sf_dir).withColumn("severity", packing.severity(F.col("tokens"), 500, 3000))
    return packing.waves(s, "source", "doc_id").select("source", "doc_id", F.col("wave").cast("long").alias("wave"), "reason", F.col("slots").cast("long").alias("slots"))


def dispatch_waves_reordered(spark, sf_dir):
    s = stats(spark, sf_dir).withColumn("severity", packing.severity(F.col("tokens"), 500, 3000))
    return packing.waves(s, "source", "doc_id", reorder=True).select("source", "doc_id", F.col("wave").cast("long").alias("wave"), "reason")


def concurrency_caps(spark, sf_dir):
    return packing.concurrency(stats(spark, sf_dir), "source").select("source", "severity", F.col("slots").cast("long").alias("slots"))


def balanced_workers(spark, sf_dir):
    """Loads of six workers for each source."""
    s = stats(spark, sf_dir)
    return packing.balanced(s, "source", "doc_id").join(s, ["source", "doc_id"]).groupBy("source", "worker").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def split_units(spark, sf_dir):
    """Long documents cut into parts of about 300 tokens at line ends."""
    b = docs(spark, sf_dir).select(F.col("doc_id").alias("unit"), F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    b = b.select("unit", (F.col("i") + 1).alias("block_no"), T.estimated_tokens(F.col("line")).alias("tokens"))
    return packing.split_units(b, 300).groupBy("unit").agg(F.max("part").alias("n_parts"), F.count(F.lit(1)).alias("n_blocks")).withColumnRenamed("unit", "doc_id")


def token_ochiai_adjacent(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = docs(spark, sf_dir).select("source", "doc_id", layout.content_words(F.col("text")).alias("ws")).withColumn("before", F.lag("ws").over(w)).where("before is not null")
    return d.select("doc_id", F.size(F.array_intersect("ws", "before")).cast("long").alias("shared"), F.bround(layout.ochiai(F.col("ws"), F.col("before")), 6).alias("similarity"))


def soft_join_candidates(spark, sf_dir):
    return merging.soft_joins(books(spark, sf_dir))


def boundary_preview(spark, sf_dir):
    return merging.boundary_preview(books(spark, sf_dir))


def merged_units(spark, sf_dir):
    m = merging.merged(books(spark, sf_dir))
    return m.select("book", "first_page", "last_page", "n_pages", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def repeated_header_pages(spark, sf_dir):
    b = books(spark, sf_dir).withColumn("text", F.concat(F.lit("## Part "), (F.col("page") % 120).cast("string").substr(1, 1), F.lit("\n"), "text"))
    return merging.repeated_headers_removed(b).select("book", "page", "removed", F.char_length("text").cast("long").alias("chars"))


def unit_boundaries(spark, sf_dir):
    u = docs(spark, sf_dir).select(F.col("source").alias("book"), F.col("doc_id").alias("unit"), F.col("doc_id").alias("first_page"), (F.col("doc_id") + 19).alias("last_page"), (F.col("doc_id") % 3 + 1).alias("first_line"), F.when(F.col("doc_id") % 10 == 0, F.lit(9)).cast("long").alias("last_line"))
    return merging.unit_boundaries(u).fillna(0, ["last_line"])


def integrity_check(spark, sf_dir):
    """Documents against themselves without their numbers."""
    p = docs(spark, sf_dir).select(F.col("doc_id").alias("unit"), F.col("text").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[0-9]", "")).otherwise(F.col("text")).alias("target"))
    return A.integrity(p).select(F.col("unit").alias("doc_id"), F.size("missing").cast("long").alias("n_missing"))


def language_density(spark, sf_dir):
    target = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[a-z]", "中")).otherwise(F.col("text"))
    d = docs(spark, sf_dir).select("doc_id", A.language_density(F.col("text"), target).alias("r"))
    return d.select("doc_id", "r.ratio", "r.blocked")


def label_survival(spark, sf_dir):
    """First lines as labels that the rest of the document doesn't show again."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("unit"), T.lines(F.col("text")).alias("ls"))
    labels = d.select("unit", F.col("ls")[0].alias("label"))
    rest = d.select("unit", F.explode(F.expr("slice(ls, 2, greatest(size(ls), 1))")).alias("line"))
    return A.lost_labels(labels, rest).select(F.col("unit").alias("doc_id"))


QUERIES = {
    f.__name__: f
    for f in (
        turn_pairing, refusal_scan, bilingual_runs, text_diff_summary, missing_turns, identical_turns, duplicate_docs_sha, duplicate_blocks, source_fingerprint, set_digests, resume_pending, snapshot_diff,
        snapshot_current, effective_decisions, undecided_docs, decision_bijection, unit_packing, batch_queue, severity_class, dispatch_waves, dispatch_waves_reordered, concurrency_caps, balanced_workers,
        split_units, token_ochiai_adjacent, soft_join_candidates, boundary_preview, merged_units, repeated_header_pages, unit_boundaries, integrity_check, language_density, label_survival,
    )
}

_SHA = "sha256(coalesce(text, ''))"
_STATS = f"SELECT source, doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, strlen(text) AS bytes, len(list_filter({LINES}, lambda x: trim(x, ' ') != '')) AS lines FROM documents"
_SEV = "CASE WHEN tokens >= 3000 THEN 'extreme' WHEN tokens >= 500 THEN 'large' ELSE 'ordinary' END"
_PACK = f"""
s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, tokens > 12000 OR bytes > 30000 OR lines > 350 AS iso FROM ({_STATS})),
r AS (SELECT source, doc_id, rn, iso, 1 AS batch, 1 AS files, tokens AS t, lines AS l FROM s WHERE rn = 1
  UNION ALL SELECT s.source, s.doc_id, s.rn, s.iso, r.batch + CASE WHEN b THEN 1 ELSE 0 END, CASE WHEN b THEN 1 ELSE r.files + 1 END, CASE WHEN b THEN s.tokens ELSE r.t + s.tokens END, CASE WHEN b THEN s.lines ELSE r.l + s.lines END
  FROM (SELECT s.*, r.batch AS pb, r.iso OR s.iso OR r.files >= 5 OR r.t + s.tokens > 12000 OR r.l + s.lines > 350 AS b FROM s JOIN r ON s.source = r.source AND s.rn = r.rn + 1) s JOIN r ON s.source = r.source AND s.rn = r.rn + 1)"""
_WAVES = """
w AS (SELECT *, CASE severity WHEN 'extreme' THEN 1 WHEN 'large' THEN 2 ELSE 3 END AS slots, coalesce(lag(severity) OVER o != severity, true) AS turn, row_number() OVER o AS place FROM s WINDOW o AS (PARTITION BY source ORDER BY {order})),
x AS (SELECT *, sum(turn::INT) OVER (PARTITION BY source ORDER BY place) AS run FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY place) AS nth FROM x)
SELECT source, doc_id, CAST(sum(((nth - 1) % slots = 0)::INT) OVER (PARTITION BY source ORDER BY place) AS BIGINT) AS wave, severity AS reason{more} FROM y"""
_ENDS = r"""[.!?。！？…:：;；]["'”’»」』）)\]]*\s*$"""
_START = r"^\s*(?:#{1,6}\s|[-*+]\s|\d{1,3}[.)]\s|>|\||```|!\[|\[\^|<)"
_EDGES = f"e AS (SELECT source AS book, doc_id AS page, text, list_filter({LINES}, lambda x: trim(x, ' ') != '') AS ls FROM documents), f AS (SELECT book, page, text, ls[1] AS head, ls[-1] AS tail FROM e)"
_Q = lambda s: s.replace("'", "''")
_JOINS = f"coalesce(trim({{t}}, ' ') != '' AND trim({{h}}, ' ') != '' AND NOT regexp_matches({{t}}, '{_Q(_ENDS)}') AND NOT regexp_matches({{t}}, '^\\s*(?:#{{{{1,6}}}}\\s|\\|)') AND NOT regexp_matches({{h}}, '{_Q(_START).replace('{', '{{').replace('}', '}}')}'), false)"
_SEP = r"CASE WHEN regexp_matches({t}, '[-‐‑]\s*$') OR regexp_matches({h}, '^\s*[,.;:!?)\]»”’、。，；：！？]') THEN '' ELSE ' ' END"

_NOT_PROSE = (
    r"(?m)^\s{0,3}\[\^[^\]\n]+\]:[^\n]*(?:\n[ \t]+[^\n]*)*", r"(?s)```.*?```", r"!?\[[^\]]*\]\([^)]*\)", r"(?i)https?://\S+|www\.\S+", r"`[^`]*`", r"(?s)\$\$?.*?\$\$?", r"<[^>]+>",
)


def _prose(c: str) -> str:
    """SQL of a text without notes, code, links and mathematics."""
    out = f"coalesce({c}, '')"
    for pattern in _NOT_PROSE:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return out


ORACLE_SQL = {
    "refusal_scan": f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT u.conv_id || ':' || u.nth AS unit, a.text || chr(10) || 'x' AS text FROM (SELECT * FROM c WHERE role = 'user') u JOIN (SELECT * FROM c WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.nth = a.nth WHERE u.conv_id % 5 = 0 AND a.text IS NOT NULL)
SELECT unit, len(list_filter({LINES}, lambda x: trim(x, ' ') != '')) AS line_no, 'English refusal' AS kind FROM p""",
    "label_survival": rf"""
WITH l AS (SELECT doc_id, list_transform({LINES}, lambda x: lower(regexp_replace(regexp_replace(x, '^\s*#{{1,6}}\s*', ''), '[^\p{{L}}\p{{N}}\p{{M}}_]', '', 'g'))) AS ks FROM documents)
SELECT doc_id FROM l WHERE coalesce(ks[1], '') = '' OR NOT list_contains(ks[2:], ks[1])""",
    "boundary_preview": rf"""
WITH {_EDGES}, g AS (SELECT book, page, tail, lead(head) OVER (PARTITION BY book ORDER BY page) AS nh FROM f)
SELECT book, page, right(tail, 40) AS tail, substr(nh, 1, 40) AS head,
  CASE WHEN NOT regexp_matches(nh, '^\s*\p{{Ll}}') THEN 'low' WHEN regexp_matches(tail, '\p{{L}}[-‐‑]\s*$') THEN 'high' ELSE 'medium' END AS severity FROM g WHERE {_JOINS.format(t='tail', h='nh')}""",
    "bilingual_runs": f"""
WITH d AS (SELECT doc_id, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS text FROM documents),
l AS (SELECT doc_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS n FROM d WHERE text IS NOT NULL),
f AS (SELECT doc_id, n, length(trim(line, ' ')) >= 80 AND len(regexp_extract_all(trim(line, ' '), '[A-Za-z]')) >= 60 AS long FROM l), s AS (SELECT doc_id, min(n) AS s, max(n) AS last FROM f WHERE long GROUP BY doc_id),
e AS (SELECT doc_id, s, coalesce((SELECT min(f.n) FROM f WHERE f.doc_id = s.doc_id AND f.n > s.s AND NOT long) - 1, last) AS e FROM s)
SELECT doc_id, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line FROM e WHERE e > s""",
    "balanced_workers": f"""
WITH RECURSIVE s AS (SELECT source, tokens, row_number() OVER (PARTITION BY source ORDER BY tokens DESC, doc_id) AS rn FROM ({_STATS})),
r AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS tokens, 0 AS worker, CAST([0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads FROM s
  UNION ALL SELECT s.source, s.rn, s.tokens, list_position(loads, list_min(loads)), list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN s.tokens ELSE 0 END) FROM r JOIN s ON s.source = r.source AND s.rn = r.rn + 1)
SELECT source, CAST(worker AS BIGINT) AS worker, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM r WHERE rn > 0 GROUP BY source, worker""",
    "split_units": f"""
WITH RECURSIVE b AS (SELECT doc_id, list_transform({LINES}, lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT)) AS ts FROM documents),
r AS (SELECT doc_id, ts, 1 AS k, 1 AS part, ts[1] AS size FROM b WHERE len(ts) > 0
  UNION ALL SELECT doc_id, ts, k + 1, part + (size > 0 AND size + ts[k + 1] > 300)::INT, CASE WHEN size > 0 AND size + ts[k + 1] > 300 THEN ts[k + 1] ELSE size + ts[k + 1] END FROM r WHERE k < len(ts))
SELECT doc_id, CAST(part - (part > 1 AND size < 45)::INT AS BIGINT) AS n_parts, CAST(k AS BIGINT) AS n_blocks FROM r WHERE k = len(ts)""",
    "language_density": r"""
WITH p AS (SELECT doc_id, text AS s, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[a-z]', '中', 'g') ELSE text END AS t FROM documents),
c AS (SELECT doc_id, {s} AS s, {t} AS t FROM p), n AS (SELECT doc_id, len(regexp_extract_all(s, '{latin}')) AS ls, len(regexp_extract_all(t, '{latin}')) AS lt, len(regexp_extract_all(t, '{cjk}')) AS ct FROM c),
q AS (SELECT doc_id, CASE WHEN ls >= 120 AND lt + ct >= 80 THEN ct / (lt + ct) END AS ratio FROM n) SELECT doc_id, round_even(ratio, 4) AS ratio, coalesce(ratio < 0.6::DOUBLE, false) AS blocked FROM q""".format(
        s=_prose("s"), t=_prose("t"), latin=r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", cjk=r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
    ),
    "duplicate_blocks": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lag(text) OVER (PARTITION BY source ORDER BY doc_id), '') AS s FROM documents),
x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, 1 AS n_t, 0 AS n_s FROM d UNION ALL SELECT doc_id, unnest(string_split(s, chr(10))), 0, 1 FROM d),
l AS (SELECT *, trim(regexp_replace(regexp_replace(line, '!\[[^\]]*\]\([^)]*\)|<sup>\s*\d+\s*</sup>|\[\^\s*\d+\s*\]:?|<[^>]+>', ' ', 'gi'), '[\s\x{85}\p{Z}]+', ' ', 'g'), ' ') AS block FROM x
  WHERE NOT regexp_matches(trim(line, ' '), '^#{1,6}\s') AND NOT regexp_full_match(replace(trim(line, ' '), ' ', ''), '[-*_]{3,}')),
b AS (SELECT doc_id, block, sum(n_s) AS n_source, sum(n_t) AS n_target FROM l WHERE length(block) >= 24 OR len(regexp_extract_all(block, '[\p{L}\p{N}\p{M}_]+')) >= 8 GROUP BY ALL)
SELECT doc_id, sha256(block) AS block, CAST(n_source AS BIGINT) AS n_source, CAST(n_target AS BIGINT) AS n_target FROM b WHERE n_target > 1 AND n_target > n_source""",
    "turn_pairing": """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE role IN ('user', 'assistant'))
SELECT u.conv_id, u.nth, u.turn AS user_turn, coalesce(a.turn, -1) AS reply_turn, a.turn IS NULL AS missing FROM (SELECT * FROM c WHERE role = 'user') u LEFT JOIN (SELECT * FROM c WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.nth = a.nth""",
    "missing_turns": """
WITH c AS (SELECT DISTINCT conv_id, turn + 1 AS n FROM conversations WHERE turn % 3 != 1)
SELECT conv_id, g AS missing FROM (SELECT conv_id, unnest(range(1, max(n))) AS g FROM c GROUP BY conv_id) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = x.conv_id AND c.n = x.g)""",
    "identical_turns": """
WITH t AS (SELECT *, coalesce(lag(role) OVER w != role, true) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(b::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM r GROUP BY conv_id, run""",
    "duplicate_docs_sha": f"SELECT {_SHA} AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "source_fingerprint": f"SELECT source, count(*) AS n, sha256(string_agg({_SHA}, ',' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source",
    "set_digests": "SELECT source, count(*) AS n, sha256(string_agg(lang, chr(10) ORDER BY lang)) AS digest FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source",
    "resume_pending": f"""
WITH n AS (SELECT doc_id AS name, {_SHA} AS sha FROM documents), d AS (SELECT name, CASE WHEN name % 3 = 0 THEN 'old' ELSE sha END AS sha, quality = 1 AS valid FROM n JOIN labels ON doc_id = name)
SELECT n.name, CASE WHEN d.name IS NULL THEN 'missing' WHEN d.sha != n.sha THEN 'stale' ELSE 'invalid' END AS reason FROM n LEFT JOIN d USING (name) WHERE NOT coalesce(d.sha = n.sha AND d.valid, false)""",
    "snapshot_diff": """
SELECT doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents
WHERE (doc_id % 7 = 0 AND doc_id % 11 != 0) OR (doc_id % 7 != 0 AND doc_id % 11 = 0) OR (doc_id % 7 != 0 AND doc_id % 5 = 0)""",
    "snapshot_current": "SELECT count(*) FILTER (doc_id % 11 = 0) AS n_missing, CAST(0 AS BIGINT) AS n_extra, count(*) FILTER (doc_id % 11 = 0) = 0 AS current FROM documents",
    "effective_decisions": """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND (toxic = 1 OR d.doc_id % 2 = 0) THEN CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END WHEN n_chars > 1000 THEN 'body' ELSE 'note' END AS role,
  CASE WHEN l.doc_id IS NOT NULL AND (toxic = 1 OR d.doc_id % 2 = 0) THEN 'explicit' WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE 'local' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "undecided_docs": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "decision_bijection": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'undecided' ELSE 'unknown' END AS problem
FROM (SELECT doc_id FROM documents WHERE doc_id % 4 != 3) d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "unit_packing": f"WITH RECURSIVE {_PACK} SELECT source, doc_id, CAST(batch AS BIGINT) AS batch, iso AS isolated FROM r",
    "batch_queue": f"""WITH RECURSIVE {_PACK}
SELECT r.source, CAST(r.batch AS BIGINT) AS batch, count(*) AS n_units, CAST(sum(s.tokens) AS BIGINT) AS tokens, CASE WHEN max(s.tokens) >= 24000 THEN 'extreme' WHEN max(s.tokens) >= 12000 THEN 'large' ELSE 'ordinary' END AS severity
FROM r JOIN s ON r.doc_id = s.doc_id GROUP BY r.source, r.batch""",
    "severity_class": f"SELECT doc_id, tokens, {_SEV} AS severity FROM ({_STATS})",
    "dispatch_waves": f"WITH s AS (SELECT *, {_SEV} AS severity FROM ({_STATS})), {_WAVES.format(order='doc_id', more=', CAST(slots AS BIGINT) AS slots')}",
    "dispatch_waves_reordered": f"""
WITH s0 AS (SELECT *, {_SEV} AS severity FROM ({_STATS})), s AS (SELECT *, sum((severity = 'extreme')::INT) OVER (PARTITION BY source ORDER BY doc_id) AS seg FROM s0),
{_WAVES.format(order="seg, CASE severity WHEN 'extreme' THEN 0 WHEN 'ordinary' THEN 1 ELSE 2 END, doc_id", more='')}""",
    "concurrency_caps": f"""
SELECT source, CASE WHEN max(tokens) >= 24000 THEN 'extreme' WHEN max(tokens) >= 12000 THEN 'large' ELSE 'ordinary' END AS severity, CAST(CASE WHEN max(tokens) >= 24000 THEN 1 WHEN max(tokens) >= 12000 THEN 2 ELSE 3 END AS BIGINT) AS slots
FROM ({_STATS}) GROUP BY source""",
    "token_ochiai_adjacent": r"""
WITH w AS (SELECT source, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}_]+'), lambda x: length(x) >= 4)) AS ws FROM documents),
p AS (SELECT doc_id, ws, lag(ws) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM w)
SELECT doc_id, CAST(len(list_intersect(ws, b)) AS BIGINT) AS shared, CASE WHEN len(ws) * len(b) = 0 THEN 0.0 ELSE round_even(len(list_intersect(ws, b)) / sqrt(len(ws)::DOUBLE * len(b)), 6) END AS similarity FROM p WHERE b IS NOT NULL""",
    "soft_join_candidates": f"""
WITH {_EDGES}, g AS (SELECT book, page, tail, lead(page) OVER w AS next_page, lead(head) OVER w AS nh FROM f WINDOW w AS (PARTITION BY book ORDER BY page))
SELECT book, page, next_page, {_SEP.format(t='tail', h='nh')} AS sep FROM g WHERE {_JOINS.format(t='tail', h='nh')}""",
    "merged_units": f"""
WITH {_EDGES}, g AS (SELECT book, page, text, head, lag(tail) OVER (PARTITION BY book ORDER BY page) AS pt FROM f),
h AS (SELECT *, {_JOINS.format(t='pt', h='head')} AS joins FROM g), r AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY book ORDER BY page) AS run FROM h)
SELECT book, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, sha256(string_agg(CASE WHEN joins THEN {_SEP.format(t='pt', h='head')} ELSE '' END || trim(text, ' '), '' ORDER BY page)) AS sha FROM r GROUP BY book, run""",
    "repeated_header_pages": """
WITH p AS (SELECT source AS book, doc_id AS page, '## Part ' || substr(CAST(doc_id % 120 AS VARCHAR), 1, 1) AS h, text FROM documents),
q AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY book ORDER BY page) = h, false) AS removed FROM p)
SELECT book, page, removed, CAST(CASE WHEN removed THEN length(text) ELSE length(h) + 1 + length(text) END AS BIGINT) AS chars FROM q""",
    "unit_boundaries": """
WITH u AS (SELECT source AS book, doc_id AS unit, doc_id AS fp, doc_id + 19 AS lp, doc_id % 3 + 1 AS fl, CASE WHEN doc_id % 10 = 0 THEN 9 END AS ll FROM documents),
n AS (SELECT *, lead(fp) OVER w AS np, lead(fl) OVER w AS nl FROM u WINDOW w AS (PARTITION BY book ORDER BY unit)),
r AS (SELECT *, coalesce(nl > 1 AND np - lp IN (0, 1) AND ll IS NULL, false) AS reaches FROM n)
SELECT book, unit, fp AS first_page, CASE WHEN reaches THEN np ELSE lp END AS last_page, fl AS first_line, CAST(coalesce(CASE WHEN reaches THEN nl ELSE ll END, 0) AS BIGINT) AS last_line FROM r""",
    "text_diff_summary": rf"""
WITH c AS (SELECT *, {LINES} AS ls, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT u.conv_id, u.nth, u.text AS a, b.text AS b, len(u.ls) AS la, len(b.ls) AS lb FROM (SELECT * FROM c WHERE role = 'user') u JOIN (SELECT * FROM c WHERE role = 'assistant') b ON u.conv_id = b.conv_id AND u.nth = b.nth)
SELECT conv_id, nth, CAST(la AS BIGINT) AS source_lines, CAST(lb AS BIGINT) AS target_lines, la != lb AS lines_changed, len(regexp_extract_all(a, '(?m)^#{{1,6}}\s')) != len(regexp_extract_all(b, '(?m)^#{{1,6}}\s')) AS headings_changed,
  len(regexp_extract_all(a, '```')) != len(regexp_extract_all(b, '```')) AS fences_changed FROM p""",
    "integrity_check": r"""
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN len(regexp_extract_all(text, '[0-9]+(?:[./:-][0-9]+)*')) ELSE 0 END AS BIGINT) AS n_missing FROM documents""",
}
