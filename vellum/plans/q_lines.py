"""Queries on lines, roles, scalar functions and markers over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import text as T
from ..operators import lines as L
from .session import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def line_explode_stats(spark, sf_dir):
    return L.line_stats(docs(spark, sf_dir))


def repeated_line_furniture(spark, sf_dir):
    return L.repeated_lines(docs(spark, sf_dir))


def strip_repeated_lines(spark, sf_dir):
    out = L.without_repeated(docs(spark, sf_dir), units=3)
    return out.select("doc_id", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def front_matter_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", L.front_matter(F.col("text")).alias("front_matter"))


def furniture_kind(spark, sf_dir):
    """Kinds of furniture in documents to which such lines were added, with some that look alike."""
    n = F.col("doc_id").cast("string")
    more = F.concat(F.lit("\nPDF Page 12\n<sup>"), n, F.lit("</sup>\nPage "), (F.col("doc_id") % 900).cast("string"), F.lit("\nThe Long Road "), (F.col("doc_id") % 300).cast("string"), F.lit("\nHe went home. 12\n221 Baker Street\nFigure 12\nA -- B 12\n* * * The Long Road * * *"))
    d = docs(spark, sf_dir).select("doc_id", F.concat("text", more).alias("text"))
    return L.furniture_lines(d).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def doc_role(spark, sf_dir):
    d = docs(spark, sf_dir)
    role = L.resolved_role(F.concat(F.col("source"), F.lit("_notes.md")), F.col("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("Index")))
    return d.select("doc_id", F.coalesce(role, F.lit("body")).alias("role"), L.bibliography(F.col("text")).alias("bibliography"))


def language_letter_ratio(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.latin_letters(t).cast("long").alias("latin"), T.cjk_letters(t).cast("long").alias("cjk"), F.regexp_count(t, F.lit(r"\p{L}")).cast("long").alias("letters"))


#: Frequent function words of four languages.
STOPWORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "ein"), "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "this"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "del", "se", "las", "por", "una"), "fr": ("le", "la", "les", "des", "et", "en", "un", "une", "du", "que", "dans", "pour"),
}


def stopword_language_vote(spark, sf_dir):
    return L.stopword_votes(docs(spark, sf_dir), STOPWORDS)


def numeric_markers(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", M.numbers(F.col("text")).alias("markers")).where(F.size("markers") > 0)
    return d.select("doc_id", F.size("markers").cast("long").alias("n"), F.array_join("markers", "|").alias("markers"))


def redact(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", T.redacted(F.col("text")).alias("clean"))
    return d.where("clean != text").select("doc_id", F.regexp_count("clean", F.lit(r"\[EMAIL\]")).cast("long").alias("emails"), F.sha2(F.col("clean").cast("binary"), 256).alias("sha"))


def title_keys(spark, sf_dir):
    first = T.lines(F.col("text"))[0]
    return docs(spark, sf_dir).select("doc_id", T.heading_key(first).alias("heading_key"), T.match_title_key(first).alias("match_key"), T.title_match_key(first).alias("title_key"), T.library_title(first).alias("sort_title"))


def unit_ids(spark, sf_dir):
    path = F.array((F.col("doc_id") % 97 + 1).cast("int"), (F.col("doc_id") % 13 + 1).cast("int"))
    d = docs(spark, sf_dir).select("doc_id", path.alias("path"))
    d = d.select("doc_id", T.unit_id(F.col("path")).alias("unit_id"), "path").withColumn("back", T.unit_path(F.col("unit_id")))
    stem = F.concat("unit_id", F.lit(".part"), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(".part2"))
    return d.select("doc_id", "unit_id", (F.col("back") == F.col("path")).alias("same"), F.array_join(T.part_path(stem).cast("array<string>"), ".").alias("parts"), T.part_base(stem).alias("base"))


def marker_codec(spark, sf_dir):
    """Markers of small numbers, circled numbers and symbols, and back."""
    n = (F.col("doc_id") % 60 + 1).cast("int")
    label = F.when(n <= 50, F.substring(F.lit(M.CIRCLED), n, F.lit(1))).when(n < 55, F.repeat(F.lit("*"), n - 50)).when(n < 57, F.repeat(F.lit("†"), n - 54)).when(n < 59, F.repeat(F.lit("‡"), n - 56)).otherwise(F.lit("a"))
    d = docs(spark, sf_dir).select("doc_id", M.marker(label).alias("m"), label.alias("printed"))
    out = M.output_key(F.col("m.key"), F.col("printed"), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select("doc_id", "m.kind", "m.key", out.alias("output_key"), (M.marker_label(out) == F.col("printed")).alias("back"))


def numeral_labels(spark, sf_dir):
    n = F.col("doc_id") % 3999 + 1
    d = docs(spark, sf_dir).select("doc_id", n.alias("n"))
    roman = F.lit("")
    rest = F.col("n")
    parts = []
    for value, letters in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        parts.append(F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    roman = F.concat(*parts)
    return d.select("doc_id", M.roman_value(roman).cast("long").alias("value"), M.numeral_label(F.concat(F.lit("# Page "), F.col("n").cast("string"))).alias("label"))


def library_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Mary "), F.regexp_replace("c_name", "[#0-9 ]", ""), F.lit(" "), F.col("c_mktsegment"))
    return c.select("c_custkey", T.library_author(name).alias("author"), T.language_code(F.element_at(F.array(*[F.lit(x) for x in ("German", "français", "zh-CN", "Klingon")]), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("code"), T.safe_filename(F.concat("c_name", F.lit(": a/b?"))).alias("file"))


def syntax_classes(spark, sf_dir):
    from ..operators.audits import fragmentation, syntax_issues

    d = docs(spark, sf_dir).select("doc_id", syntax_issues(F.col("text")).alias("issues"), fragmentation(F.col("text")).alias("f"))
    return d.select("doc_id", F.size("issues").cast("long").alias("n_issues"), F.col("f.n_blocks").cast("long").alias("n_blocks"), "f.fragmented")


def density_outlier(spark, sf_dir):
    from ..operators.layout import density_risk

    d = docs(spark, sf_dir).select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("n_chars").alias("chars"), F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"))
    return density_risk(d).where("risky")


def every_nth_sample(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = docs(spark, sf_dir).select("doc_id", "source", F.row_number().over(w).alias("page_no"))
    return d.where("page_no % 20 = 0").select("doc_id", "source", F.col("page_no").cast("long").alias("page_no"))


def report_rollup(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("?"))).withColumn("source", F.coalesce("source", F.lit("?")))
    return d.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def comparable_text(spark, sf_dir):
    t = F.concat(F.lit("# Head *x*\n> "), F.col("text"), F.lit("\n- ![a](b) [c](d)[^1]: e"))
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.comparable(t).cast("binary"), 256).alias("sha"), T.estimated_tokens(T.prose(t)).alias("tokens"))


def package_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.package_path_ok(F.col("url")).alias("url_ok"), T.package_path_ok(F.concat(F.lit("OEBPS/p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit("/../x")).otherwise(F.lit(".xhtml")))).alias("path_ok"))


QUERIES = {
    f.__name__: f
    for f in (
        line_explode_stats, repeated_line_furniture, strip_repeated_lines, front_matter_flag, furniture_kind, doc_role, language_letter_ratio, stopword_language_vote, numeric_markers,
        redact, title_keys, unit_ids, marker_codec, numeral_labels, library_names, syntax_classes, density_outlier, every_nth_sample, report_rollup, comparable_text, package_paths,
    )
}

#: Lines of a text as both engines see them.
LINES = r"list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)), lambda x: coalesce(text, '') != '')"
_VOTES = ", ".join(
    f"len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS {code}" for code, ws in sorted(STOPWORDS.items())
)

_ONE_SPACE = lambda c: f"trim(regexp_replace({c}, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ')"


def _steps(c: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return _ONE_SPACE(c)


ORACLE_SQL = {
    "marker_codec": """
WITH n AS (SELECT doc_id, doc_id % 60 + 1 AS n, doc_id % 3 + 1 AS o FROM documents),
k AS (SELECT doc_id, n, o, CASE WHEN n <= 50 THEN CAST(n AS VARCHAR) WHEN n < 55 THEN 'fnm-star-' || (n - 50) WHEN n = 55 THEN 'fnm-dagger' WHEN n = 56 THEN 'fnm-dagger-2' WHEN n = 57 THEN 'fnm-double-dagger' WHEN n = 58 THEN 'fnm-double-dagger-2' ELSE 'fnm-letter-a' END AS key FROM n)
SELECT doc_id, CASE WHEN n <= 50 THEN 'numeric' WHEN n < 55 THEN 'star' WHEN n < 57 THEN 'dagger' WHEN n < 59 THEN 'double_dagger' ELSE 'letter' END AS kind, key,
  CASE WHEN n <= 50 THEN 'fnm-circle-' ELSE '' END || key || CASE WHEN o > 1 THEN '-o' || o ELSE '' END AS output_key, true AS back FROM k""",
    "comparable_text": "WITH t AS (SELECT doc_id, '# Head *x*' || chr(10) || '> ' || text || chr(10) || '- ![a](b) [c](d)[^1]: e' AS t FROM documents) SELECT doc_id, sha256("
    + _steps("coalesce(t, '')", (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"\[\^([^\]]+)\]\s*:", r"\1 "), (r"\[\^([^\]]+)\]", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^[ \t]*[-+*][ \t]+", ""), (r"(?m)^[ \t]*>[ \t]?", ""), ("[`*_]", ""))
    + ") AS sha, CAST(ceil(length("
    + _steps("coalesce(t, '')", (r"(?s)```.*?(?:```|\z)", " "), (r"(?s)~~~.*?(?:~~~|\z)", " "), ("(?s)<!--.*?-->", " "), (r"`[^`\n]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?i)\bhttps?://\S+|\bwww\.\S+", " "), ("<[^>]+>", " "))
    + ") / 4.0) AS BIGINT) AS tokens FROM t",
    "furniture_kind": """
WITH x AS (SELECT doc_id, unnest([['synthetic_page_label', 'high', 'y'], ['standalone_page_label', 'high', CASE WHEN doc_id <= 9999 THEN 'y' END], ['standalone_page_label', 'medium', 'y'],
  ['running_title_plus_page_label', 'high', 'y'], ['running_header', 'high', 'y']]) AS f FROM documents WHERE text IS NOT NULL)
SELECT f[1] AS kind, f[2] AS confidence, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM x WHERE f[3] IS NOT NULL GROUP BY ALL""",
    "line_explode_stats": f"""
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(ls, lambda x: trim(x, ' ') != '')) AS BIGINT) AS n_nonblank,
  CAST(coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS longest, CAST(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS line_chars
FROM (SELECT doc_id, {LINES} AS ls FROM documents)""",
    "repeated_line_furniture": f"""
SELECT line, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_units, CAST(count(*) AS BIGINT) AS n_lines, min(doc_id) AS first_unit
FROM (SELECT doc_id, trim(unnest({LINES}), ' ') AS line FROM documents) WHERE length(line) BETWEEN 5 AND 120 GROUP BY line HAVING count(DISTINCT doc_id) >= 2""",
    "strip_repeated_lines": f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT doc_id, {LINES} AS ls FROM documents)),
r AS (SELECT trim(line, ' ') AS t, min(doc_id) AS f FROM l WHERE length(trim(line, ' ')) BETWEEN 5 AND 120 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, line, n, coalesce(f != doc_id, false) AS gone FROM l LEFT JOIN r ON trim(line, ' ') = t)
SELECT doc_id, CAST(sum(gone::INT) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS sha FROM m GROUP BY doc_id""",
    "front_matter_flag": rf"""
SELECT doc_id, regexp_matches(array_to_string(({LINES})[1:24], chr(10)), '(?i)\b(?:cataloging[- ]in[- ]publication|library of congress|copyright|all rights reserved|isbn|cip data)\b') AS front_matter FROM documents""",
    "language_letter_ratio": r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]')) AS BIGINT) AS latin,
  CAST(len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')) AS BIGINT) AS cjk, CAST(len(regexp_extract_all(text, '\p{L}')) AS BIGINT) AS letters FROM documents""",
    "stopword_language_vote": f"""
SELECT doc_id, CASE WHEN votes = 0 THEN 'und' WHEN de = votes THEN 'de' WHEN en = votes THEN 'en' WHEN es = votes THEN 'es' ELSE 'fr' END AS language, CAST(votes AS BIGINT) AS votes
FROM (SELECT *, greatest(de, en, es, fr) AS votes FROM (SELECT doc_id, {_VOTES} FROM documents))""",
    "numeric_markers": r"""
SELECT doc_id, CAST(len(m) AS BIGINT) AS n, array_to_string(m, '|') AS markers FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[./:-][0-9]+)*') AS m FROM documents) WHERE len(m) > 0""",
    "title_keys": rf"""
WITH f AS (SELECT doc_id, ({LINES})[1] AS t FROM documents), c AS (SELECT doc_id, t, trim(regexp_replace(t, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ') AS c FROM f)
SELECT doc_id, lower(trim(regexp_replace(regexp_replace(t, '^#{{1,6}}\s*', ''), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ')) AS heading_key,
  lower(regexp_replace(regexp_replace(t, '^\s*#{{1,6}}\s*', ''), '[^\p{{L}}\p{{N}}\p{{M}}_]', '', 'g')) AS match_key, lower(c) AS title_key,
  regexp_replace(trim(regexp_replace(t, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'), ' '), '(?i)^(the|an|a|der|die|das|le|la|les|el|los|las)\s+(.+)$', '\2, \1') AS sort_title FROM c""",
    "unit_ids": """
WITH p AS (SELECT doc_id, 'unit_' || lpad(CAST(doc_id % 97 + 1 AS VARCHAR), 4, '0') || '_' || lpad(CAST(doc_id % 13 + 1 AS VARCHAR), 4, '0') AS unit_id FROM documents)
SELECT doc_id, unit_id, true AS same, CAST(doc_id % 4 + 1 AS VARCHAR) || '.2' AS parts, unit_id AS base FROM p""",
    "numeral_labels": """
SELECT doc_id, CAST(doc_id % 3999 + 1 AS BIGINT) AS value, CAST(doc_id % 3999 + 1 AS VARCHAR) AS label FROM documents""",
    "density_outlier": f"""
WITH p AS (SELECT source AS book, doc_id AS page, n_chars AS chars, len({LINES}) AS n_lines FROM documents),
w AS (SELECT *, lag(chars) OVER o AS pc, lead(chars) OVER o AS nc, lag(n_lines) OVER o AS pl, lead(n_lines) OVER o AS nl FROM p WINDOW o AS (PARTITION BY book ORDER BY page))
SELECT book, page, CAST(chars AS BIGINT) AS chars, true AS risky FROM w WHERE pc IS NOT NULL AND nc IS NOT NULL AND chars >= 120 AND least(pc, nc) >= 800 AND chars < 0.3 * (pc + nc) / 2 AND n_lines < 0.3 * (pl + nl) / 2""",
    "every_nth_sample": """
SELECT doc_id, source, CAST(page_no AS BIGINT) AS page_no FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no FROM documents) WHERE page_no % 20 = 0""",
    "report_rollup": """
SELECT lang, source, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest
FROM (SELECT coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, n_chars FROM documents) GROUP BY ROLLUP (lang, source)""",
    "package_paths": r"""
SELECT page_id, NOT regexp_matches(url, '^/|\\|(?:^|/)\.{1,2}(?:/|$)|^[A-Za-z][A-Za-z0-9+.-]*:|//') AS url_ok, page_id % 2 != 0 AS path_ok FROM pages""",
    "redact": r"""
WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b', '[EMAIL]', 'g'),
  '(?i)\b(?:bearer|token|api[_-]?key|secret|password)(\s*[:=]\s*)[^\s"'']+', '[SECRET]', 'g'), '\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}\b', '[TOKEN]', 'g'), '\bAKIA[0-9A-Z]{16}\b', '[TOKEN]', 'g'),
  '(?:/home/|/Users/)[A-Za-z0-9._-]+', '/HOME', 'g'), '[A-Z]:\\Users\\[A-Za-z0-9._-]+', '/HOME', 'g') AS clean FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(clean, '\[EMAIL\]')) AS BIGINT) AS emails, sha256(clean) AS sha FROM r WHERE clean != text""",
    "library_names": r"""
SELECT c_custkey, c_mktsegment || ', Mary ' || regexp_replace(c_name, '[#0-9 ]', '', 'g') AS author, (['de', 'fr', 'zh', 'und'])[c_custkey % 4 + 1] AS code,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name || ': a/b?', '[<>:"/\\|?*]', '_', 'g'), '[^\p{L}\p{N}\p{M}_.-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file FROM customer""",
}
