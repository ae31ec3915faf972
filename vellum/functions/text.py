"""Text normalisation and scalar string functions, all native columns.

Character classes are spelled out, as ``\\w``, ``\\d`` and ``\\s`` are ASCII only in Java
patterns: ``WORD_CHARS`` are letters, digits and underscore of any script, ``WS`` is white space.
Case is folded by ``lower``; that differs from full case folding only for letters such
as the German sharp s, which stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHARS = r"\p{L}\p{N}\p{M}_"
WS = r"\s\x{85}\p{Z}"


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def lines(c: Column) -> Column:
    """Lines of a text; CR LF and CR are newlines, an empty last line isn't one. Form
    feeds and Unicode separators don't end a line."""
    parts = F.split(replaced(F.coalesce(c, F.lit("")), (r"\r\n?", "\n")), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapsed(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", " "))


def heading_stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*#{1,6}\s*", "")


#: Quotation marks that come in pairs around a title.
QUOTES = "《》〈〉「」『』“”‘’\"\"''"


def scope_title_key(c: Column) -> Column:
    """Key of a title for finding scopes: outer marks and up to three pairs of quotes go."""
    c = F.trim(replaced(collapsed(c), (r"^[*_`]+|[*_`]+$", "")))
    c = F.regexp_replace(c, f"(?<=[{WORD_CHARS}])[ \\t]+-[ \\t]*(?=[{WORD_CHARS}])", "-")
    pairs = "|".join(f"{a}(.*){b}" for a, b in zip(QUOTES[::2], QUOTES[1::2], strict=True))
    inner = "".join(f"${i + 1}" for i in range(len(QUOTES) // 2))
    for _ in range(3):  # as one replacement a round, so that the expression doesn't double with each
        c = F.trim(F.regexp_replace(c, f"^(?:{pairs})$", inner))
    return F.lower(c)


def match_title_key(c: Column) -> Column:
    """Only letters, digits and underscores of a title."""
    return F.lower(F.regexp_replace(heading_stripped(c), f"[^{WORD_CHARS}]", ""))


def heading_key(c: Column) -> Column:
    return F.lower(collapsed(F.regexp_replace(F.coalesce(c, F.lit("")), r"^#{1,6}\s*", "")))


def toc_label(c: Column) -> Column:
    """Visible text of a Markdown or HTML label."""
    return collapsed(
        replaced(
            F.coalesce(c, F.lit("")), (r"<[^>]+>", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"^\s*#{1,6}\s+", ""),
            (r"\[\^[^\]]+\]", ""), (r"[*`]+", ""), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&amp;", "&"),
        )
    )


def title_match_key(c: Column) -> Column:
    return F.lower(collapsed(c))


def numbered_title(title: Column, label: Column) -> Column:
    """The reviewed label before the title, unless it is there already."""
    t, n = collapsed(title), collapsed(label)
    return F.when((n == "") | (t == n) | t.startswith(F.concat(n, F.lit(" "))), t).when(t == "", n).otherwise(F.concat_ws(" ", n, t))


def label_stripped(title: Column, label: Column) -> Column:
    """What follows an exact leading label; null if the label isn't there or nothing follows."""
    t, n = collapsed(title), collapsed(label)
    rest = F.trim(t.substr(F.char_length(n) + 1, F.char_length(t)))
    return F.when((n != "") & t.startswith(F.concat(n, F.lit(" "))) & (rest != ""), rest)


def title_variants(c: Column) -> Column:
    """Keys under which a scope's title is known: whole, and without ``Chapter N:`` or ``N.``."""
    whole = scope_title_key(c)
    short = F.regexp_replace(whole, r"^(?:(?:chapter|part|kapitel|teil|chapitre|partie|section)\s+)?(?:[0-9]+|[ivxlcdm]{1,8})\s*[.:：)–—-]\s*", "")
    named = F.regexp_replace(whole, r"^(?:chapter|part|kapitel|teil|chapitre|partie|section)\s+(?:[0-9]+|[ivxlcdm]{1,8})\s+", "")
    return F.filter(F.array_distinct(F.array(whole, short, named)), lambda x: x != "")


def prose(c: Column) -> Column:
    """Visible prose: no fences, comments, code, links' addresses, URLs or tags."""
    return collapsed(
        replaced(
            F.coalesce(c, F.lit("")), (r"(?s)```.*?(?:```|\z)", " "), (r"(?s)~~~.*?(?:~~~|\z)", " "), (r"(?s)<!--.*?-->", " "), (r"`[^`\n]*`", " "),
            (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?i)\bhttps?://\S+|\bwww\.\S+", " "), (r"<[^>]+>", " "),
        )
    )


def language_audit_text(c: Column) -> Column:
    """Prose left for measuring the density of a script: no notes, code, links, mathematics."""
    return replaced(
        F.coalesce(c, F.lit("")), (r"(?m)^\s{0,3}\[\^[^\]\n]+\]:[^\n]*(?:\n[ \t]+[^\n]*)*", " "), (r"(?s)```.*?```", " "), (r"!?\[[^\]]*\]\([^)]*\)", " "),
        (r"(?i)https?://\S+|www\.\S+", " "), (r"`[^`]*`", " "), (r"(?s)\$\$?.*?\$\$?", " "), (r"<[^>]+>", " "),
    )


def outer_fence_stripped(c: Column) -> Column:
    """A text without the one fence that wraps it whole; others as they are."""
    inner = F.regexp_extract(c, r"(?s)\A\s*```[A-Za-z]*[ \t]*\n(.*?)\n?```\s*\z", 1)
    wrapped = c.rlike(r"(?s)\A\s*```[A-Za-z]*[ \t]*\n.*```\s*\z") & (F.regexp_count(c, F.lit("```")) == 2)
    return F.when(wrapped, inner).otherwise(c)


def comparable(c: Column) -> Column:
    """Text of a page for comparison, without layout marks; compatibility forms of letters are
    kept (see ``functions.udfs.nfkc`` for folding them first)."""
    c = replaced(
        F.coalesce(c, F.lit("")), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\[\^([^\]]+)\]\s*:", "$1 "), (r"\[\^([^\]]+)\]", "$1"),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^[ \t]*[-+*][ \t]+", ""), (r"(?m)^[ \t]*>[ \t]?", ""), (r"[`*_]", ""),
    )
    return collapsed(c)


def blank_page_marker(line: Column) -> Column:
    """Whether a line is the image of a blank page."""
    return F.coalesce(line.rlike(r"(?i)^\s*!\[\s*(?:blank|empty)\s+page[^\]]*\]\([^)]*\)\s*$"), F.lit(False))


def tex_tokens(c: Column) -> Column:
    """Structure of a TeX text, in order: references, citations, environments, mathematics."""
    return F.regexp_extract_all(c, F.lit(r"(\\(?:ref|eqref|pageref|cite[a-z]*|label|input|include|begin|end)\*?(?:\[[^\]]*\])*\{[^}]*\}|\$\$|\\\[|\\\]|\\\(|\\\))"), F.lit(1))


def cjk_preamble(c: Column, language: str) -> Column:
    """The document with a CJK package after its class, once, for Chinese, Japanese or Korean."""
    if language not in ("zh", "ja", "ko"):
        return c
    there = c.rlike(r"\\usepackage(?:\[[^\]]*\])?\{(?:xeCJK|ctex|luatexja)\}")
    return F.when(there, c).otherwise(F.regexp_replace(c, r"(\\documentclass(?:\[[^\]]*\])?\{[^}]*\})", "$1\n\\\\usepackage{xeCJK}"))


#: Language names and their codes.
LANGUAGES = {
    "english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es", "italian": "it", "italiano": "it",
    "chinese": "zh", "simplified chinese": "zh", "traditional chinese": "zh", "中文": "zh", "简体中文": "zh", "japanese": "ja", "日本語": "ja", "korean": "ko",
    "russian": "ru", "portuguese": "pt", "latin": "la", "greek": "el", "dutch": "nl", "polish": "pl", "turkish": "tr", "arabic": "ar",
}


def language_code(name: Column) -> Column:
    """Two-letter code of a language's name; a code stays, what is unknown becomes ``und``."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    code = F.regexp_extract(key, r"^([a-z]{2})(?:[-_][a-z0-9]+)*$", 1)
    return F.coalesce(F.element_at(known, key), F.when(code != "", code), F.lit("und"))


def library_title(c: Column) -> Column:
    """Title for sorting: the leading article goes to the end."""
    return F.regexp_replace(collapsed(c), r"(?i)^(the|an|a|der|die|das|le|la|les|el|los|las)\s+(.+)$", "$2, $1")


def library_author(c: Column) -> Column:
    """``Last, First``; a name with a comma, or of one word, stays."""
    name = collapsed(c)
    return F.when(F.contains(name, F.lit(",")) | ~F.contains(name, F.lit(" ")), name).otherwise(F.regexp_replace(name, r"^(.+) (\S+)$", "$2, $1"))


def fenced(text: Column, label: Column | None = None) -> Column:
    """Foreign text between markers it cannot close itself."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<untrusted>"), F.lit("&lt;untrusted&gt;")), F.lit("</untrusted>"), F.lit("&lt;/untrusted&gt;"))
    head = F.lit("<untrusted>\n") if label is None else F.concat(F.lit("<untrusted>\n"), F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("["), label, F.lit("]\n"))).otherwise(F.lit("")))
    return F.concat(head, safe, F.lit("\n</untrusted>"))


def outside_fences(prompt: Column) -> Column:
    return collapsed(F.regexp_replace(prompt, r"(?s)<untrusted>.*?</untrusted>", " "))


def safe_filename(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore; others become one underscore."""
    out = replaced(collapsed(c), (r"[<>:\"/\\|?*\x00-\x1f]", "_"), (f"[^{WORD_CHARS}.-]+", "_"), (r"_+", "_"), (r"^[._]+|[._]+$", ""))
    return F.when(out == "", "untitled").otherwise(F.substring(out, 1, 200))


def redacted(c: Column) -> Column:
    """Secrets, tokens, mail addresses and home folders replaced."""
    return replaced(
        c, (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b", "[EMAIL]"), (r"(?i)\b(?:bearer|token|api[_-]?key|secret|password)(\s*[:=]\s*)[^\s\"']+", "[SECRET]"),
        (r"\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}\b", "[TOKEN]"), (r"\bAKIA[0-9A-Z]{16}\b", "[TOKEN]"), (r"(?:/home/|/Users/)[A-Za-z0-9._-]+", "/HOME"), (r"[A-Z]:\\Users\\[A-Za-z0-9._-]+", "/HOME"),
    )


def superscripts_split(c: Column) -> Column:
    """``<sup>52, 53</sup>`` as a superscript for each number."""
    found = F.regexp_extract_all(c, F.lit(r"<sup>\s*([0-9]{1,4}(?:\s*[,;]\s*[0-9]{1,4})+)\s*</sup>"), F.lit(1))
    pieces = F.split(c, r"<sup>\s*[0-9]{1,4}(?:\s*[,;]\s*[0-9]{1,4})+\s*</sup>", -1)
    each = F.transform(found, lambda x: F.array_join(F.transform(F.split(x, r"\s*[,;]\s*"), lambda n: F.concat(F.lit("<sup>"), n, F.lit("</sup>"))), ""))
    return F.array_join(F.flatten(F.zip_with(pieces, F.concat(each, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def cjk_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"))


def latin_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"))


# ids and paths


def unit_id(path: Column) -> Column:
    """``unit_0001_0003`` of an index path."""
    return F.concat(F.lit("unit_"), F.array_join(F.transform(path, lambda i: F.lpad(i.cast("string"), 4, "0")), "_"))


def unit_path(unit: Column) -> Column:
    """Index path of a unit id; null if it isn't one."""
    return F.when(unit.rlike(r"^unit(?:_[0-9]{4,})+$"), F.transform(F.regexp_extract_all(unit, F.lit(r"_([0-9]{4,})"), F.lit(1)), lambda x: x.cast("int")))


def part_path(stem: Column) -> Column:
    """Numbers of the ``.partN`` suffixes, outermost first."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(stem, r"((?:\.part[0-9]+)+)$", 1), F.lit(r"\.part([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))


def part_base(stem: Column) -> Column:
    return F.regexp_replace(stem, r"(?:\.part[0-9]+)+$", "")


def package_path_ok(c: Column) -> Column:
    """Whether a path stays inside its package: relative, no backslash, no dot segments, no scheme."""
    return F.coalesce((F.trim(c) != "") & ~c.rlike(r"^/|\\|\x00|(?:^|/)\.{1,2}(?:/|$)|^[A-Za-z][A-Za-z0-9+.-]*:|//"), F.lit(False))
