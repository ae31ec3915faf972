"""HTML: protected tokens, masks, links, visible text, translatable units and their codec.

Token work is native. What needs a parser (units, clean fragments, visible text by the document's structure)
runs in Arrow batches with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TAG = r"</?([A-Za-z][A-Za-z0-9:-]*)(?:\s[^<>]*)?/?>"
PROTECTED = r"(<!--[\s\S]*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);|\{\{[^{}]*\}\})"


def tag_names(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(1)), F.lower)


def protected_tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(PROTECTED), F.lit(1))


def title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(t != "", T.collapsed(t))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^<>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def anchors(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)\s(?:id|name)\s*=\s*["']([^"']+)["']"""), F.lit(1)))


def plain_text(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments, by patterns; entities of XML are decoded."""
    t = T.replaced(F.coalesce(html, F.lit("")), (r"(?is)<(script|style)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "))
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return T.collapsed(t)


def masked(text: Column) -> Column:
    """(masked, tokens): protected tokens as numbered placeholders. Pieces between tokens are put together again in one pass."""
    tokens = protected_tokens(text)
    parts = F.split(text, PROTECTED, -1)
    marks = F.transform(tokens, lambda t, i: F.concat(F.lit("⟦HTML_"), F.lpad((i + 1).cast("string"), 4, "0"), F.lit("⟧")))
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat(marks, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.struct(joined.alias("masked"), tokens.alias("tokens"))


MARK = r"(⟦HTML_[0-9]{4,}⟧)"


def mask_intact(text: Column, tokens: Column) -> Column:
    """Whether a text holds all placeholders once and in order."""
    want = F.transform(tokens, lambda t, i: F.concat(F.lit("⟦HTML_"), F.lpad((i + 1).cast("string"), 4, "0"), F.lit("⟧")))
    return F.regexp_extract_all(text, F.lit(MARK), F.lit(1)) == want


def restored(text: Column, tokens: Column) -> Column:
    """The text with its tokens back; null if its placeholders aren't intact."""
    parts = F.split(text, MARK, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.concat(tokens, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.when(mask_intact(text, tokens), joined)


def broken_links(pages: DataFrame) -> DataFrame:
    """Internal links (page, href) whose target no page has. Pages come as (page, path, html)."""
    links = pages.select("page", "path", F.explode(hrefs(F.col("html"))).alias("href")).where(~F.col("href").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)"))
    links = links.withColumn("to", F.when(F.col("href").startswith("#"), F.concat("path", "href")).otherwise(F.col("href")))
    there = pages.select(F.col("path").alias("to")).unionByName(pages.select(F.explode(F.transform(anchors(F.col("html")), lambda a: F.concat("path", F.lit("#"), a))).alias("to"))).distinct()
    return links.join(there, "to", "left_anti").select("page", "href")


def line_errors(source: DataFrame, target: DataFrame) -> DataFrame:
    """Units (unit, line_no, text) whose target line is missing or has other tags: (unit, line_no, problem)."""
    both = source.join(target.select("unit", "line_no", F.col("text").alias("made")), ["unit", "line_no"], "full_outer")
    problem = F.when(F.col("made").isNull(), "missing").when(F.col("text").isNull(), "extra").when(tag_names(F.col("text")) != tag_names(F.col("made")), "tags").when((F.trim("text") != "") & (F.trim("made") == ""), "empty")
    return both.withColumn("problem", problem).where("problem is not null").select("unit", "line_no", "problem")


# what needs a parser

#: Elements of HTML by what they do to a text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em i img kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr br".split())
ALLOWED = frozenset("a abbr b blockquote br caption cite code col dd del dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li ol p pre q rp rt ruby s section small span strong sub sup table tbody td tfoot th thead tr u ul".split())
DROPPED = frozenset("script style iframe object embed template noscript svg math form".split())
ATTRIBUTES = frozenset("href src alt title id class lang colspan rowspan dir epub:type role".split())


class _Units(HTMLParser):
    """Cuts a document into a skeleton with numbered slots and the texts, inline tags included, that go into them. Every token
    stands for the source from its own start to that of the next, so that nothing is written anew."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=False)
        self.skeleton: list[str] = []
        self.units: list[str] = []
        self.skip = 0
        self.line_starts = [0, *(i + 1 for i, ch in enumerate(html) if ch == "\n")]
        self.tokens: list[tuple[int, bool]] = []  # start, and whether it belongs to a run of text
        self.feed(html)
        self.close()
        run: list[str] = []
        self.tokens = [(0, False), *self.tokens] if not self.tokens or self.tokens[0][0] else self.tokens
        ends = [at for at, _ in self.tokens[1:]] + [len(html)]
        for (at, inline), end in zip(self.tokens, ends, strict=True):
            if inline:
                run.append(html[at:end])
            else:
                self.flush("".join(run))
                self.skeleton.append(html[at:end].replace("\x00", "\x00\x00"))
                run = []
        self.flush("".join(run))

    def flush(self, whole: str) -> None:
        if not _has_text(whole):
            self.skeleton.append(whole.replace("\x00", "\x00\x00"))
            return
        body = whole.strip(" \t\n\r\x0b\x0c")
        at = whole.index(body)
        self.skeleton.append(whole[:at].replace("\x00", "\x00\x00"))
        self.skeleton.append(f"\x00{len(self.units)}\x01")
        self.skeleton.append(whole[at + len(body) :].replace("\x00", "\x00\x00"))
        self.units.append(body)

    def token(self, inline: bool) -> None:
        line, column = self.getpos()
        at = self.line_starts[line - 1] + column
        if not self.tokens or at > self.tokens[-1][0]:
            self.tokens.append((at, inline and not self.skip))

    def handle_starttag(self, tag, attrs):
        self.token(tag in INLINE)
        if tag in DROPPED and tag not in VOID:
            self.skip += 1

    def handle_startendtag(self, tag, attrs):
        self.token(tag in INLINE)

    def handle_endtag(self, tag):
        if tag in DROPPED and self.skip:
            self.skip -= 1
        self.token(tag in INLINE)

    def handle_data(self, data):
        self.token(True)

    def handle_entityref(self, name):
        self.token(True)

    def handle_charref(self, name):
        self.token(True)

    def handle_comment(self, data):
        self.token(False)

    def handle_decl(self, decl):
        self.token(False)

    def handle_pi(self, data):
        self.token(False)

    def unknown_decl(self, data):
        self.token(False)


def one_line(unit: str) -> str:
    """A unit without line breaks: they become ``&#10;`` and ``&#13;``, and references that look like these get one more zero."""
    return re.sub(r"&#(0*1[03]);", r"&#0\1;", unit).replace("\n", "&#10;").replace("\r", "&#13;")


def many_lines(line: str) -> str:
    """The unit that ``one_line`` made a line of."""
    return re.sub(r"&#(0*)(1[03]);", lambda m: f"&#{m[1][1:]}{m[2]};" if m[1] else chr(int(m[2])), line)


def _has_text(s: str) -> bool:
    out, inside = False, False
    for ch in s:
        if ch == "<":
            inside = True
        elif ch == ">":
            inside = False
        elif not inside and not ch.isspace():
            out = True
            break
    return out


def compressed_one(html: str | None) -> tuple[str, list[str]]:
    """(skeleton, units) of a document; a unit is one line, as ``one_line`` says. What the parser gives up on is all skeleton."""
    try:
        parser = _Units(html or "")
    except AssertionError:
        return html.replace("\x00", "\x00\x00"), []
    return "".join(parser.skeleton), [one_line(u) for u in parser.units]


def decompressed_one(skeleton: str, units: list[str]) -> str:
    """The document, from a skeleton and its units, all of them in order."""
    out, i = [], 0
    while i < len(skeleton):
        ch = skeleton[i]
        if ch != "\x00":
            j = skeleton.find("\x00", i)
            j = len(skeleton) if j < 0 else j
            out.append(skeleton[i:j])
            i = j
        elif skeleton[i + 1] == "\x00":
            out.append("\x00")
            i += 2
        else:
            j = skeleton.index("\x01", i)
            out.append(many_lines(units[int(skeleton[i + 1 : j])]))
            i = j + 1
    return "".join(out)


def compress(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, skeleton, units) of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compressed_one(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))], names=[key, "skeleton", "units"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, skeleton string, units array<string>")


def unit_lines(compressed: DataFrame, key: str = "page_id") -> DataFrame:
    return compressed.select(key, F.posexplode("units").alias("i", "text")).select(key, (F.col("i") + 1).alias("line_no"), "text")


def decompress(compressed: DataFrame, lines: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, html) from skeletons and lines (key, line_no, text); null where the lines aren't all there."""
    kind = compressed.schema[key].dataType.simpleString()
    made = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls")).select(key, F.transform("ls", lambda x: x["text"]).alias("made"))
    rows = compressed.join(made, key, "left").select(key, "skeleton", F.coalesce("made", F.array().cast("array<string>")).alias("made"), F.size("units").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decompressed_one(s, m) if len(m) == n else None for s, m, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "html"])

    return rows.mapInArrow(run, f"{key} {kind}, html string")


class _Clean(HTMLParser):
    """Writes allowed tags and attributes only; what is active goes with its content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip += tag not in VOID
        elif not self.skip and tag in ALLOWED:
            kept = [(k, v or "") for k, v in attrs if k in ATTRIBUTES and not (k in ("href", "src") and _unsafe(v or ""))]
            self.out.append(f"<{tag}{''.join(f' {k}="{escape(v)}"' for k, v in kept)}{'/' if tag in VOID else ''}>")
            if tag not in VOID:
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            if tag not in VOID and tag in ALLOWED and not self.skip:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.out.append(escape(data, quote=False))

    def text(self) -> str:
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def _unsafe(url: str) -> bool:
    head = "".join(c for c in url.lower() if c > " ").split("/", 1)[0]
    return ":" in head and head.split(":", 1)[0] not in ("http", "https", "mailto") and not head.startswith("#")


def cleaned_one(html: str | None) -> str:
    parser = _Clean()
    parser.feed(html or "")
    parser.close()
    return parser.text()


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED and tag not in VOID:
            self.skip += 1
        elif tag == "img" and not self.skip:
            self.out.append(f"\n[Image: {dict(attrs).get('alt') or dict(attrs).get('src') or ''}]\n")
        elif tag not in INLINE or tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in DROPPED and self.skip:
            self.skip -= 1
        elif tag not in INLINE:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("\n", " "))


def text_one(html: str | None) -> str:
    """Text of a document, a line for each block, images as placeholders."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.out).split("\n")) if x)


def _mapped(pages: DataFrame, key: str, html: str, function, name: str) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([function(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, name])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, {name} string")


def cleaned(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Fragments with allowed tags and attributes, closed in order, without active content and unsafe addresses."""
    return _mapped(pages, key, html, cleaned_one, "html")


def document_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return _mapped(pages, key, html, text_one, "text")
