"""Sources and sinks: Markdown folders, layout sidecars, EPUB packages, TeX projects, receipts.

Packages are read by ``binaryFile`` and unpacked in Arrow batches, one package at a time, within limits on members and
sizes; a package past a limit gives one row with an error instead of members."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut

MOST_MEMBERS, MOST_MEMBER, MOST_TOTAL = 100_000, 512 << 20, 2 << 30

SIDECAR = "source string, page int, page_box array<double>, body_font_size double, blocks array<struct<order:int,label:string,bbox:array<double>,text:string,html:string,font_size:double,font_names:array<string>>>"


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, sha256, size) of the Markdown files of a folder."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(path)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"), F.octet_length("value").cast("long").alias("size"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Layout sidecars ``page_*.ocr.json`` with the page number of their name; what doesn't fit the schema is null."""
    rows = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "page_*.ocr.json").json(path)
    return rows.withColumn("page_no", F.regexp_extract(F.col("_metadata.file_name"), r"page_(\d+)", 1).cast("int"))


def sidecar_blocks(df: DataFrame) -> DataFrame:
    """Blocks of sidecars with their box in page ratios; boxes are thousandths, or points of a page box."""
    rows = df.select("source", "page_no", "page_box", F.posexplode("blocks").alias("block", "b"))
    w, h = F.coalesce(F.col("page_box")[2] - F.col("page_box")[0], F.lit(1000.0)), F.coalesce(F.col("page_box")[3] - F.col("page_box")[1], F.lit(1000.0))
    box = [(F.col("b.bbox")[i] / (w if i % 2 == 0 else h)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select(F.col("source").alias("book"), F.col("page_no").alias("page"), "block", "b.label", "b.text", "b.font_size", *box)


def _members(data: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MOST_MEMBERS:
            raise ValueError("too many members")
        if sum(i.file_size for i in infos) > MOST_TOTAL or any(i.file_size > MOST_MEMBER for i in infos):
            raise ValueError("too large")
        out = []
        for i in infos:
            with z.open(i) as f:
                body = f.read(i.file_size + 1)  # a size that lies is found out here
            if len(body) > i.file_size:
                raise ValueError("a member is larger than it says")
            out.append((i.filename, body))
        return out


MEMBERS = "package string, name string, size long, content binary, error string"


def archive(spark: SparkSession, path: str, glob: str = "*.epub") -> DataFrame:
    """Members of zip packages: package, name, size, content; or package and error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("package"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(package, n, len(b), b, None) for n, b in _members(data)]
                except (ValueError, NotImplementedError, RuntimeError, zipfile.BadZipFile, zlib.error) as e:
                    rows = [(package, None, None, None, str(e))]
                cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["package", "name", "size", "content", "error"])

    return files.mapInArrow(run, MEMBERS)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def package_parts(members: dict[str, bytes]) -> tuple[list[tuple[str, str]], list[tuple[int, str, str]]]:
    """((field, value) of the metadata, (place, path, media type) of the spine) of one EPUB."""
    root = ElementTree.fromstring(members["META-INF/container.xml"])
    opf = next(e.get("full-path") for e in root.iter() if _tag(e) == "rootfile")
    doc, base = ElementTree.fromstring(members[opf]), posixpath.dirname(opf)
    meta = [(_tag(e), (e.text or "").strip()) for e in next(e for e in doc if _tag(e) == "metadata") if "purl.org/dc" in e.tag]
    items = {e.get("id"): e for e in doc.iter() if _tag(e) == "item"}
    spine = []
    for e in doc.iter():
        if _tag(e) == "itemref" and e.get("idref") in items:
            it = items[e.get("idref")]
            spine.append((len(spine) + 1, posixpath.normpath(posixpath.join(base, it.get("href"))), it.get("media-type")))
    return meta, spine


def epub(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(package, field, value) and (package, place, path, media_type, html) of the EPUBs of a folder. A package that can't be
    read gives one row with the field ``error``, and no chapters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select(F.element_at(F.split("path", "/"), -1).alias("package"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for package, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    members = dict(_members(data))
                    meta, spine = package_parts(members)
                except (ValueError, KeyError, StopIteration, NotImplementedError, RuntimeError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError) as e:
                    rows.append((package, 0, "error", f"{type(e).__name__}: {e}", None))
                    continue
                rows += [(package, 0, f, v, None) for f, v in meta] + [(package, n, p, m, members[p].decode("utf-8", "replace")) for n, p, m in spine if p in members]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["package", "place", "name", "value", "html"])

    rows = files.mapInArrow(run, "package string, place int, name string, value string, html string")
    meta = rows.where("place = 0").select("package", F.col("name").alias("field"), "value")
    return meta, rows.where("place > 0").select("package", "place", F.col("name").alias("path"), F.col("value").alias("media_type"), "html")


def epub_bytes(title: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """An EPUB of (title, XHTML body) chapters, with a navigation document and an NCX."""
    from xml.sax.saxutils import escape, quoteattr

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(1, len(chapters) + 1))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(chapters) + 1))
        more = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language></metadata><manifest>{items}{more}</manifest><spine toc="ncx">{refs}</spine></package>')
        links = "".join(f'<li><a href="c{i}.xhtml">{escape(name)}</a></li>' for i, (name, _) in enumerate(chapters, 1))
        z.writestr("OEBPS/nav.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{escape(name)}</text></navLabel><content src="c{i}.xhtml"/></navPoint>' for i, (name, _) in enumerate(chapters, 1))
        head = f'<head><meta name="dtb:uid" content={quoteattr(title)}/></head>'
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">{head}<docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        for i, (name, body) in enumerate(chapters, 1):
            z.writestr(f"OEBPS/c{i}.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(name)}</title></head><body>{body}</body></html>')
    return out.getvalue()


def epubs(chapters: DataFrame) -> DataFrame:
    """(book, content) packages from (book, language, position, title, body); a book's chapters meet in one row."""
    rows = chapters.groupBy("book").agg(F.min("language").alias("language"), F.sort_array(F.collect_list(F.struct("position", "title", "body"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [epub_bytes(b, lang or "und", [(x["title"] or "", x["body"] or "") for x in c]) for b, lang, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["book", "content"])

    return rows.mapInArrow(run, "book string, content binary")


def includes(spark: SparkSession, path: str) -> DataFrame:
    """(name, included) edges of the TeX files of a folder."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.tex").text(path)
    rows = rows.select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.tex$", "").alias("name"), F.regexp_replace("value", r"(?m)(?<!\\)%.*$", "").alias("text"))
    return rows.select("name", F.explode(F.regexp_extract_all("text", F.lit(r"\\(?:input|include)\{([^}]*)\}"), F.lit(1))).alias("included")).withColumn("included", F.regexp_replace("included", r"\.tex$|^\./", ""))


def reachable(edges: DataFrame, root: str) -> DataFrame:
    """Names that a root includes, itself first, with the least depth. Ends when a level brings no new name, so circles do
    no harm; each level is written, so that the plan grows by one scan a level."""
    level = edges.sparkSession.createDataFrame([(root, 0)], "name string, depth int")
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        level = cut(edges.join(level.select("name"), "name", "left_semi").select(F.col("included").alias("name")).distinct().join(out.select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)))
        out = out.unionByName(level)
    return out


def receipt(df: DataFrame, path: str) -> DataFrame:
    """Appends (stage, name, sha256) rows to a table of receipts and gives the table."""
    df.select("stage", "name", "sha256").withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)
