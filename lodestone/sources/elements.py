"""Structured documents as rows: one element a row, with its place, heading level and table cell."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T

#: Tags that begin or end an element; all others stand inside a text.
BLOCKS = "h[1-6]|title|p|li|td|th|tr|table|caption|dt|dd|blockquote|pre|div|section|article|header|footer|nav|main|aside|ul|ol|dl|body|head|html"
_KINDS = {"p": "paragraph", "li": "list_item", "td": "cell", "th": "cell", "title": "title", "caption": "caption", "dt": "list_item", "dd": "list_item", "blockquote": "quote", "pre": "code"}


def html_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, place, kind, level, table_no, row_no, cell_no, text) of HTML texts, places from 0 in reading order.

    An element is the text behind a block tag up to the next one; behind a closing or a
    grouping tag its kind is ``text``.  Headings have a level, cells a table, row and cell
    number from 1; the others null.  Empty elements go; null and empty texts have none.
    Rows of one id are numbered as one text."""
    clean = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", ""), "[\x01\x02]", " ")
    marked = F.regexp_replace(clean, rf"(?i)<(/?)({BLOCKS})(\s[^>]*)?>", "\x01$1$2\x02")
    parts = pages.select(F.col(id_col), F.posexplode(F.split(marked, "\x01")).alias("at", "part"))
    tag = F.lower(F.when(F.col("part").contains("\x02"), F.substring_index("part", "\x02", 1)).otherwise(""))
    text = F.regexp_replace(F.substring_index("part", "\x02", -1), "<[^>]*>", " ")
    text = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), R.ENTITIES, text)
    text = T.strip(F.regexp_replace(text, r"(?U)\s+", " "))
    rows = parts.select(id_col, "at", tag.alias("tag"), text.alias("text")).where("text <> '' or tag in ('table', 'tr', 'td', 'th')")
    so_far = Window.partitionBy(id_col).orderBy("at")
    count = lambda names, w: F.count(F.when(F.col("tag").isin(*names), 1)).over(w)
    rows = rows.withColumn("table_no", count(["table"], so_far))
    rows = rows.withColumn("row_no", count(["tr"], Window.partitionBy(id_col, "table_no").orderBy("at")))
    rows = rows.withColumn("cell_no", count(["td", "th"], Window.partitionBy(id_col, "table_no", "row_no").orderBy("at")))
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    kind = reduce(lambda c, pair: c.when(F.col("tag") == pair[0], pair[1]), _KINDS.items(), F.when(level.isNotNull(), "heading")).otherwise("text")
    place = F.row_number().over(so_far) - 1
    cell = [F.when(F.col("kind") == "cell", F.col(c)).alias(c) for c in ("table_no", "row_no", "cell_no")]
    kept = rows.where("text <> ''").withColumns({"kind": kind, "level": level, "place": place})
    return kept.select(id_col, "place", "kind", "level", *cell, "text")


class Element(NamedTuple):
    kind: str
    text: str
    part: str
    level: int | None = None
    table_no: int | None = None
    row_no: int | None = None
    cell_no: int | None = None


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _name(k) == name), None)


def _related(archive: zipfile.ZipFile, of: str) -> dict[str, str]:
    """Members that a member refers to, by reference id."""
    folder, name = posixpath.split(of)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.NameToInfo:
        return {}
    with archive.open(rels) as f:
        found = [(n.get("Id"), n.get("Target", "")) for _, n in ElementTree.iterparse(f) if _name(n.tag) == "Relationship"]
    return {i: (t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))) for i, t in found}


def _flow(archive: zipfile.ZipFile, member: str, part: str) -> Iterator[Element]:
    """Paragraphs and table cells of a text document or slide, in reading order.

    A cell's paragraphs are one element; a table inside a cell comes before what follows it
    in that cell.  Nodes are cleared as they end, so that one paragraph is held at a time."""
    tables = 0
    stack: list[list[int]] = []  # table, row, cell of the tables we stand in
    texts: list[list[str]] = [[]]
    style, listed, title = "", False, False
    with archive.open(member) as f:
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            name = _name(node.tag)
            if event == "start":
                if name == "tbl":
                    tables += 1
                    stack.append([tables, 0, 0])
                elif name == "tr" and stack:
                    stack[-1][1:] = [stack[-1][1] + 1, 0]
                elif name == "tc" and stack:
                    stack[-1][2] += 1
                    texts.append([])
                elif name == "p" and len(texts) == 1:
                    texts[0].clear()
                    style, listed = "", False
                elif name == "sp":
                    title = False
                continue
            if name == "t" and node.text:
                texts[-1].append(node.text)
            elif name in ("tab", "br", "cr"):
                texts[-1].append(" ")
            elif name == "pStyle":
                style = _attribute(node, "val") or ""
            elif name in ("numPr", "buAutoNum", "buChar"):
                listed = True
            elif name == "ph":
                title = _attribute(node, "type") in ("title", "ctrTitle")
            elif name == "tbl" and stack:
                stack.pop()
            elif name == "tc" and stack:
                text = " ".join("".join(texts.pop()).split())
                if text:
                    yield Element("cell", text, part, None, *stack[-1])
            elif name == "p":
                if len(texts) > 1:
                    texts[-1].append(" ")
                else:
                    text = " ".join("".join(texts[0]).split())
                    texts[0].clear()
                    heading = re.match(r"(?i)heading\s*([1-9])", style)
                    if text:
                        yield Element("heading" if heading else "title" if title or style.lower() == "title" else "list_item" if listed else "paragraph", text, part, int(heading[1]) if heading else None)
            if name in ("p", "tc", "tr", "tbl", "sp"):
                node.clear()


def _shared(archive: zipfile.ZipFile) -> list[str]:
    """The strings that the sheets of a workbook share."""
    if "xl/sharedStrings.xml" not in archive.NameToInfo:
        return []
    out = []
    with archive.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if _name(node.tag) == "si":
                out.append("".join(t.text or "" for t in node.iter() if _name(t.tag) == "t"))
                node.clear()
    return out


def _column(reference: str) -> int:
    """A=1, Z=26, AA=27."""
    return reduce(lambda n, c: n * 26 + ord(c) - 64, re.match("[A-Z]*", reference)[0], 0)


def _sheets(archive: zipfile.ZipFile) -> Iterator[Element]:
    shared, related, number = _shared(archive), _related(archive, "xl/workbook.xml"), 0
    with archive.open("xl/workbook.xml") as f:
        sheets = [(n.get("name", ""), related.get(_attribute(n, "id"))) for _, n in ElementTree.iterparse(f) if _name(n.tag) == "sheet"]
    for number, (sheet, member) in enumerate(sheets, 1):
        row, cell = 0, 0
        with archive.open(member) as f:
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                name = _name(node.tag)
                if event == "start":
                    if name == "row":
                        row, cell = int(node.get("r") or row + 1), 0
                    continue
                if name == "c":
                    cell = _column(node.get("r") or "") or cell + 1
                    kind = node.get("t")
                    value = "".join(t.text or "" for t in node.iter() if _name(t.tag) == ("t" if kind == "inlineStr" else "v"))
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
                    value = " ".join(value.split())
                    if value:
                        yield Element("cell", value, sheet, None, number, row, cell)
                if name == "row":
                    node.clear()


def _slides(archive: zipfile.ZipFile) -> Iterator[Element]:
    related = _related(archive, "ppt/presentation.xml")
    with archive.open("ppt/presentation.xml") as f:
        members = [related[_attribute_id(n)] for _, n in ElementTree.iterparse(f) if _name(n.tag) == "sldId"]
    for number, member in enumerate(members, 1):
        yield from _flow(archive, member, f"slide {number}")


def _attribute_id(node: ElementTree.Element) -> str | None:
    """The reference of a slide: ``id`` in the name space of relationships, as it has a plain ``id`` too."""
    return next((v for k, v in node.attrib.items() if k.startswith("{") and _name(k) == "id"), None)


def office_elements(content: bytes) -> Iterator[Element]:
    """The elements of one zipped XML document, told apart by the members it has."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:  # shares the bytes, no copy
        names = archive.NameToInfo
        if "word/document.xml" in names:
            yield from _flow(archive, "word/document.xml", "document")
        elif "xl/workbook.xml" in names:
            yield from _sheets(archive)
        elif "ppt/presentation.xml" in names:
            yield from _slides(archive)
        else:
            raise ValueError("no text document, workbook or presentation")


_BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, ValueError, KeyError, IndexError, EOFError, RuntimeError, NotImplementedError)
_SCHEMA = pa.schema([("path", pa.string()), ("place", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("part", pa.string()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("cell_no", pa.int32()), ("text", pa.string()), ("error", pa.string())])
_BATCH = 4096


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, place = path.as_py(), 0
                try:
                    for place, e in enumerate(office_elements(content.as_py() or b""), 1):
                        yield (path, place - 1, e.kind, e.level, e.part, e.table_no, e.row_no, e.cell_no, e.text, None)
                except _BROKEN as e:
                    yield (path, place, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")

    kept: list[tuple] = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
    for row in rows():
        kept.append(row)
        if len(kept) == _BATCH:
            yield pack()
            kept.clear()
    if kept:
        yield pack()


def elements_of(files: DataFrame) -> DataFrame:
    """(path, place, kind, level, part, table_no, row_no, cell_no, text, error) of zipped XML files (path, content).

    ``part`` is the sheet's name, ``slide n`` or ``document``.  A file that can't be read has
    one row with an error behind the elements read before; null content counts as broken."""
    ddl = "path string, place int, kind string, level int, part string, table_no int, row_no int, cell_no int, text string, error string"
    return files.select("path", "content").mapInArrow(_read, ddl)


def read_office(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The elements of the DOCX, XLSX and PPTX files in folders, to any depth; see ``elements_of``.

    Files without a byte have no row, as the scan leaves them out.  A task reads ``spark.sql.files.maxPartitionBytes`` of files and unpacks one at a time,
    member by member as a stream: of a text one paragraph is held, of a workbook a row and the shared strings."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx,pptx}").load(paths)
    return elements_of(rows.where(~F.element_at(F.split("path", "/"), -1).startswith(".")))


def texts_of(elements: DataFrame) -> DataFrame:
    """(path, content) of the elements of ``elements_of``: a line an element, headings as in Markdown, a row's cells joined by tabs.
    Broken files have none."""
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).when(F.col("kind") == "list_item", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    # a row is one line, at the place of its first cell
    key = F.coalesce(F.concat_ws(":", "table_no", "row_no"), F.lit(""))
    one = elements.where("error is null").withColumns({"line": line, "key": F.when(F.col("kind") == "cell", key).otherwise(F.concat(F.lit("p"), F.col("place")))})
    joined = lambda rows, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "line"))), lambda x: x["line"]), rows)
    lines = one.groupBy("path", "key").agg(F.min("place").alias("first"), joined("\t", "place").alias("line"))
    return lines.groupBy("path").agg(joined("\n", "first").alias("content"))
