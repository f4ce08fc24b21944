"""Chunkers: one text to several, as vectorised functions over Arrow batches and posexplode.

Cutting a text is a fold with state (sizes so far, the last header), so the cutters are plain
functions of one text; ``chunks`` runs one over a column and gives each piece its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import codeblocks

Cutter = Callable[[str], list[str]]

TARGET, LEAST, MOST, CARRY = 800, 200, 1500, 100


def spans(text: str, size: int = 512, overlap: int = 50, separator: str = " ", compat: bool = False) -> Iterator[tuple[int, int]]:
    """Windows of ``size`` characters that end after their last separator and overlap.

    compat: as a splitter that looks back one window only; it may repeat a window and end
    with one that lies in the window before.  Otherwise each window goes beyond the last."""
    if len(text) <= size:
        yield 0, len(text)
        return
    start, before = 0, -1
    while start < len(text):
        end = start + size
        cut = text.rfind(separator, start, end) if end < len(text) else -1
        if cut > start:
            end = cut + len(separator)
        yield start, min(end, len(text))
        if end >= len(text) and not compat:
            return
        following = end - overlap
        if following <= (before if compat else start):
            following = end
        start, before = following, start


def fixed(text: str, size: int = 512, overlap: int = 50, separator: str = " ", compat: bool = False) -> list[str]:
    if len(text) <= size:
        return [text]
    return [piece for a, b in spans(text, size, overlap, separator, compat) if (piece := text[a:b].strip())]


def packed(pieces: Iterable[tuple[str, bool]], target: int, carry: int = -1, extra: int = 0) -> Iterator[list[str]]:
    """Runs of pieces of up to ``target`` characters (each counting ``extra`` more).  A piece
    marked fresh begins a run; else a last piece of up to ``carry`` characters is repeated."""
    run: list[str] = []
    size = 0
    for piece, fresh in pieces:
        if run and (fresh or size + len(piece) + extra > target):
            yield run
            run = [run[-1]] if not fresh and len(run[-1]) <= carry else []
            size = sum(len(p) for p in run)
        run.append(piece)
        size += len(piece) + extra
    if run:
        yield run


def lines(text: str, target: int = TARGET) -> list[str]:
    return ["\n".join(run) for run in packed(((line, False) for line in text.split("\n")), target, extra=1)]


def prose(text: str, target: int = TARGET, most: int = MOST, carry: int = CARRY) -> list[str]:
    """Paragraphs; those over ``most`` characters by sentences."""

    def pieces() -> Iterator[tuple[str, bool]]:
        for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
            if len(paragraph) <= most:
                yield paragraph, False
            else:
                for k, sentence in enumerate(re.split(r"(?<=[.!?])\s+", paragraph)):
                    yield sentence, k == 0

    return ["\n\n".join(run) for run in packed(pieces(), target, carry)]


def markdown(text: str, target: int = TARGET, least: int = LEAST) -> list[str]:
    """Sections under their headers; what is cut within one names its header."""
    out: list[str] = []
    run: list[str] = []
    header = ""
    for part in filter(None, map(str.strip, re.split(r"(?m)^(#{1,6}\s+.+)$", text))):
        size = sum(map(len, run))
        head = re.match(r"#{1,6}\s", part) is not None
        if run and size > least and (head or size + len(part) > target):
            out.append("\n\n".join(run))
            run = [] if head or not header else [f"[Continued from: {header}]"]
        if head:
            header = part
        run.append(part)
    return [*out, "\n\n".join(run)] if run else out


DEFINITION = re.compile(r"(?:\A|(?<=\n))(?=(?:def |class |function |const |async function |export ).)", re.DOTALL)


def code(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """Definitions, several to a chunk; long ones, and texts without any, by lines."""
    begin = [m.start() for m in DEFINITION.finditer(text)]
    if not begin:
        return lines(text, target)
    blocks = [text[a:b].strip() for a, b in zip(begin, [*begin[1:], len(text)], strict=True)]
    out: list[str] = []
    small: list[str] = []

    def flush() -> None:
        out.extend("\n\n".join(run) for run in packed(((b, False) for b in small), target))
        small.clear()

    for block in blocks:
        if len(block) <= most:
            small.append(block)
        else:
            flush()
            out.extend(lines(block, target))
    flush()
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(kind, chunk) of a repository's Markdown: questions with answers if there are two and
    more, else sections under headers of three levels, else paragraphs."""
    asked = re.findall(r"\*\*([^*]+)\*\*\s*\n+(.*?)(?=\*\*[^*]+\*\*\s*\n|\Z)", text, re.DOTALL)
    if len(asked) >= 2:
        pairs = [(q.strip(), a.strip()) for q, a in asked]
        answered = [("qa", f"**Question:** {q}\n\n**Answer:** {a}") for q, a in pairs if len(a) >= 20]
        if answered:
            return answered
    heads = list(re.finditer(r"(?m)^#{1,3}\s+.+$", text))
    edges = [*((h.group(), h.end()) for h in heads)] or [("", 0)]
    stops = [*(h.start() for h in heads[1:]), len(text)]
    bodies = [(head, text[a:b].strip()) for (head, a), b in zip(edges, stops, strict=True)]
    under = [("section", f"{head}\n\n{body}" if head else body) for head, body in bodies if len(body) > 50]
    if under:
        return under
    joined: list[str] = []
    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        if joined and len(joined[-1]) + len(paragraph) < 2000:
            joined[-1] += "\n\n" + paragraph
        else:
            joined.append(paragraph)
    return [("paragraph", p) for p in joined if len(p) > 50]


def translation_parts(text: str, most: int = 4000) -> list[str]:
    """Paragraphs of up to ``most`` characters; longer ones by sentences, then by words."""

    def fine(piece: str, levels: list[str]) -> Iterator[str]:
        if len(piece) <= most or not levels:
            yield piece
            return
        parts = [p for p in re.split(levels[0], piece) if p]
        for run in packed(((p, False) for q in parts for p in fine(q, levels[1:])), most, extra=1):
            yield " ".join(run)

    return [p for paragraph in text.split("\n\n") if paragraph.strip() for p in fine(paragraph.strip(), [r"(?<=[.!?])\s+", r"\s+"])]


def semantic(text: str, kind: str, target: int = TARGET, least: int = LEAST, most: int = MOST) -> list[str]:
    """By the document's type; a text of up to ``least`` characters is one chunk."""
    text = text.strip()
    if len(text) <= least:
        return [text] if text else []
    cut = {"code": partial(code, target=target, most=most), "markdown": partial(markdown, target=target, least=least)}
    return [c for c in map(str.strip, cut.get(kind, partial(prose, target=target, most=most))(text)) if c]


def chunks(docs: DataFrame, cutter: Cutter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk_total, content) of every text; null texts have none."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cutter(t) if t is not None else [])

    found = docs.select(F.col(id_col).alias("id"), cut(F.col(text_col)).alias("c"))
    out = found.select(F.col("id").alias(id_col), F.size("c").alias("chunk_total"), F.posexplode("c").alias("chunk_index", "content"))
    return out.select(id_col, "chunk_index", "chunk_total", "content")


def semantic_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id, doc_type, chunk_index, chunk_type, content) by each document's own type."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([semantic(t, k, target, least, most) if t is not None else [] for t, k in zip(texts, kinds, strict=True)], dtype=object)

    kind = T.document_type(T.strip(F.col(text_col)))
    found = docs.select(F.col(id_col).alias("id"), kind.alias("doc_type"), F.length(T.strip(F.col(text_col))).alias("n"), cut(F.col(text_col), kind).alias("c"))
    out = found.select("id", "doc_type", "n", F.posexplode("c").alias("chunk_index", "content"))
    chunk_type = F.when(F.col("n") <= least, "full_document").otherwise(T.chunk_type(F.col("content"), F.col("doc_type")))
    return out.select(F.col("id").alias(id_col), "doc_type", "chunk_index", chunk_type.alias("chunk_type"), "content")


def fill_gaps(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", slack: int = 50, least: int = LEAST // 4) -> DataFrame:
    """chunks (id, start, stop, chunk_type) with chunks for what they leave out of the texts
    (id, text): gaps of over ``slack`` characters, and remainders, that have ``least`` without blanks."""
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("start", "stop")
    before = chunks.select(id_col, F.col("start").alias("stop"), F.coalesce(F.lag("stop").over(w), F.lit(0)).alias("start"), F.lit("gap_fill").alias("chunk_type"))
    # the text after the chunk that starts last
    last = chunks.groupBy(id_col).agg(F.max(F.struct("start", "stop")).alias("m")).select(id_col, F.col("m.stop").alias("start"))
    after = last.join(docs, id_col).select(id_col, F.length("text").alias("stop"), "start", F.lit("remainder").alias("chunk_type"))
    gaps = before.unionByName(after).where(F.col("stop") > F.col("start") + slack).join(docs, id_col)
    inside = F.length(T.strip(F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start"))))
    return chunks.unionByName(gaps.where(inside >= least).select(*chunks.columns))


def code_chunks(files: DataFrame, path_col: str = "path", text_col: str = "text", most: int = 2000, least: int = 100) -> DataFrame:
    """(path, language, chunk_index, block_type, block_name, start_line, end_line, content, indexable) of source files."""
    kind = "array<struct<block_type:string,block_name:string,start_line:int,end_line:int,imports:string,content:string>>"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([[c._asdict() for c in codeblocks.chunks(t, k, most, least)] if t else [] for t, k in zip(texts, languages, strict=True)], dtype=object)

    language = T.code_language(F.col(path_col))
    found = files.select(F.col(path_col).alias("path"), language.alias("language"), cut(F.col(text_col), language).alias("c"))
    rows = found.select("path", "language", F.posexplode("c").alias("chunk_index", "c")).select("path", "language", "chunk_index", "c.*")
    named = F.when(F.col("block_name").isNotNull(), F.concat(F.lit(" | "), F.col("block_type"), F.lit(": "), F.col("block_name"))).otherwise("")
    head = F.concat(F.lit("File: "), F.col("path"), named, F.lit(" | Language: "), F.col("language"))
    context = F.when(F.col("imports").isNotNull(), F.concat(F.lit("Imports:\n"), F.col("imports")))
    return rows.withColumn("indexable", F.concat_ws("\n\n", head, context, F.concat(F.lit("Code:\n"), F.col("content")))).drop("imports")


def section_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, content_type, content) of Markdown files of a repository."""

    @F.pandas_udf("array<struct<content_type:string,content:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"content_type": k, "content": c} for k, c in sections(t)] if t is not None else [])

    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(cut(F.col(text_col))).alias("chunk_index", "c"))
    return rows.select(F.col("id").alias(id_col), "chunk_index", "c.*")


def hierarchical(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, content, doc_level, parent_id, child_index, child_total): every text as a parent
    and its pieces as children, ids by content and place."""
    from lodestone.sources.store import content_id

    parents = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("content"), F.col(id_col).cast("string").alias("source"))
    parents = parents.withColumn("doc_id", content_id(F.col("content"), {"doc_level": F.lit("parent"), "source": F.col("source")}))
    cut = chunks(parents.select("doc_id", "content"), partial(fixed, size=size, overlap=overlap), "doc_id", "content")
    meta = {"child_index": F.col("chunk_index"), "child_total": F.col("chunk_total"), "doc_level": F.lit("child"), "parent_id": F.col("doc_id")}
    children = cut.select(content_id(F.col("content"), meta).alias("doc_id"), "content", F.lit("child").alias("doc_level"), F.col("doc_id").alias("parent_id"), F.col("chunk_index").alias("child_index"), F.col("chunk_total").alias("child_total"))
    none = F.lit(None)
    up = parents.select("doc_id", "content", F.lit("parent").alias("doc_level"), none.cast("string").alias("parent_id"), none.cast("int").alias("child_index"), none.cast("int").alias("child_total"))
    return up.unionByName(children)
