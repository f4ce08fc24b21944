"""Chunks proposed from outside (by a model, say), made into an exact cover of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.chunking import LEAST

_SPAN = "struct<start:int,stop:int,chunk_type:string>"


def pattern(most: int) -> str:
    """The next piece of a text: the rest if it fits, up to the last blank that fits, or ``most`` characters."""
    return rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}}[ \t\r\n]|.{{1,{most}}}"


def repaired(proposals: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = 2000, slack: int = 50) -> DataFrame:
    """(id, place, start, stop, chunk_type, content) for proposals (id, start, stop, chunk_type) over docs (id, text), each character of a text in one chunk.

    Proposals are clamped to the text; of two that overlap the later one begins where the
    earlier one ends (equal starts: the longer one first); what is shorter than half of ``least`` before or
    after that goes.  A gap of at most ``slack`` characters joins the chunk before it, or the first
    one; a longer one becomes a ``gap_fill``; a text without proposals left is one ``whole``.  Chunks over ``most`` are cut behind their
    last blank that fits, or at ``most`` where there is none.

    Null and empty texts have no chunks; proposals without id, bounds or text go; ids of ``docs`` are unique.  Positions
    travel without the texts, which are joined once, a row a document."""
    sizes = docs.select(id_col, F.length(text_col).alias("n")).where("n > 0")
    inside = proposals.select(id_col, "start", "stop", "chunk_type").where("start is not null and stop is not null").join(sizes, id_col)
    inside = inside.withColumns({"start": F.greatest(F.col("start").cast("int"), F.lit(0)), "stop": F.least(F.col("stop").cast("int"), F.col("n"))})
    enough = F.col("stop") - F.col("start") >= max(1, least // 2)
    w = Window.partitionBy(id_col).orderBy("start", F.desc("stop"), "chunk_type")
    taken = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = inside.where(enough).withColumn("taken", taken).withColumn("start", F.greatest("start", "taken")).where(enough)

    w = Window.partitionBy(id_col).orderBy("start")
    around = apart.withColumns({"first": F.lag("stop").over(w).isNull(), "next": F.coalesce(F.lead("start").over(w), F.col("n"))})
    begin = F.when(F.col("first") & (F.col("start") <= slack), 0).otherwise(F.col("start"))
    end = F.when(F.col("next") - F.col("stop") <= slack, F.col("next")).otherwise(F.col("stop"))
    span = lambda start, stop, kind: F.struct(start.alias("start"), stop.alias("stop"), kind.alias("chunk_type"))
    gap = F.lit("gap_fill")
    three = F.array(span(F.when(F.col("first"), 0).otherwise(F.col("begin")), F.col("begin"), gap), span(F.col("begin"), F.col("end"), F.col("chunk_type")), span(F.col("end"), F.col("next"), gap))
    spans = around.withColumns({"begin": begin, "end": end}).select(id_col, F.explode(F.filter(three, lambda s: s["start"] < s["stop"])).alias("s"))
    lists = spans.groupBy(id_col).agg(F.sort_array(F.collect_list("s")).cast(f"array<{_SPAN}>").alias("spans"))

    whole = F.array(span(F.lit(0), F.length(text_col), F.lit("whole")))
    texts = docs.select(id_col, text_col).where(F.length(text_col) > 0).join(lists, id_col, "left").withColumn("spans", F.coalesce("spans", whole))
    cut = lambda s: F.regexp_extract_all(F.substring(F.col(text_col), s["start"] + 1, s["stop"] - s["start"]), F.lit(pattern(most)), F.lit(0))
    pieces = texts.select(id_col, F.posexplode(F.transform("spans", lambda s: F.struct(s["chunk_type"].alias("chunk_type"), cut(s).alias("parts")))).alias("span", "s"))
    rows = pieces.select(id_col, "span", "s.chunk_type", F.posexplode("s.parts").alias("part", "content"))
    w = Window.partitionBy(id_col).orderBy("span", "part")
    # the cover is exact: a chunk begins where the lengths before it add up to
    stop = F.sum(F.length("content")).over(w).cast("int")
    out = rows.withColumns({"place": F.row_number().over(w) - 1, "stop": stop})
    return out.select(id_col, "place", (F.col("stop") - F.length("content")).alias("start"), "stop", "chunk_type", "content")
