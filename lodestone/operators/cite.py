"""Sources and citations: grouping chunks by source, matching sentences, markers, reports."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T


def sources(results: DataFrame) -> DataFrame:
    """Per query one row a source, numbered by score: its best chunk, whole as ``content``, a title and a preview for display.

    results (query_id, doc_id, content, score and, where known, parent_id, source_url,
    source_path, page_title)."""
    optional = [c if c in results.columns else F.lit(None).cast("string").alias(c) for c in ("parent_id", "source_url", "source_path", "page_title")]
    rows = results.select("query_id", "doc_id", "content", "score", *optional)
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    key = F.coalesce(filled("parent_id").cast("string"), filled("source_url"), filled("source_path"), F.col("doc_id").cast("string"))
    best = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id")
    one = rows.withColumn("source", key).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source")).alias("number")
    kind = F.when(filled("source_url").isNotNull(), "web").when(filled("source_path").isNotNull(), "indexed").otherwise("unknown")
    out = one.select("query_id", number, "source", "doc_id", "score", kind.alias("source_type"), "content", F.substring("content", 1, 500).alias("preview"), F.coalesce(filled("page_title"), T.title(F.col("content"))).alias("title"))
    return out.withColumn("title", F.coalesce("title", F.concat(F.lit("Source "), F.col("number").cast("string"))))


def match(sentences: DataFrame, found: DataFrame, least: int = 2) -> DataFrame:
    """Each sentence (query_id, sentence_no, sentence) with the source (query_id, number,
    content) that shares most of its keywords, ``least`` of them; ties to the first source."""
    a = sentences.where(F.length("sentence") >= 10).select("query_id", "sentence_no", "sentence", F.explode(T.keyword_set(F.col("sentence"))).alias("word"))
    b = found.select("query_id", "number", F.explode(T.keyword_set(F.col("content"))).alias("word"))
    counts = a.join(b, ["query_id", "word"]).groupBy("query_id", "sentence_no", "number").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    w = Window.partitionBy("query_id", "sentence_no").orderBy(F.desc("overlap"), "number")
    best = counts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return best.withColumn("confidence", F.least(F.lit(0.9), F.col("overlap") / 10))


def coverage(sentences: DataFrame, matched: DataFrame) -> DataFrame:
    """(query_id, coverage): the share of distinct sentences that have a citation."""
    total = sentences.groupBy("query_id").agg(F.count("*").alias("n"))
    cited = matched.groupBy("query_id").agg(F.countDistinct("sentence_no").alias("cited"))
    return total.join(cited, "query_id", "left").select("query_id", (F.coalesce("cited", F.lit(0)) / F.col("n")).alias("coverage"))


def insert_markers(answer: str, claims: Iterable[tuple[str, list[int]]], style: str = "inline", most: int = 3) -> str:
    """Markers after the sentences of the claims, (text, numbers of sources)."""
    before, between, after = R.MARKERS_BY_STYLE[style]
    for claim, numbers in claims:
        at = answer.find(claim) if claim and numbers else -1
        if at < 0:
            continue
        stop = at + len(claim)
        # the end of the sentence, by the first of these marks that stands near
        ends = (answer.find(mark, at) for mark in ".!?")
        stop = next((e + 1 for e in ends if 0 <= e < stop + 50), stop)
        answer = answer[:stop] + before + between.join(map(str, numbers[:most])) + after + answer[stop:]
    return answer


def cited(answers: DataFrame, citations: DataFrame, style: str = "inline") -> DataFrame:
    """answers (query_id, answer) with the markers of citations (query_id, sentence_no, sentence, number)."""
    claims = citations.groupBy("query_id", "sentence_no", "sentence").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    ordered = claims.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence", "numbers"))).alias("claims"))

    @F.pandas_udf("string")
    def mark(texts: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or c is None else insert_markers(t, [(x["sentence"], list(x["numbers"])) for x in c], style) for t, c in zip(texts, many, strict=True)])

    return answers.join(ordered, "query_id", "left").select("query_id", mark("answer", "claims").alias("answer"))


def bibliography(found: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, bibliography): a numbered line a source."""
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("source"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("number", line.alias("line"))))
    return found.where(F.col("number") <= most).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("bibliography"))


def audit(answers: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """Per answer (query_id, answer, at): its audit id, sources, citations and their mean confidence."""
    n = found.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    m = matched.groupBy("query_id").agg(F.count("*").alias("n_citations"), F.avg("confidence").alias("confidence"))
    rows = answers.join(n, "query_id", "left").join(m, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("query_id", T.audit_id(F.col("answer"), F.col("at")).alias("audit_id"), zero("n_sources"), zero("n_citations"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
