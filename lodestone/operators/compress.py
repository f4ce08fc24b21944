"""Fitting context into a budget: which texts to shorten, how far, and which are the same.

Greedy choices (what is kept depends on what was kept before) run over one query's ranked
results, a bounded list, in one function a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.setjoin import similar_classes, similar_pairs  # noqa: F401


def needs_summary(docs: DataFrame, key: str, text_col: str = "text", budget: int = 8000, most: int = 2000) -> DataFrame:
    n = F.length(text_col)
    return docs.groupBy(key).agg(((F.sum(n) > budget) | (F.max(n) > most)).alias("needs_summary"))


def budgets(results: DataFrame, total: int = 3000) -> DataFrame:
    """results (query_id, doc_id, score) with the characters each may take: half as much again as its share of the
    scores, or equal shares of the total where they don't add up to more than 0; 200 at least."""
    w = Window.partitionBy("query_id")
    all_, n = F.sum("score").over(w), F.count("*").over(w)
    share = F.when(all_ > 0, F.col("score") / all_ * total * 1.5).otherwise(F.lit(total) / n)
    return results.withColumn("budget", F.greatest(F.lit(200), F.floor(share)).cast("long"))


def compressed(results: DataFrame, total: int = 3000) -> DataFrame:
    """results (query_id, doc_id, content, score) cut to their budgets at the end of a sentence
    where one ends in the second half, else before three dots, with key facts, lengths and whether they were over budget."""
    rows = budgets(results, total)
    cut = F.substring(F.col("content"), F.lit(1), F.col("budget").cast("int"))
    whole = F.regexp_extract(cut, r"(?s)^(.*[.!?])\s", 1)
    kept = F.when(F.length("content") <= F.col("budget"), F.col("content")).when(F.length(whole) * 2 > F.col("budget"), whole).otherwise(F.concat(F.substring(F.col("content"), F.lit(1), (F.col("budget") - 3).cast("int")), F.lit("...")))
    return rows.select("query_id", "doc_id", "score", kept.alias("content"), T.key_facts(F.col("content")).alias("key_facts"), F.length("content").alias("original"), F.length(kept).alias("compressed"), (F.length("content") > F.col("budget")).alias("over"))


def totals(rows: DataFrame) -> DataFrame:
    """(query_id, original, compressed, ratio, n_compressed) of compressed results: how many were over their budget."""
    out = rows.groupBy("query_id").agg(F.sum("original").alias("original"), F.sum("compressed").alias("compressed"), F.count_if("over").alias("n_compressed"))
    return out.withColumn("ratio", F.when(F.col("original") > 0, F.col("compressed") / F.col("original")).otherwise(1.0))


def distinct_results(results: DataFrame, least: float = 0.85) -> DataFrame:
    """results (query_id, rank, doc_id, content) without those whose words are those of one kept
    before (similarity over ``least``)."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        kept: list[set] = []
        chosen = []
        for text in rows["content"]:
            own = set((text or "").lower().split())
            new = all(len(own & k) <= least * len(own | k) for k in kept if k)
            chosen.append(new)
            if new:
                kept.append(own)
        return rows[chosen]

    return results.groupBy("query_id").applyInPandas(keep, results.schema)


def clusters(results: DataFrame, least: float = 0.85, most: int = 3) -> DataFrame:
    """results (query_id, rank, doc_id, embedding) with the rank of their cluster's first: in
    order, each that is still free takes up to ``most`` - 1 free ones of a cosine of ``least``."""
    import numpy as np

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        m = np.array(rows["embedding"].tolist(), dtype=np.float64).reshape(len(rows), -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        rank, leader = rows["rank"].to_numpy(), np.full(len(rows), -1)
        for i in range(len(rows)):
            if leader[i] < 0:
                free = i + 1 + np.flatnonzero((leader[i + 1 :] < 0) & (m[i + 1 :] @ m[i] >= least))
                leader[i] = leader[free[: most - 1]] = rank[i]
        return rows[["query_id", "rank", "doc_id"]].assign(cluster=leader)

    kind = results.schema["doc_id"].dataType.simpleString()
    query = results.schema["query_id"].dataType.simpleString()
    return results.groupBy("query_id").applyInPandas(group, f"query_id {query}, rank int, doc_id {kind}, cluster int")


def merged(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, content, merged_from, n) of clustered results with content: one text a cluster."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "content")))
    parts = rows.groupBy("query_id", "cluster").agg(ordered.alias("p"))
    return parts.select("query_id", F.element_at("p", 1)["doc_id"].alias("doc_id"), F.array_join(F.transform("p", lambda x: x["content"]), "\n\n---\n\n").alias("content"), F.transform("p", lambda x: x["doc_id"]).alias("merged_from"), F.size("p").alias("n"))


def old_and_recent(turns: DataFrame, recent: int = 2) -> DataFrame:
    """turns (conv_id, turn, text) with ``recent``: whether a turn is one of a conversation's last."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("recent", F.row_number().over(w) <= recent)


def summary(text: F.Column, most: int = 500) -> F.Column:
    """A text of up to ``most`` characters as it is; else its beginning (no model at hand)."""
    return F.when(F.length(text) <= most, text).otherwise(T.truncate(text, most))
