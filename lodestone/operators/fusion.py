"""Joining runs and results: rank fusion, first-seen, auto-merge of children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.sparse import top_k


def rrf(runs: list[DataFrame], k: int = 15, constant: int = 60) -> DataFrame:
    """Sum over runs of 1 / (constant + rank), from runs of (query_id, doc_id, rank)."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in runs])
    scored = rows.groupBy("query_id", "doc_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"))
    return top_k(scored, k)


def first_seen(results: DataFrame) -> DataFrame:
    """Each document once, where the earliest query has it; ranked anew by query and rank."""
    w = Window.partitionBy("doc_id").orderBy("query_id", "rank")
    kept = results.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    # places within a query, behind those of the queries before: the one window without keys has a row a query
    counts = kept.groupBy("query_id").agg(F.count("*").alias("n"))
    before = counts.select(F.col("query_id").alias("_q"), (F.sum("n").over(Window.orderBy("query_id")) - F.col("n")).alias("_before"))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return placed.join(before, F.col("query_id").eqNullSafe(F.col("_q"))).withColumn("place", (F.col("place") + F.col("_before")).cast("long")).drop("_q", "_before")


def distinct_queries(queries: DataFrame) -> DataFrame:
    """(pos, text): each text once, at its first place."""
    return queries.groupBy("text").agg(F.min("pos").alias("pos")).select("pos", "text")


def append_missing(fused: DataFrame, more: DataFrame, score: float = 0.7) -> DataFrame:
    """Documents of ``more`` (query_id, doc_id) that a query's results lack, at a fixed score."""
    new = more.select("query_id", "doc_id").distinct().join(fused, ["query_id", "doc_id"], "left_anti")
    return fused.select("query_id", "doc_id", "score").unionByName(new.withColumn("score", F.lit(score)))


def auto_merge(children: DataFrame, parents: DataFrame, least: int = 2, longest: int = 50_000, k: int | None = None) -> DataFrame:
    """children (query_id, doc_id, parent_id, score): where ``least`` of a parent (parent_id, and
    length where it is known) are found for a query, the parent takes their place with the best
    score, unless it is longer than ``longest``; then the best of each doc_id, k a query."""
    known = parents.where(F.col("length") <= longest) if "length" in parents.columns else parents
    groups = children.where("parent_id is not null").groupBy("query_id", "parent_id").agg(F.count("*").alias("n"), F.max("score").alias("best")).where(F.col("n") >= least)
    merged = groups.join(known.select("parent_id").distinct(), "parent_id", "left_semi")
    up = merged.select("query_id", F.col("parent_id").alias("doc_id"), F.col("best").alias("score"))
    stay = children.join(merged.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti").select("query_id", "doc_id", "score")
    out = up.unionByName(stay).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return out if k is None else top_k(out, k)
