"""Judging retrieved context, critiques and verified claims: aggregates and rules over rows.

Results are rows (query_id, rank, content, score); queries (query_id, text).  Word overlaps
are counts of one join on words, so no pair of query and document is compared twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T

CONSIDERED = 8


def overlaps(queries: DataFrame, results: DataFrame, most: int = CONSIDERED) -> DataFrame:
    """(query_id, rank, score, n, asked, shared): words asked for, and those each result has."""
    asked = queries.select("query_id", T.word_set(F.col("text")).alias("q"))
    rows = results.where(F.col("rank") <= most).join(asked, "query_id")
    words = T.word_set(F.col("content"))
    return rows.select("query_id", "rank", "score", F.length("content").alias("n"), F.size("q").alias("asked"), F.size(F.array_intersect("q", words)).alias("shared"))


def quick_check(queries: DataFrame, results: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, enough): ``least`` results, as many of a score over 0.5, and as many of the
    first eight with three tenths of the query's words."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.5).alias("high"))
    near = overlaps(queries, results).groupBy("query_id").agg(F.count_if(F.col("shared") >= F.col("asked") * 0.3).alias("near"))
    rows = queries.select("query_id").join(counts, "query_id", "left").join(near, "query_id", "left")
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(0)) >= least for c in ("n", "high", "near")])
    return rows.select("query_id", ok.alias("enough"))


def context_scores(queries: DataFrame, results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query_id, relevance, coverage, specificity, confidence, sufficient, recommendation) of a
    query's first eight results.  A query without results is to be rewritten, with confidence 1."""
    seen = overlaps(queries, results)
    share = F.when(F.col("asked") == 0, 0.5).otherwise(F.col("shared") / F.col("asked"))
    sums = seen.groupBy("query_id").agg(F.avg(share).alias("overlap"), F.avg("score").alias("mean"), F.count_if(share > 0.2).alias("near"), F.sum("n").alias("n"))
    relevance = F.col("overlap") * 5 + F.col("mean") * 5
    coverage = F.least(F.lit(10.0), F.col("near") * 3.0)
    specificity = F.when(F.col("n") > 5000, 8.0).when(F.col("n") > 2000, 6.0).when(F.col("n") > 500, 4.0).otherwise(2.0)
    rows = sums.select("query_id", relevance.alias("relevance"), coverage.alias("coverage"), specificity.alias("specificity"))
    mean = (F.col("relevance") + F.col("coverage") + F.col("specificity")) / 3
    variance = sum((F.pow(F.col(c) - F.col("mean"), F.lit(2.0)) for c in ("relevance", "coverage", "specificity")), F.lit(0.0)) / 3
    rows = rows.withColumn("mean", mean).withColumn("confidence", F.greatest(F.lit(0.4), F.least(F.lit(0.8), 1 - variance / 50)))
    sufficient = F.col("mean") >= threshold * 10
    advice = F.when(sufficient, "proceed").when(F.col("relevance") < 3, "rewrite_query").when(F.col("coverage") < 3, "expand_retrieval").otherwise("proceed")
    found = rows.select("query_id", "relevance", "coverage", "specificity", "confidence", sufficient.alias("sufficient"), advice.alias("recommendation"))
    none = queries.select("query_id").join(found, "query_id", "left_anti")
    zero = [F.lit(0.0).alias(c) for c in ("relevance", "coverage", "specificity")]
    return found.unionByName(none.select("query_id", *zero, F.lit(1.0).alias("confidence"), F.lit(False).alias("sufficient"), F.lit("rewrite_query").alias("recommendation")))


def missing_aspects(query: Column, contents: Column) -> Column:
    """What a query asks for and none of the texts (an array) seems to have; up to three."""
    has = lambda *words: F.exists(contents, lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in words]))
    q = F.lower(query)
    found = F.array(
        F.when(q.contains("how") & ~has("step", "first"), "Step-by-step instructions may be missing"),
        F.when(q.contains("why") & ~has("because", "reason"), "Explanatory content may be missing"),
        F.when(q.contains("compare") | q.contains("difference"), "Comparative analysis may need more sources"),
    )
    return F.array_compact(found)


def suggestions(relevance: Column, coverage: Column) -> Column:
    low = F.when(relevance < 4, F.array(F.lit("Try using more specific keywords"), F.lit("Consider rephrasing the query"))).otherwise(F.array().cast("array<string>"))
    few = F.when(coverage < 4, F.array(F.lit("Search for additional related documents"), F.lit("Try breaking the query into sub-questions"))).otherwise(F.array().cast("array<string>"))
    both = F.concat(low, few)
    return F.when(F.size(both) == 0, F.array(F.lit("Context appears adequate"))).otherwise(F.slice(both, 1, 3))


def proceeds(recommendation: Column, sufficient: Column) -> Column:
    return (recommendation != "abort") & (sufficient | recommendation.isin("proceed", "expand_retrieval"))


def normal_evaluation(rows: DataFrame) -> DataFrame:
    """Evaluations of a model put right: scores within 0 and 10 (5 if missing), a known recommendation."""
    scores = [F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(F.try_to_number(F.col(c), F.lit("S99.99")).cast("double") if rows.schema[c].dataType.simpleString() == "string" else F.col(c).cast("double"), F.lit(5.0)))).alias(c) for c in ("relevance", "coverage", "specificity", "freshness") if c in rows.columns]
    known = F.when(F.col("recommendation").isin("proceed", "expand_retrieval", "rewrite_query", "abort"), F.col("recommendation")).otherwise("proceed")
    rest = [c for c in rows.columns if c not in ("relevance", "coverage", "specificity", "freshness", "recommendation", "sufficient")]
    return rows.select(*rest, F.coalesce("sufficient", F.lit(True)).alias("sufficient"), *scores, known.alias("recommendation"))


def critique_confidence(confidence: Column, relevance: Column, faithfulness: Column, coverage: Column) -> Column:
    """A critique's confidence within 0 and 1; where none was given (0.5), the mean of its scores."""
    five = lambda c: F.coalesce(c, F.lit(5.0))
    given = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5))))
    return F.when(given == 0.5, (five(relevance) + five(faithfulness) + five(coverage)) / 30).otherwise(given)


def gives_up(confidence: Column, retries: Column, most: int = 2, threshold: float = 0.4) -> Column:
    return ((retries >= most) & (confidence < threshold)) | ((confidence < 0.2) & (retries > 0))


def retrieval_quality(results: DataFrame, most: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, quality): the mean score of the first ten, within 0 and 1; 0 for those of ``queries`` without results."""
    mean = F.avg("score")
    found = results.where(F.col("rank") <= most).groupBy("query_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("quality"))
    return found if queries is None else queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("quality", F.lit(0.0)).alias("quality"))


def factuality(claims: DataFrame, key: str = "answer_id") -> DataFrame:
    """Per answer: claims by status, the score, whether it is factual or to be corrected.

    claims (answer_id, status, confidence, requires): the score is the mean of weight and
    confidence over claims that require verification, 1 without any."""
    weight = F.create_map(*[F.lit(x) for pair in R.STATUS_WEIGHTS.items() for x in pair])
    scored = F.coalesce(F.try_element_at(weight, F.col("status")), F.lit(0.5)) * F.col("confidence")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in R.STATUS_WEIGHTS]
    rows = claims.groupBy(key).agg(F.count("*").alias("n"), *counts, F.coalesce(F.avg(F.when(F.col("requires"), scored)), F.lit(1.0)).alias("score"))
    factual = (F.col("score") >= 0.7) & (F.col("contradicted") == 0)
    wrong = (F.col("contradicted") > 0) | (F.col("not_supported") > F.col("n") * 0.3)
    return rows.select(key, *R.STATUS_WEIGHTS, "score", factual.alias("is_factual"), wrong.alias("needs_correction"))


def issues(claims: DataFrame, key: str = "answer_id", most: int = 5) -> DataFrame:
    """(answer_id, issues): contradicted claims, and unsupported ones of a confidence over 0.7."""
    short = F.concat(F.lit("'"), F.substring("text", 1, 50), F.lit("...'"))
    line = F.when(F.col("status") == "contradicted", F.concat(F.lit("Contradicted claim: "), short, F.lit(" - "), F.coalesce("explanation", F.lit(""))))
    line = line.when((F.col("status") == "not_supported") & (F.col("confidence") > 0.7), F.concat(F.lit("Unsupported claim: "), short))
    found = claims.select(key, "claim_id", line.alias("line")).where("line is not null")
    ordered = F.array_sort(F.collect_list(F.struct("claim_id", "line")))
    return found.groupBy(key).agg(F.slice(F.transform(ordered, lambda x: x["line"]), 1, most).alias("issues"))
