"""Loops over batches of queries: several hops to an answer, and further attempts with other modes.

Each round is a job over the queries that are still active.  Their state (texts, what is known so far, confidence) is a table
that is written after every round and shrinks as queries stop; the driver sees its number of rows alone.  What a
model decides comes from functions of columns, so SQL expressions and Pandas UDFs serve alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.operators import evaluate as E
from lodestone.sources.store import written

#: queries (query_id, text) to results (query_id, doc_id, score, rank, content).
Retrieve = Callable[[DataFrame], DataFrame]

STEPS = "hop int, question string, answer string, confidence double, entities array<string>"


@dataclass(frozen=True)
class Hops:
    """What ``multi_hop`` found: a row a step, a row a document of a query's context, a row a query."""

    steps: DataFrame
    context: DataFrame
    results: DataFrame


def contexts(queries: DataFrame, results: DataFrame, docs: int = 5, characters: int = 1500) -> DataFrame:
    """queries with ``context``: the beginnings of their first documents, numbered; null without any."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("content", 1, characters))
    own = results.where(F.col("rank") <= docs).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return queries.join(own, "query_id", "left").withColumn("context", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")).drop("parts")


def multi_hop(
    queries: DataFrame, retrieve: Retrieve, decompose: Callable[[Column], Column], extract: Callable[[Column, Column, Column], Column],
    enough: Callable[[Column, Column], Column], needed: Callable[[Column], Column] = T.multihop, initial: DataFrame | None = None,
    hops: int = 3, docs: int = 5, least: float = 0.3,
) -> Hops:
    """queries (query_id, text) through up to ``hops`` sub-questions each.

    ``decompose`` gives a text's sub-questions (none: the text itself), ``extract`` of a question, its context and what is known an (answer,
    confidence, entities), ``enough`` whether what is known answers the text.  A query stops when its questions end, at a
    confidence under ``least``, or when at least 20 characters are known and they are enough.  A hop without documents has the answer
    for that, confidence 0.  ``initial`` (query_id, doc_id, rank, ...): documents known before.

    steps: (query_id, hop, question, answer, confidence, entities); context: (query_id, doc_id, hop, place), each document
    where it came first, hop 0 for initial ones; results: (query_id, requires_multihop, total_hops, answers, knowledge)."""
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    asked = written(queries.select("query_id", "text", F.coalesce(needed(F.col("text")), F.lit(False)).alias("needs")), "asked")
    whole = F.array(F.col("text"))
    made = F.coalesce(decompose(F.col("text")), whole)
    state = asked.where("needs").select("query_id", "text", F.slice(F.when(F.size(made) > 0, made).otherwise(whole), 1, hops).alias("questions"), F.lit("").alias("knowledge"))
    state, steps, found = written(state, "hops"), [], []
    for hop in range(1, hops + 1):
        if state.isEmpty():
            break
        now = state.withColumn("question", F.element_at("questions", hop))
        results = written(retrieve(now.select("query_id", F.col("question").alias("text"))).where(F.col("rank") <= docs), "hop")
        seen = contexts(now, results)
        got = extract(F.col("question"), F.col("context"), F.col("knowledge"))
        got = F.when(F.col("context").isNull(), F.struct(F.lit("No information found").alias("answer"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("entities"))).otherwise(got)
        answered = seen.withColumn("got", got).select("query_id", "text", "questions", "question", "knowledge", "got.*")
        known = F.concat("knowledge", F.lit(" "), "answer")
        answered = answered.withColumn("knowledge", F.when(F.lower(F.coalesce("answer", F.lit(""))).isin(*R.UNKNOWN_ANSWERS), F.col("knowledge")).otherwise(known))
        stops = (F.coalesce("confidence", F.lit(0.0)) < least) | (F.size("questions") <= hop)
        stops |= F.when(F.length("knowledge") >= 20, F.coalesce(enough(F.col("text"), F.col("knowledge")), F.lit(False))).otherwise(False)
        answered = written(answered.withColumn("stops", stops), "hops")
        steps.append(answered.select("query_id", F.lit(hop).alias("hop"), "question", "answer", F.col("confidence").cast("double"), "entities", "knowledge"))
        found.append(results.select("query_id", "doc_id", F.lit(hop).alias("hop"), F.col("rank").alias("at")))
        state = answered.where("not stops").select("query_id", "text", "questions", "knowledge")
    none = spark.createDataFrame([], f"query_id {kind}, {STEPS}, knowledge string")
    every = reduce(DataFrame.unionByName, steps, none)
    rows = [*found, *([initial.select("query_id", "doc_id", F.lit(0).alias("hop"), F.col("rank").alias("at"))] if initial is not None else [])]
    if rows:
        first = reduce(DataFrame.unionByName, rows).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("hop", "at"))).where("n = 1")
        context = first.select("query_id", "doc_id", "hop", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "at", "doc_id")).alias("place"))
    else:
        context = spark.createDataFrame([], f"query_id {kind}, doc_id long, hop int, place int")
    by_hop = F.array_sort(F.collect_list(F.struct("hop", "answer")))
    own = every.groupBy("query_id").agg(F.max("hop").alias("total_hops"), F.transform(by_hop, lambda s: s["answer"]).alias("answers"), F.max_by("knowledge", "hop").alias("knowledge"))
    results = asked.join(own, "query_id", "left").select(
        "query_id", F.col("needs").alias("requires_multihop"), F.coalesce("total_hops", F.lit(0)).alias("total_hops"), F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), F.trim(F.coalesce("knowledge", F.lit(""))).alias("knowledge")
    )
    return Hops(every.drop("knowledge"), context, results)


def reasoning_summary(hops: Hops) -> DataFrame:
    """(query_id, summary): the steps as text."""
    line = F.concat(F.lit("  Step "), F.col("hop").cast("string"), F.lit(": "), F.col("question"), F.lit("\n    → Answer: "), F.substring("answer", 1, 100), F.lit("...\n    → Confidence: "), F.format_string("%.2f", "confidence"))
    lines = hops.steps.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hop", line.alias("line")))).alias("lines"))
    rows = hops.results.join(lines, "query_id", "left")
    text = F.concat(F.lit("Multi-hop reasoning ("), F.col("total_hops").cast("string"), F.lit(" hops):\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return rows.select("query_id", F.when(F.col("requires_multihop") & F.col("lines").isNotNull(), text).otherwise("Single-hop reasoning (no chain)").alias("summary"))


@dataclass(frozen=True)
class Attempts:
    """What ``attempts`` found: a row a query, and a row a further attempt."""

    answers: DataFrame
    retries: DataFrame


def attempts(
    queries: DataFrame, search: Callable[[DataFrame, str], DataFrame], generate: Callable[[Column, Column], Column], critique: Callable[[Column, Column, Column], Column],
    mode: Column | str = "hybrid", most: int = 2, threshold: float = 0.4,
) -> Attempts:
    """Answers to queries (query_id, text), tried again in the next mode while a critique asks for it, ``most`` times.

    ``search`` takes queries and a mode to results, ``generate`` a text and its context to an answer, ``critique`` a text, context and answer to
    (confidence, should_retry, issues).  Modes follow each other as ``rules.MODE_CYCLE`` says.  A query whose confidence stays too low is given
    up: ``gave_up``.

    answers: (query_id, answer, confidence, mode, attempts, gave_up); retries: (query_id, attempt, reason, previous_confidence, mode)."""
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    cycle = F.create_map(*[F.lit(x) for pair in R.MODE_CYCLE.items() for x in pair])
    state = written(queries.select("query_id", "text", (F.lit(mode) if isinstance(mode, str) else mode).alias("mode")), "attempt")
    done, again = [], []
    for attempt in range(most + 1):
        modes = sorted(r[0] for r in state.select("mode").distinct().collect())  # three values
        if not modes:
            break
        results = written(reduce(DataFrame.unionByName, [search(state.where(F.col("mode") == m).select("query_id", "text"), m).select("query_id", "doc_id", "rank", "content") for m in modes]), "found")
        seen = contexts(state, results).withColumn("answer", generate(F.col("text"), F.col("context")))
        judged = seen.withColumn("c", critique(F.col("text"), F.col("context"), F.col("answer"))).select("query_id", "text", "mode", "answer", "c.*")
        gone = E.gives_up(F.col("confidence"), F.lit(attempt), most, threshold)
        retry = F.coalesce("should_retry", F.lit(False)) & F.lit(attempt < most)
        judged = written(judged.withColumns({"retry": retry, "gave_up": ~retry & gone}), "attempt")
        done.append(judged.where("not retry").select("query_id", "answer", "confidence", "mode", F.lit(attempt + 1).alias("attempts"), "gave_up"))
        reason = F.when(F.size("issues") > 0, F.array_join("issues", ", ")).otherwise("low confidence")
        next_ = F.coalesce(F.try_element_at(cycle, F.col("mode")), F.lit("hybrid"))
        again.append(judged.where("retry").select("query_id", F.lit(attempt + 1).alias("attempt"), reason.alias("reason"), F.col("confidence").alias("previous_confidence"), next_.alias("mode")))
        state = judged.where("retry").select("query_id", "text", next_.alias("mode"))
    answers = reduce(DataFrame.unionByName, done, spark.createDataFrame([], f"query_id {kind}, answer string, confidence double, mode string, attempts int, gave_up boolean"))
    retries = reduce(DataFrame.unionByName, again, spark.createDataFrame([], f"query_id {kind}, attempt int, reason string, previous_confidence double, mode string"))
    return Attempts(answers, retries)
