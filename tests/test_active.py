"""Loops over active queries against loops over single ones, and the stored cache."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import active, evaluate
from lodestone.operators.cache import ResultCache
from lodestone.operators.sparse import bm25
from lodestone.pipeline import Engine

DOCS = [(i, t) for i, t in enumerate(["red fox hunts mice", "mice eat corn seed", "corn grows in summer fields", "summer fields are red", "owls hunt mice at night", "night is dark", "red corn is rare"])]
ASKED = [
    (1, "what is the food of the animal that hunts? red fox hunts? mice eat? corn grows?"),
    (2, "compare owls and foxes? zebra? mice"),
    (3, "plain question"),
    (4, "compare night and day? night is dark? summer fields"),
    (5, None),
    (6, "difference between corn and seed"),
    (7, "compare mice and corn? mice"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").cache()


def retrieve(docs):
    return lambda q: bm25(docs, q, 5).join(docs.withColumnRenamed("text", "content"), "doc_id")


def decompose(text):
    return F.filter(F.transform(F.split(text, r"\?"), lambda q: F.trim(q)), lambda q: q != "")


def extract(question, context, known):
    first = F.element_at(F.split(context, "\n\n"), 1)
    return F.struct(F.substring(first, 5, 40).alias("answer"), (F.size(F.split(question, " ")) / 4.0).alias("confidence"), F.array(F.length(known).cast("string")).alias("entities"))


def enough(text, known):
    return F.length(known) > 40


def alone(spark, docs, query_id, text):
    """One query by a loop."""
    if text is None or not re.search("what is the .+ of the .+ that|compare .+ and|difference between .+ and", text):
        return [], [], "", False
    steps, seen, known = [], [], ""
    for hop, question in enumerate([q.strip() for q in text.split("?") if q.strip()][:3], 1):
        rows = retrieve(docs)(spark.createDataFrame([(query_id, question)], "query_id long, text string")).orderBy("rank").collect()
        seen += [r["doc_id"] for r in rows if r["doc_id"] not in seen]
        answer, confidence = (rows[0]["content"][:40], len(question.split(" ")) / 4) if rows else ("No information found", 0.0)
        steps.append((hop, question, answer, confidence))
        known += f" {answer}"
        if confidence < 0.3 or (len(known) >= 20 and len(known) > 40):
            break
    return steps, seen, known.strip(), True


def test_hops_equal_single_queries(spark, docs):
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    initial = spark.createDataFrame([(1, 6, 1), (1, 0, 2), (3, 2, 1)], "query_id long, doc_id long, rank int")
    found = active.multi_hop(queries, retrieve(docs), decompose, extract, enough, initial=initial)
    steps, context, results = (sorted(map(tuple, x.collect()), key=str) for x in (found.steps.select("query_id", "hop", "question", "answer", "confidence"), found.context.select("query_id", "place", "doc_id"), found.results))
    own = {i: alone(spark, docs, i, t) for i, t in ASKED}
    assert steps == sorted([(i, *s) for i, (all_, *_) in own.items() for s in all_], key=str)
    assert {len(s) for s, *_ in own.values()} == {0, 1, 2, 3}
    before = {1: [6, 0], 3: [2]}
    places = [(i, n, d) for i in own for n, d in enumerate([*before.get(i, []), *[d for d in own[i][1] if d not in before.get(i, [])]], 1)]
    assert context == sorted(places, key=str)
    assert results == sorted([(i, needs, len(s), [x[2] for x in s], known) for i, (s, _, known, needs) in own.items()], key=str)
    text = {r["query_id"]: r["summary"] for r in active.reasoning_summary(found).collect()}
    assert text[3] == "Single-hop reasoning (no chain)" and text[2].startswith("Multi-hop reasoning (") and "Step 1: compare owls and foxes" in text[2]
    none = active.multi_hop(queries.where("query_id = 3"), retrieve(docs), decompose, extract, enough)
    assert none.steps.count() == none.context.count() == 0 and none.results.count() == 1


def test_attempts(spark, docs):
    queries = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "second"), (4, "hopeless")], "query_id long, text string")
    asked = []

    def search(q, mode):
        asked.append((mode, sorted(r["query_id"] for r in q.collect())))
        return q.select("query_id", F.lit(1).alias("doc_id"), F.lit(1).alias("rank"), F.lit(mode).alias("content"))

    def critique(text, context, answer):
        confidence = F.when(text == "good", 0.9).when((text == "second") & context.contains("bm25"), 0.7).when(text == "hopeless", 0.1).otherwise(0.3)
        return F.struct(confidence.alias("confidence"), ((confidence < 0.6) & (text != "hopeless")).alias("should_retry"), F.when(text == "bad", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("issues"))

    found = active.attempts(queries, search, lambda t, c: F.concat(t, F.lit(":"), c), critique)
    assert sorted(map(tuple, found.answers.collect())) == [(1, "good:[1] hybrid", 0.9, "hybrid", 1, False), (2, "bad:[1] bm25", 0.3, "bm25", 3, True), (3, "second:[1] bm25", 0.7, "bm25", 3, False), (4, "hopeless:[1] hybrid", 0.1, "hybrid", 1, False)]
    assert sorted(map(tuple, found.retries.collect())) == [(2, 1, "a, b", 0.3, "dense"), (2, 2, "a, b", 0.3, "bm25"), (3, 1, "low confidence", 0.3, "dense"), (3, 2, "low confidence", 0.3, "bm25")]
    assert asked == [("hybrid", [1, 2, 3, 4]), ("dense", [2, 3]), ("bm25", [2, 3])]


def test_helpers_of_the_critic(spark):
    rows = spark.createDataFrame([(0.3, 0), (0.3, 2), (0.1, 0), (0.1, 1), (0.4, 2), (0.2, 1)], "confidence double, retries int")
    assert [r[0] for r in rows.select(evaluate.gives_up(F.col("confidence"), F.col("retries"))).collect()] == [False, True, False, True, False, False]


# --- the cache


class Counting:
    """Writes a line for each text it is asked for."""

    dimension = 3

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, texts):
        with open(self.path, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return pd.Series([[float(len(t)), 0.0, 1.0] for t in texts])

    def calls(self):
        try:
            with open(self.path) as f:
                return sorted(f.read().split("\n")[:-1])
        except FileNotFoundError:
            return []


def test_only_misses_are_computed(spark, tmp_path):
    now, calls = [100.0], Counting(tmp_path / "calls")

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return calls(texts)

    cache = ResultCache(spark, str(tmp_path / "cache"), "array<float>", ttl=50, most=4, clock=lambda: now[0])
    assert tuple(cache.stats().first()) == (0, 0, 0, 0, 0.0, 0)

    def ask(*keys):
        rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "n long, k string")
        got = {r["n"]: r["value"] for r in cache.fetch(rows, "k", lambda m: m.select("key", run("key").alias("value"))).collect()}
        assert got == {i: None if k is None else [len(k), 0.0, 1.0] for i, k in enumerate(keys)}

    ask("a", "bb", "a", None)
    assert calls.calls() == ["a", "bb"]
    now[0] = 110.0
    ask("bb", "ccc")
    ask("bb", "ccc", "a")
    assert calls.calls() == ["a", "bb", "ccc"]
    now[0] = 120.0
    ask("ccc", "dddd", "eeeee")  # five values: of a and bb, used at 110, a goes by its key
    assert sorted(r["key"] for r in cache.values.rows().collect()) == ["bb", "ccc", "dddd", "eeeee"]
    now[0] = 155.0  # bb and a of 100 have expired
    ask("bb")
    assert calls.calls() == ["a", "bb", "bb", "ccc", "dddd", "eeeee"]
    assert cache.values.count() == 4 and cache.uses.count() == 4
    assert tuple(cache.stats().first())[:4] == (5, 11, 5, 6)
    cache.clear()
    assert cache.values.count() == 0


def test_cache_stores_no_long_keys(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"), "int")
    long = ["x" * 5000, "é" * 40, "x" * 64, "x" * 65, None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([*long, *long])], "n long, k string")
    for _ in range(2):
        found = cache.fetch(rows, "k", lambda m: m.select("key", F.length("key").alias("value")))
        assert found.columns == ["k", "n", "value"]
        assert sorted((r["n"], r["k"], r["value"]) for r in found.collect()) == [(i, k, k and len(k)) for i, k in enumerate([*long, *long])]
    assert max(len(r["key"]) for r in cache.values.rows().union(cache.uses.rows().withColumn("value", F.lit(0)).select("key", "value", "used")).collect()) == 71
    # a key that looks like a stored one is another key
    same = [r["key"] for r in cache.values.rows().collect() if r["key"].startswith("sha256:")]
    cache.fetch(spark.createDataFrame([(k,) for k in same], "k string"), "k", lambda m: m.select("key", F.lit(1).alias("value")))
    assert tuple(cache.stats().first())[:4] == (3, 11, 4, 7)


def test_engine_embeds_each_text_once(spark, tmp_path):
    calls = Counting(tmp_path / "calls")
    engine = Engine(spark, str(tmp_path / "engine"), embed=calls, cache=True)
    docs = spark.createDataFrame([("x", "some text"), ("y", "other text"), ("z", "some text")], "source_path string, content string")
    engine.ingest(docs)
    assert calls.calls() == ["other text", "some text"]
    engine.ingest(docs)
    query = spark.createDataFrame([(1, "some text")], "query_id long, text string")
    assert engine.search(query, mode="dense").count() > 0
    assert calls.calls() == ["other text", "some text"]
