"""Models as injected providers, with defaults that need none.

A provider takes and returns pandas Series, so that operators run it over Arrow batches; what a
model computes is not part of this library, the contracts around it are."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Any, Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.cache import ResultCache
from lodestone.operators.sparse import top_k
from lodestone.sources.store import text_key

WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    dimension: int

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Scorer(Protocol):
    def __call__(self, queries: pd.Series, texts: pd.Series) -> pd.Series: ...


class Generator(Protocol):
    def __call__(self, prompts: pd.Series) -> pd.Series: ...


class HashedWords:
    """An embedding without a model: words hashed to signed places, of length 1."""

    def __init__(self, dimension: int = 384) -> None:
        self.dimension = dimension

    def one(self, text: str | None) -> list[float] | None:
        if text is None:
            return None
        v = np.zeros(self.dimension)
        for w in WORD.findall(text.lower()):
            h = crc32(w.encode())
            v[h % self.dimension] += 1.0 if h >> 31 else -1.0
        size = np.linalg.norm(v)
        return (v / size if size else v).astype(np.float32).tolist()

    def __call__(self, texts: pd.Series) -> pd.Series:
        return texts.map(self.one)


class SharedWords:
    """A reranker without a model: the share of the query's words that a text has."""

    def __call__(self, queries: pd.Series, texts: pd.Series) -> pd.Series:
        def score(q: str, t: str) -> float:
            asked = set(WORD.findall((q or "").lower()))
            return len(asked & set(WORD.findall((t or "").lower()))) / len(asked) if asked else 0.0

        return pd.Series([score(q, t) for q, t in zip(queries, texts, strict=True)], dtype=float)


class RatedByReply:
    """A reranker that asks a generator for a rating of 0 to 100; 0 where it names none."""

    def __init__(self, generate: Generator, most: int = 500) -> None:
        self.generate, self.most = generate, most

    def __call__(self, queries: pd.Series, texts: pd.Series) -> pd.Series:
        prompts = pd.Series([f"Rate from 0 to 100 how well the text answers the query.\nQuery: {q}\nText: {(t or '')[: self.most]}" for q, t in zip(queries, texts, strict=True)])
        return self.generate(prompts).map(lambda r: min(100, int(m.group())) / 100 if (m := re.search(r"\d+", r or "")) else 0.0).astype(float)


class FirstSentences:
    """A generator without a model: the first sentences of what follows the prompt's last blank line."""

    def __init__(self, n: int = 3) -> None:
        self.n = n

    def __call__(self, prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else " ".join(re.split(r"(?<=[.!?])\s+", p.rsplit("\n\n", 1)[-1].strip())[: self.n]))


class Retrying:
    """A provider that is called again after a failure, each time later; not where ``final`` says
    that a further call is of no use."""

    def __init__(self, call: Callable[..., Any], tries: int = 3, wait: float = 1.0, final: Callable[[Exception], bool] = lambda e: False) -> None:
        self.call, self.tries, self.wait, self.final = call, tries, wait, final

    def __call__(self, *args: Any) -> Any:
        for k in range(1, self.tries + 1):
            try:
                return self.call(*args)
            except Exception as e:
                if k == self.tries or self.final(e):
                    raise
                time.sleep(self.wait * k)
        raise ValueError("at least one try is needed")


# Frequent words that tell a language.
FREQUENT = {
    "en": "the of and to in is that it was for on are with as be this have from or by not but at",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}


def languages(df: DataFrame, text_col: str = "text", least: int = 3, most: int = 5000, fallback: str = "en", sure: float = 0.7) -> DataFrame:
    """df with language_code, language_name, language_confidence and method, by frequent words.

    Texts under ``least`` characters have the fallback with confidence 0; a share under ``sure``
    of all frequent words found is marked as unsure."""
    words = T.pieces(F.regexp_replace(F.lower(F.substring(text_col, 1, most)), r"[^\p{L}\s]+", " "))
    rows = df.withColumn("_w", words)

    def count(known: str) -> F.Column:
        return F.size(F.filter("_w", lambda w: w.isin(known.split()))).cast("double")

    counts = [count(known).alias(code) for code, known in FREQUENT.items()]
    total = sum((F.col(f"_n.{code}") for code in FREQUENT), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(F.col(f"_n.{code}").alias("n"), F.lit(-k).alias("place"), F.lit(code).alias("code")) for k, code in enumerate(FREQUENT)]))
    rows = rows.withColumn("_n", F.struct(*counts)).withColumn("_b", best).withColumn("_t", total)
    found = (F.length(F.trim(F.coalesce(text_col, F.lit("")))) >= least) & (F.col("_t") > 0)
    code = F.when(found, F.col("_b.code")).otherwise(fallback)
    share = F.when(found, F.col("_b.n") / F.col("_t")).otherwise(0.0)
    method = F.when(~found, "fallback").when(share >= sure, "words").otherwise("words_unsure")
    out = rows.withColumns({"language_code": code, "language_name": T.language_name(code), "language_confidence": share, "language_method": method})
    return out.drop("_w", "_n", "_b", "_t")


def needs_translation(language: F.Column, target: str) -> F.Column:
    return F.lower(language) != target.lower()


def translated(df: DataFrame, translate: Generator, target: str = "en", text_col: str = "text", language_col: str = "language_code", longest: int = 50_000) -> DataFrame:
    """df with texts of other languages translated, what they were in ``original`` and
    ``was_translated``; empty texts, texts of the target language and very long ones stay."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return translate(texts)

    text = F.col(text_col)
    wanted = F.coalesce(needs_translation(F.col(language_col), target) & (F.trim(text) != "") & (F.length(text) <= longest), F.lit(False))
    # the provider sees the rows that need it, and no others
    done = df.where(wanted).withColumn("original", text).withColumn(text_col, run(text)).withColumn("was_translated", F.lit(True))
    return df.where(~wanted).withColumn("original", F.lit(None).cast("string")).withColumn("was_translated", F.lit(False)).unionByName(done.select(*df.columns, "original", "was_translated"))


def embedded(df: DataFrame, embed: Embedder, text_col: str = "content", out: str = "embedding", cache: ResultCache | None = None) -> DataFrame:
    """df with vectors; each distinct text is embedded once, and with a ``cache`` only if it isn't stored there."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return embed(texts)

    if cache is not None:
        keyed = df.withColumn("_k", text_key("embed", F.col(text_col), dimension=embed.dimension))
        made = cache.fetch(keyed.select("_k", F.col(text_col).alias("_t")), "_k", lambda missing: missing.select("key", run("_t").alias("value")))
        return keyed.join(made.select("_k", F.col("value").alias(out)).dropDuplicates(["_k"]), "_k", "left").drop("_k")
    known = df.select(F.col(text_col).alias("_t")).where("_t is not null").distinct().withColumn(out, run("_t"))
    return df.join(known, df[text_col] == known["_t"], "left").drop("_t")


def reranked(queries: DataFrame, results: DataFrame, score: Scorer, k: int = 8, most: int = 3000) -> DataFrame:
    """results (query_id, doc_id, rank, content) scored anew: of a query's first max(4 k, 16) the k
    best by ``score`` of the query's text and the first ``most`` characters."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return score(q, t)

    rows = results.where(F.col("rank") <= max(4 * k, 16)).join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    rows = rows.withColumn("score", run("_q", F.substring("content", 1, most))).drop("_q", "rank")
    return top_k(rows, k)


def prompts(queries: DataFrame, results: DataFrame, each: int = 1500, most: int = 8) -> DataFrame:
    """(query_id, prompt): the query and its results as ``[DOC i]`` parts."""
    part = F.concat(F.lit("[DOC "), F.col("rank").cast("string"), F.lit("] "), F.substring("content", 1, each))
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("p"))))
    context = results.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n").alias("context"))
    return queries.join(context, "query_id", "left").select("query_id", F.concat(F.lit("Question: "), F.col("text"), F.lit("\n\n"), F.coalesce("context", F.lit(""))).alias("prompt"))


def generated(rows: DataFrame, generate: Generator, prompt_col: str = "prompt", out: str = "answer") -> DataFrame:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return generate(texts)

    return rows.withColumn(out, run(F.col(prompt_col)))


class Registry:
    """Named operators, tools and providers, with categories and tags."""

    def __init__(self) -> None:
        self.entries: dict[str, tuple[Callable[..., Any], str, frozenset[str]]] = {}

    def register(self, name: str, category: str = "general", tags: tuple[str, ...] = ()) -> Callable:
        def add(f: Callable[..., Any]) -> Callable[..., Any]:
            if name in self.entries:
                raise KeyError(f"{name} is registered")
            self.entries[name] = (f, category, frozenset(tags))
            return f

        return add

    def unregister(self, name: str) -> bool:
        return self.entries.pop(name, None) is not None

    def get(self, name: str) -> Callable[..., Any]:
        return self.entries[name][0]

    def names(self, category: str | None = None, tag: str | None = None) -> list[str]:
        return sorted(n for n, (_, c, t) in self.entries.items() if category in (None, c) and tag in (None, *t))

    def by_category(self) -> dict[str, list[str]]:
        return {c: self.names(c) for c in sorted({c for _, c, _ in self.entries.values()})}

    def invoke(self, name: str, *args: Any, **options: Any) -> Any:
        return self.get(name)(*args, **options)
