"""The approximate vector index: recall against exact search, changes, filters, and the files a search reads."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ivf
from lodestone.operators.dense import dense, two_stage

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding", F.when(F.col("label") < 5, "child").otherwise("parent").alias("doc_level"), F.concat(F.lit("l"), F.col("label")).alias("language_code"))
    return rows.cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    made = ivf.VectorIndex(spark, str(tmp_path_factory.mktemp("ivf")))
    assert made.train(vectors, cells=32) == 32 and made.add(vectors) == vectors.count()
    return made


def shown(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def asked(vectors):
    return vectors.select(F.col("doc_id").alias("query_id"), "embedding")


def recall(found, exact):
    a, b = ({(r["query_id"], r["doc_id"]) for r in x.collect()} for x in (found, exact))
    return len(a & b) / len(b)


def test_all_lists_are_exact(spark, vectors, index):
    q = asked(vectors.where("doc_id % 50 = 0"))
    assert shown(index.search(q, probes=32)) == shown(dense(vectors, q))
    for level, language in (("child", None), (None, "l3"), ("child", "l3"), ("parent", "l3")):
        rows = vectors.where(F.lit(True) if level is None else F.col("doc_level") == level).where(F.lit(True) if language is None else F.col("language_code") == language)
        assert shown(index.search(q, probes=32, level=level, language=language)) == shown(dense(rows, q))
    high = index.search(q, probes=32, least=0.3)
    assert high.where("score < 0.3").count() == 0 and high.count() > 0


def test_recall_over_all_queries(vectors, index):
    q = asked(vectors)
    exact = dense(vectors, q).cache()
    probes = index.tune()
    shares = [recall(index.search(q, probes=p), exact) for p in (2, 12, None)]
    assert shares[0] < shares[1] < shares[2] and shares[2] >= 0.95 and 12 < probes < 32, (shares, probes)
    # by stored bits over all lists: the plain two-stage search
    few = asked(vectors.where("doc_id % 20 = 0"))
    assert shown(index.search(few, probes=32, quantised=True)) == shown(two_stage(vectors, few))


def test_files_read_fall_with_probes(spark, vectors, index):
    """The scan's partition filter names the probed cells alone."""
    q = asked(vectors.where("doc_id = 0"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plans = [index.search(q, probes=p)._jdf.queryExecution().executedPlan().toString() for p in (3, 9)]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [re.findall(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([^)]*)\)", p) for p in plans]
    assert [{len(x.split(",")) for x in f} for f in filters] == [{3}, {9}]


@pytest.mark.parametrize("few", [200_000, 0])
def test_changes(spark, vectors, tmp_path, monkeypatch, few):
    monkeypatch.setattr(ivf, "FEW_GONE", few)
    monkeypatch.setattr(ivf, "HOT_ROWS", 20)
    monkeypatch.setattr(ivf, "LIST_ROWS", 7)
    made, q = ivf.VectorIndex(spark, str(tmp_path)), asked(vectors.where("doc_id % 200 = 0"))
    with pytest.raises(ValueError, match="train"):
        made.add(vectors)
    made.train(vectors.where("doc_id < 600"), cells=8)
    assert made.search(q).count() == 0
    some = vectors.where("doc_id < 600").select("doc_id", "embedding")
    made.add(some)
    assert made.remove(spark.createDataFrame([(i,) for i in range(0, 900, 3)], "doc_id long")) == 200
    new = vectors.where("doc_id >= 300 and doc_id < 700").select("doc_id", F.reverse("embedding").alias("embedding"))
    assert made.add(new) == 400
    now = some.where("doc_id % 3 > 0 and doc_id < 300").union(new)
    assert shown(made.search(q, probes=8)) == shown(dense(now, q)) and made.stats()["vectors"] == now.count() == made.vectors().count()
    before = shown(made.search(q, probes=8))
    made.compact()
    assert shown(made.search(q, probes=8)) == before and made.stats() | {"largest": 0} == {"vectors": 600, "cells": 8, "largest": 0, "segments": 1, "removed": 0}


def test_odd_vectors(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), (None, [1.0, 1.0]), ("d", [1.0]), ("e", [None, 1.0]), ("f", [1.0, 0.0]), ("a", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<float>")
    made = ivf.VectorIndex(spark, str(tmp_path), "string")
    made.train(df.where("size(embedding) = 2"), cells=2)
    assert made.add(df) == 3
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert shown(made.search(q, probes=2)) == [(1, 1, "f", 1.0), (1, 2, "a", 0.0), (1, 3, "b", 0.0), (4, 1, "a", 0.0), (4, 2, "b", 0.0), (4, 3, "f", 0.0)]


def test_few_lists_do_where_vectors_cluster(spark, tmp_path):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 16))
    rows = [(i, (middles[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>").cache()
    made = ivf.VectorIndex(spark, str(tmp_path))
    made.train(df, cells=12)
    made.add(df)
    q = asked(df)
    assert made.tune() <= 4 and recall(made.search(q), dense(df, q)) >= 0.95


def test_centroids_are_means(spark):
    from lodestone.operators.clusters import train

    rng = np.random.default_rng(0)
    middles = np.eye(4) * 10
    rows = [(i, (middles[i % 4] + 0.1 * rng.normal(size=4)).tolist()) for i in range(200)]
    found = train(spark.createDataFrame(rows, "id long, v array<double>"), 4, rounds=20)
    near = np.abs(found[:, None] - middles[None]).sum(2).min(1)
    # starting points may share a middle, but each ends as the mean of its rows
    cell = np.array([np.linalg.norm(found - np.array(v), axis=1).argmin() for _, v in rows])
    assert all(np.allclose(found[c], np.mean([v for (_, v), own in zip(rows, cell, strict=True) if own == c], axis=0), atol=1e-6) for c in set(cell)) and len(near) <= 4


from lodestone.operators.sparse import best as D_best  # noqa: E402


def test_scores_held_at_once(monkeypatch):
    """As many whatever the number of queries, in the exact search."""
    from lodestone.operators import dense as D

    sizes = []
    monkeypatch.setattr(D, "best", lambda score, k: (sizes.append(score.size), D_best(score, k))[1])
    rng = np.random.default_rng(2)
    vectors, asked = rng.standard_normal((3000, 8)), rng.standard_normal((2048, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(vectors.tolist())], names=["doc_id", "embedding"])
    found = pa.Table.from_batches(list(D._search(list(range(2048)), asked, 5, False, (pa.int64(), pa.int64()))(iter([batch])))).to_pandas()
    assert max(sizes) <= D.TILE
    found = found.sort_values(["query_id", "score"], ascending=[True, False]).groupby("query_id").head(5)
    exact = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T
    assert found["doc_id"].to_numpy().reshape(-1, 5).tolist() == np.argsort(-exact, axis=0, kind="stable")[:5].T.tolist()


def test_recall_asks_every_fiftieth(spark):
    from lodestone.plans import catalogue

    rows = catalogue.queries()["vector_index_recall"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["query_id"] for r in rows) == list(range(0, 500, 50)) and sum(r["found"] for r in rows) >= 0.9 * sum(r["wanted"] for r in rows)
