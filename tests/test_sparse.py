"""BM25 in blocks of queries and batches of documents against a loop; what moves between tasks."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import sparse as S
from lodestone.operators.index import SparseIndex


def looped(docs, queries, k):
    cut = {i: [w for w in (t or "").split() if len(w) > 1] for i, t in docs}
    cut = {i: Counter(w) for i, w in cut.items() if w}
    size = {i: sum(c.values()) for i, c in cut.items()}
    df = Counter(w for c in cut.values() for w in c)
    mean = sum(size.values()) / len(size)
    out = set()
    for q, text in queries:
        asked = Counter(w for w in (text or "").split() if len(w) > 1)
        scores = []
        for i, c in cut.items():
            x = sum(math.log((len(cut) - df[w] + 0.5) / (df[w] + 0.5) + 1) * n * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size[i] / mean)) for w, n in asked.items() if w in c)
            if x > 0:
                scores.append((-round(x, 9), i))
        out |= {(q, i, -x, r + 1) for r, (x, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    words = [a + b for a in "abcdef" for b in "xyz"]
    text = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    docs = [(i, text(30)) for i in range(300)] + [(900, None), (901, "- !"), (902, "unasked")]
    docs += [(1000 + i, docs[i][1]) for i in range(0, 300, 3)]
    return docs, [(i, text(8)) for i in range(40)] + [(98, None), (99, "absent")]


@pytest.mark.parametrize("asked, cells, tile", [(10_000, 1 << 22, 1 << 20), (10, 60, 100)])
def test_equals_a_loop(spark, tmp_path, monkeypatch, made, asked, cells, tile):
    for name, value in (("ASKED", asked), ("CELLS", cells), ("TILE", tile)):
        monkeypatch.setattr(S, name, value)
    docs, queries = (spark.createDataFrame(x, f"{c} long, text string").repartition(3) for x, c in zip(made, ("doc_id", "query_id"), strict=True))
    wanted = looped(*made, 5)
    plain = lambda rows: {(r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in rows.collect()}
    near = lambda rows: {(q, i, round(x, 6), r) for q, i, x, r in rows}
    assert near(plain(S.bm25(docs, queries, 5))) == near(wanted)
    index = SparseIndex(spark, str(tmp_path))
    index.add(docs)
    assert near(plain(index.search(queries, 5))) == near(wanted)
    index.remove(docs.where("doc_id % 10 = 0"))
    assert near(plain(index.search(queries, 5))) == near(looped([x for x in made[0] if x[0] % 10], made[1], 5))


def test_few_rows_are_shuffled(spark, made):
    """Neither postings nor scores: the one exchange is of the batches' best."""
    docs, queries = (spark.createDataFrame(x, f"{c} long, text string") for x, c in zip(made, ("doc_id", "query_id"), strict=True))
    plan = S.bm25(docs, queries, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow") and "Join" not in plan


def test_best_with_ties():
    rng = np.random.default_rng(1)
    score = rng.integers(0, 4, (20, 50)) + rng.random((20, 50)) * 1e-12
    row, column = S.best(score, 7)
    assert [c for r, c in zip(row, column, strict=True) if r == 4] == list(np.argsort(-np.round(score[4], 9), kind="stable")[:7])
    assert len(S.best(score[:, :3], 7)[0]) == 60 and len(S.best(score[:0], 7)[0]) == 0


def test_sync_counts_documents_without_terms(spark, tmp_path, made):
    """As the query's SQL does; they change no weights, and can be removed."""
    docs, queries = (spark.createDataFrame(x, f"{c} long, text string") for x, c in zip(made, ("doc_id", "query_id"), strict=True))
    index, plain = SparseIndex(spark, str(tmp_path / "a"), termless=True), SparseIndex(spark, str(tmp_path / "b"))
    index.add(docs.where("doc_id % 10 <> 0"))
    plain.add(docs)
    assert index.sync(docs) == (docs.where("doc_id % 10 = 0").count(), 0) and index.sync(docs) == (0, 0)
    assert index.stats()["documents"] == docs.count() and index.documents().count() == docs.count()
    assert index.stats()["avgdl"] == plain.stats()["avgdl"]
    assert index.search(queries).orderBy("query_id", "rank").collect() == plain.search(queries).orderBy("query_id", "rank").collect()
    index.compact()
    assert index.stats()["documents"] == docs.count()
    assert index.remove(docs.where("doc_id >= 900")) == docs.where("doc_id >= 900").count() and index.documents().count() == 300
