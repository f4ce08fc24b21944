"""The exact join of word sets against a loop, with lists, parts and buckets small enough that all ways are taken."""

import random

import pytest

from lodestone.operators import setjoin


def rows(seed=3):
    rng = random.Random(seed)
    base = [rng.sample(range(90), 40) for _ in range(3)]
    texts = []
    for words in base:
        # near copies, as many as a list of FEW doesn't hold
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(range(90, 200))
            texts.append(" ".join(f"w{w}" for w in own))
    texts += [" ".join(f"w{w}" for w in rng.sample(range(200), rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), " ".join(reversed(texts[1].split())), texts[80], "a b c d e f g", "a b c d e f g h", "", " \n", None]
    return list(enumerate(texts))


@pytest.mark.parametrize("least", [0.85, 0.6])
def test_classes_and_pairs_equal_a_loop(spark, monkeypatch, least):
    monkeypatch.setattr(setjoin, "FEW", 6)
    monkeypatch.setattr(setjoin, "TASK", 4096)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    sets = {i: frozenset((t or "").lower().split()) for i, t in data}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > least} for i in sets}
    top = {}
    for i in sorted(sets):
        todo = [i] if i not in top else []
        while todo:
            x = todo.pop()
            if x not in top:
                top[x] = i
                todo += linked[x]
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in setjoin.similar_classes(df, least).collect()}
    assert found == {i: (top[i], len(linked[i])) for i in sets}
    assert max(n for _, n in found.values()) > 6
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    pairs = {(r["a"], r["b"]) for r in setjoin.similar_pairs(df, least).collect()}
    assert pairs == {(a, b) for a in sets for b in linked[a] if a < b and first[a] == a and first[b] in (a, b)}


def test_documents_without_id_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "a b"), (2, "b a"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, setjoin.similar_classes(df, 0.85).collect()), key=str) == [(1, 1, 1), (2, 1, 1), (None, None, 0), (None, None, 0)]
    assert setjoin.similar_classes(df.where("doc_id > 5"), 0.85).count() == setjoin.similar_pairs(df.where("doc_id > 5"), 0.85).count() == 0


def test_long_texts_of_several_parts_meet_and_strangers_do_not(spark):
    rng = random.Random(11)
    texts = []
    for n in (90, 199, 201, 390, 410, 1700):
        base = [f"w{w}" for w in rng.sample(range(20_000), n)]
        texts += [" ".join(base)]
        for _ in range(5):
            # differences spread or at one end, sizes on both sides of a power of two of parts
            left = rng.randint(0, n // 14)
            texts.append(" ".join(base[left:] + [f"v{rng.randrange(10**9)}" for _ in range(rng.randint(0, n // 14))]))
    # strangers that share a rare word with every other
    strangers = [" ".join(["rare", *(f"u{w}" for w in rng.sample(range(9_000), 300))]) for _ in range(60)]
    data = list(enumerate(texts + strangers))
    sets = {i: frozenset(t.split()) for i, t in data}
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.85}
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in setjoin.similar_pairs(df, 0.85).collect()} == pairs and len(pairs) > 40
    rows = df.selectExpr("doc_id as id", "text")
    made = setjoin.map_arrow(rows.select("id", setjoin._hashes(rows["text"]).alias("h")), setjoin._signed(0.85, *setjoin._order(rows)), "id long, n long, key binary, entries long, parts array<struct<x: long, y: long, words: array<long>>>")
    met = {x for r in setjoin._edges(made, 0.85).collect() for x in (r["a"], r["b"])}
    known = {r["node"]: r["id"] for r in made.selectExpr("xxhash64(key) as node", "id").collect()}
    assert max(known[x] for x in met) < len(texts)
