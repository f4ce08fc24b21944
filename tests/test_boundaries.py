"""Repaired chunk boundaries: random proposals against a loop, and odd ones by hand."""

import random
import re

from lodestone.operators.boundaries import repaired


def loop(text, proposals, least, most, slack):
    n, spans, taken = len(text), [], 0
    clamped = [(max(a, 0), min(b, n), k) for a, b, k in proposals if a is not None and b is not None]
    for a, b, k in sorted((p for p in clamped if p[1] - p[0] >= least // 2), key=lambda p: (p[0], -p[1], p[2])):
        a, taken = max(a, taken), max(taken, b)
        if b - a >= least // 2:
            spans.append([a, b, k])
    if not spans:
        spans = [[0, n, "whole"]]
    filled, at = [], 0
    for i, (a, b, k) in enumerate(spans):
        if a > at:
            if a - at <= slack and not i:
                a = 0
            elif a - at <= slack:
                filled[-1][1] = a
            else:
                filled.append([at, a, "gap_fill"])
        filled.append([a, b, k])
        at = b
    if n - at > slack:
        filled.append([at, n, "gap_fill"])
    else:
        filled[-1][1] = n
    out = []
    for a, b, k in filled:
        while b - a > most:
            blank = max((m.end() for m in re.finditer(r"[ \t\r\n]", text[a : a + most])), default=most)
            out.append((a, a + blank, k))
            a += blank
        out.append((a, b, k))
    return out


def test_random_proposals_cover_each_text_once(spark):
    rng = random.Random(7)
    docs, proposals = [], []
    for i in range(300):
        n = rng.choice([1, 5, 30, 200, 900])
        docs.append((i, "".join(rng.choice("abcdé𝔘 \n") if rng.random() < 0.9 else "x" * 30 for _ in range(n))))
        for _ in range(rng.choice([0, 1, 2, 5, 12])):
            a = rng.randint(-20, n + 10)
            proposals.append((i, a, a + rng.randint(-5, 150), rng.choice("pq")))
    given = spark.createDataFrame(proposals, "doc_id long, start long, stop long, chunk_type string")
    found = {}
    for r in repaired(given, spark.createDataFrame(docs, "doc_id long, text string"), least=20, most=60, slack=8).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for i, text in docs:
        rows = sorted(found[i], key=lambda r: r["place"])
        assert [r["place"] for r in rows] == list(range(len(rows)))
        assert "".join(r["content"] for r in rows) == text
        assert all(text[r["start"] : r["stop"]] == r["content"] and len(r["content"]) <= 60 for r in rows)
        mine = [(r["start"], r["stop"], r["chunk_type"]) for r in rows]
        assert mine == loop(text, [p[1:] for p in proposals if p[0] == i], 20, 60, 8), i


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "word " * 10), (None, "no id")], "doc_id long, text string")
    given = spark.createDataFrame([(1, 0, 9, "a"), (2, 0, 9, "a"), (4, None, 9, "a"), (4, 10, 30, None), (9, 0, 5, "a")], "doc_id long, start int, stop int, chunk_type string")
    found = sorted(((r["doc_id"] or 0, r["start"], r["stop"], r["chunk_type"]) for r in repaired(given, docs, least=10, most=100, slack=5).collect()), key=str)
    assert found == [(0, 0, 5, "whole"), (3, 0, 3, "whole"), (4, 0, 10, "gap_fill"), (4, 10, 30, None), (4, 30, 50, "gap_fill")]
    none = spark.createDataFrame([], docs.schema)
    assert repaired(given, none).count() == 0
    assert repaired(given.limit(0), docs).count() == 3
