"""Operators 11 to 13: brute force, round trips and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import hard_negatives, lexical, packed_ids, queries

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
CLASH = ["id", "ID", "v", "row", "term", "df", "key", "label_", "item", "shard", "h"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeéxyz", k=rng.randint(2, 6))) + rng.choice(["", "", ".", ",", "'s", "!?"]) for _ in range(n))


TEXTS = [
    (5, prose(1, 300)), (1, None), (None, prose(2, 20)), (2, ""), (3, "A<|ENDOFTEXT|>b <|endoftext|>C"), (3, prose(3, 40)), (3, prose(3, 40)),
    (4, "İstanbul \x0b\x85 don't 99.5 é漢字  x"), (9, prose(4, 60_000)), (8, "   "), (7, "q" * 30_000), (6, prose(1, 300)), (6, "É" + "́" * 3),
]


def table(spark, rows, kind="doc_id long, text string"):
    names = [c.split()[0] for c in kind.split(", ")]
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], kind + ", " + ", ".join(f"`_{c}` string" for c in CLASH)).toDF(*names, *CLASH)


# --- 11


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, size=1000, dtype=np.uint64)
    data = packed_ids.pack_bits(ids, bits)
    assert len(data) == 16 * bits * 8 and (packed_ids.unpack_bits(data, bits)[:1000] == ids).all()
    # the i-th id lies at bit i * bits
    whole = int.from_bytes(data, "little")
    assert all(whole >> i * bits & (1 << bits) - 1 == ids[i] for i in range(0, 1000, 77))


def plain(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_packed_ids(spark, tmp_path, path):
    folder = f"file://{tmp_path}/ids"
    df = table(spark, TEXTS)
    packed_ids.write_ids(df, path, folder, end_id=1, shard_ids=3000, block_ids=128)
    tokenizer = Tokenizer.from_file(path)
    found = packed_ids.documents(spark, folder).orderBy("part", "place", "row").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    own = sorted((str(i), tuple(plain(tokenizer, t, 1))) for i, t in TEXTS)
    whole = packed_ids.token_ids(spark, folder)
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in whole.collect()) == own
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((i, len(x), crc(x)) for i, x in own)
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found]]).tolist()[:-1]
    assert len({(r["part"], r["place"]) for r in found}) > 2


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    ids, sizes = rng.integers(0, 49408, 5000), [1000, 1, 0, 3999]
    (tmp_path / "x").write_bytes(packed_ids.shard_bytes(ids, sizes, ["a", None, "", "é"], 16, 3, 4, 640) + b"\n")
    s = packed_ids.Shard(np.memmap(tmp_path / "x", np.uint8, "r"))
    assert (s.part, s.place, s.n_ids, s.names()) == (3, 4, 5000, ["a", None, "", "é"])
    assert (s.ids() == ids).all() and (s.document(1) == ids[1000:1001]).all() and len(s.document(2)) == 0
    for lo, hi in ((0, 1), (639, 641), (640, 640), (1300, 4999), (4999, 9999)):
        assert (s.ids(lo, hi) == ids[lo:hi]).all()


def test_pieces_and_forgetting(monkeypatch):
    """Texts cut into pieces, and words forgotten in between, give the same ids."""
    monkeypatch.setattr(packed_ids, "PIECE", 200)
    monkeypatch.setattr(packed_ids, "MEMO", 50)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    with open(WORD_BPE) as f:
        spec = f.read()
    texts = [(t or "") for _, t in TEXTS[:8]] + [prose(9, 2000)]
    assert [x.tolist() for x in packed_ids.encoded([t.encode() for t in texts], spec, True)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packed_ids_of_nothing(spark, tmp_path):
    packed_ids.write_ids(table(spark, []), WORD_BPE, f"file://{tmp_path}/none", end_id=1)
    assert packed_ids.documents(spark, f"file://{tmp_path}/none").count() == 0


def test_packed_ids_query(spark):
    """The registered query against the library, over the whole smallest table."""
    tokenizer, start = Tokenizer.from_file(WORD_BPE), 0
    found = queries.QUERIES["op11_packed_ids"](spark, SF).orderBy("doc_id").collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert len(found) == len(rows)
    for a, b in zip(found, rows, strict=True):
        ids = plain(tokenizer, b["text"], 1)
        assert tuple(a) == (b["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# --- 12


def negatives_of(rows):
    """By loops: (anchor, positive, rank, negative, positive's score, negative's score)."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in whole:
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other == label) for j, other, w in whole if j != i]
        for p, j, _ in sorted(x for x in score if x[2])[:5]:
            fits = sorted(x for x in score if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed, n, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 5))
    return [(i, [float(np.float32(x)) for x in scale * (middle[i % 6] + 0.7 * rng.normal(size=5))], int(rng.integers(0, 3))) for i in range(n)]


ODD = [(None, [1.0] * 5, 1), (700, None, 1), (800, [1.0, None, 1.0, 1.0, 1.0], 0), (900, [float("nan")] * 5, 0), (901, [float("inf")] * 5, 0), (902, [1.0] * 5, None), (903, [1.0, 2.0], 1), (904, [], 0), (905, [0.0] * 5, 2), (1000, [1.0] * 5, 9)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e-3])
def test_hard_negatives(spark, scale):
    rows = vectors(3, 500, scale) + [(i + 5000, v, label) for i, v, label in vectors(3, 30, scale)] + ODD
    df = table(spark, rows, "vec_id long, embedding array<float>, label int").repartition(4)
    found = hard_negatives.hard_negatives(df, hard_negatives.F.col("vec_id") % 100 == 0, clusters=7, block_rows=16)
    assert sorted(map(tuple, found.collect())) == negatives_of(rows)
    assert hard_negatives.hard_negatives(df.where("false"), hard_negatives.F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_doubles(spark):
    rows = vectors(5, 150, 3e5)
    df = spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, hard_negatives.F.col("vec_id") % 100 == 0).collect())) == negatives_of(rows)


def test_bounds_skip_blocks(spark):
    """Far clusters aren't visited: fewer pairs of anchor and block than there are."""
    rng = np.random.default_rng(2)
    rows = [(i, (10 * np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)).tolist(), i % 3) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = hard_negatives.whole_numbers(df, "vec_id", "embedding", "label", 256)
    lists = hard_negatives.InvertedLists(whole, 8, 10_000, 50)
    chosen = hard_negatives._choose(lists.meta, lists.centroids, lists.kind, 20, True)
    asking = lists.even(whole.where("id = 0")).selectExpr("cast(0 as long) as key", "id", "label", "v", "array(cast(1000 as long)) as low", "array(9000000L) as high", "array(6000000L) as bound")
    visited = asking.mapInArrow(chosen, "block long, head binary, edges binary, q binary").count()
    assert 0 < visited <= len(lists.meta["block"]) // 4


# --- 13


def plain_terms(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def ranked(docs, items, k=10):
    """By loops over documents."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, prose(1, 30)), (1, prose(3, 30)), (2, "zz zzz nothing"), (3, None), (None, prose(1, 9)), (4, "a A a b c d é x y z"), (5, prose(4, 80)), (6, "!!!")]


@pytest.mark.parametrize(("few", "blocks"), [(1 << 17, 512), (0, 2)])
def test_lexical_search(spark, monkeypatch, few, blocks):
    monkeypatch.setattr(lexical, "PIECE", 500)
    docs = TEXTS + [(i, prose(i % 40, 30)) for i in range(100, 400)]
    df = table(spark, docs).repartition(3)
    found = lexical.search(lexical.index(df), table(spark, ITEMS, "item_id long, text string"), block_queries=blocks, few_terms=few)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(docs, ITEMS)


def test_shards(spark, monkeypatch):
    """Many shards give what one gives, and ids of another type are kept."""
    docs = [(f"d{i:03}", prose(i % 30, 50)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id string, text string").coalesce(1)
    make = lexical._index
    monkeypatch.setattr(lexical, "SHARD_BYTES", 3000)
    batches = list(make(lexical.pa.string())(iter(df.select("doc_id", "text").toArrow().to_batches())))
    assert len(batches) > 5
    one = lexical.search(lexical.index(df), table(spark, ITEMS, "item_id long, text string"))
    assert sorted(map(tuple, one.collect()), key=str) == [(a, b, f"d{c:03}", d) for a, b, c, d in ranked([(int(i[1:]), t) for i, t in docs], ITEMS)]


def test_lexical_search_of_nothing(spark):
    docs, items = table(spark, TEXTS), table(spark, ITEMS, "item_id long, text string")
    made = lexical.index(docs)
    assert lexical.search(made, items.where("false")).count() == 0
    assert lexical.search(lexical.index(docs.where("false")), items).count() == 0
    assert lexical.search(lexical.index(docs.where("doc_id = 2")), items).count() == 0


def test_numbers_as_bytes():
    values = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 40) + 5, 0, 16383, 16384])
    data, size = lexical.to_bytes(values)
    assert (lexical.from_bytes(data) == values).all() and size.tolist() == [1, 1, 1, 2, 2, 3, 6, 1, 2, 3]


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_lexical_search"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    asked = con.execute(queries.ORACLE_SQL[name]).df()[found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(asked.itertuples(index=False, name=None))
