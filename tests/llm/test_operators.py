"""The ten operators on small fixtures: brute force, round trips and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import public_tokenizers
import pytest

from lodestone.llm import compact_windows, decontaminate, language_id, near_dedup, pieces, pivot_search, pseudonyms, substrings, token_counts, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
random.seed(7)
VOCABULARY = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def edited(text, every):
    return " ".join("zzz" if i % every == 3 else w for i, w in enumerate(text.split(" ")))


BASE = [prose(120) for _ in range(12)]
PASSAGE = prose(60)
TEXTS = [
    *BASE,
    *[BASE[0]] * 5,  # repeated rows
    *[edited(BASE[1], n) for n in (100, 90, 80, 17)],
    prose(40) + " " + PASSAGE + " " + prose(40),
    PASSAGE + " " + prose(30),
    prose(3000) + " " + PASSAGE,  # long
    "one two",
    "",
    "   ",
    None,
    "héllo wörld 日本語 \U0001f600 I'll  don't\n\n<|endoftext|> x",
    "=" * 200,
    "=" * 120,
]
ROWS = list(enumerate(TEXTS))


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, key string, ID int").repartition(3).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    found = by_id(token_counts.token_counts(docs, BPE, limit=100))
    for i, x in ROWS:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((x or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty(spark), BPE).count() == 0


def test_near_duplicates(spark, docs):
    found = by_id(near_dedup.near_duplicates(docs, shingle=4))
    sets = {i: shingles(t, 4) for i, t in ROWS}
    root = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for i in sets:
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (len(sets[i]), root[i], root[i] == i)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_repeated_strings(spark, docs):
    found = by_id(substrings.repeated_strings(docs))
    seen = {}
    for i, t in ROWS:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, t in ROWS:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(y and not x for x, y in pairwise([False, *gone]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert substrings.repeated_strings(empty(spark)).count() == 0


def test_near_passages(spark, docs):
    found = by_id(compact_windows.near_passages(docs))
    own = defaultdict(set)
    for i, t in ROWS:
        w = (t or "").split()
        for k in range(len(w) - 49):
            own[tuple(w[k : k + 50])].add(i)
    repeated = {i for s in own.values() if len(s) > 1 for i in s}
    assert repeated <= {i for i, r in found.items() if r["n_spans"]}
    assert not any(found[i]["n_spans"] for i in range(2, 12))
    assert len({found[i]["class_id"] for i, t in ROWS if t and PASSAGE in t}) == 1
    assert compact_windows.near_passages(empty(spark)).count() == 0


def test_near_passages_of_edited_copies(spark):
    """An original of middle id among copies with one word changed, and a smaller id with broken-up parts."""
    words = [f"w{i}" for i in range(55)]
    copies = [[*words[:k], f"x{k}", *words[k + 1 :]] for k in range(2, 53, 3)]
    broken = [v for k in range(0, 55, 18) for v in [*words[k : k + 18], *[f"y{k + i}" for i in range(30)]]]
    texts = [broken, *copies[:9], words, *copies[9:], words]
    found = by_id(compact_windows.near_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")))

    def runs(x, y):
        x, y = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (x, y))
        return {k for k in range(len(x) - 45) if len({*x[k : k + 46]} & {*y}) >= 41}

    for i, x in enumerate(texts):
        cover = {k + j for y in texts[:i] + texts[i + 1 :] for k in runs(x, y) for j in range(50)}
        assert {j for a, b in zip(found[i]["spans"][::2], found[i]["spans"][1::2], strict=True) for j in range(a, b)} == cover
    assert {found[i]["class_id"] for i in range(1, len(texts))} == {1}


def test_decontamination(spark, docs):
    tests = spark.createDataFrame([(1, " ".join(BASE[2].split()[30:55])), (2, "one two"), (3, None), (4, "")], "item_id long, text string")
    found = by_id(decontaminate.digest(decontaminate.contamination(docs, tests)))
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    windows = defaultdict(set)
    for r in tests.collect():
        w = words(r["text"])
        for k in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    for i, t in ROWS:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= x
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
    assert decontaminate.contamination(docs, tests.where("false")).where("size(items) > 0").count() == 0
    small = by_id(decontaminate.digest(decontaminate.contamination(docs, tests, block_words=1)))
    assert all(small[i][c] == found[i][c] for i in found for c in ("n_hit", "items_sha256"))


def test_decontamination_counts_a_repeated_item_once(spark, docs):
    words = BASE[2].split()
    tests = spark.createDataFrame([(1, " ".join(words[30:55])), (1, " ".join(words[60:80])), (2, " ".join(words[30:45]))], "item_id long, text string").coalesce(1)
    for block_words in (1, 2_000_000):
        r = by_id(decontaminate.digest(decontaminate.contamination(docs, tests, block_words=block_words)))[2]
        assert (r["n_items"], r["items_sha256"]) == (2, hashlib.sha256(b"1,2").hexdigest())


def test_pieces(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100, "x" * 300), (101, "  a  b\n\nc "), (102, "▁a▁▁b" + " " * 60), (103, "<s> \t\0")], "doc_id long, text string"))
    ids = pieces.encode(more, MODEL)
    texts = {r["doc_id"]: r["text"] for r in more.collect()}
    for i, r in by_id(ids).items():
        assert list(r["ids"]) == sp.encode(texts[i] or "")
    for i, r in by_id(pieces.decode(ids, MODEL)).items():
        assert r["text"] == sp.decode(sp.encode(texts[i] or ""))
    assert pieces.encode(empty(spark), MODEL).count() == 0


def test_pseudonyms(spark):
    text = "4111 1111 1111 1111, 4111111111111111 4111111111111112 a.b@x.example.com +1 (212) 555-0199 97.51.17.173 300.1.1.1 1999-02-28 29.02.2000 2001-02-29 123-45-6789 000-12-3456 DE89370400440532013000"
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "plain 12")], "doc_id long, text string")
    made = by_id(pseudonyms.personal_data(df, "key"))
    assert made[1]["text"] == made[2]["text"] != text
    assert (made[3]["text"], made[4]["text"], made[5]["text"]) == (None, "", "plain 12")
    assert [made[1][f"n_{k}"] for k in pseudonyms.KINDS] == [2, 1, 1, 1, 2, 1, 1]
    for kept in ("4111111111111112", "300.1.1.1", "2001-02-29", "000-12-3456"):
        assert kept in made[1]["text"]
    a, b = re.search(r"^(\d{4} \d{4} \d{4} \d{4}), (\d{16})", made[1]["text"]).groups()
    assert a.replace(" ", "") == b
    back = by_id(pseudonyms.reveal(pseudonyms.pseudonymise(df, "key"), "key"))
    assert re.sub(r"\S+@", "", back[1]["text"]) == re.sub(r"\S+@", "", text)
    other = by_id(pseudonyms.personal_data(df, "another"))
    assert other[1]["text"] != made[1]["text"]
    days = spark.sql("select id as doc_id, cast(date_add(date'2000-01-01', cast(id as int)) as string) as text from range(1500)")
    assert pseudonyms.pseudonymise(days, "key").select("text").distinct().count() == 1500


def test_language(spark):
    own = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(random.choices(own[x], k=5)) for _ in range(30)), x) for i in range(200) for x in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "12 34 !", "bb"), (None, "abcde", None)], "doc_id long, text string, lang string")
    found = by_id(language_id.language_id(df, language_id.learn(df)))
    assert all(found[i]["lang_pred"] == x for i, _, x in rows)
    assert all(found[i]["lang_pred"] == "und" for i in (900, 901, 902))
    kept = language_id.keep_known(df, language_id.learn(df))
    assert kept.columns == df.columns and kept.count() == 201
    assert language_id.language_id(empty(spark), language_id.learn(empty(spark))).count() == 0


def test_kept_are_those_with_a_language(spark):
    own = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(random.Random(i).choices(own[x], k=5)) for _ in range(30)), x) for i in range(60) for x in [("aa", "bb")[i % 2]]]
    unlearned = " ".join("".join(random.Random(k).choices("klmnop", k=6)) for k in range(3000))
    df = spark.createDataFrame([*rows, (900, "a b c", None), (901, "mnop", None), (902, unlearned, None), (903, "12 !", None), (904, None, None)], "doc_id long, text string, lang string")
    model = language_id.learn(df)
    named = {i for i, r in by_id(language_id.language_id(df, model)).items() if r["lang_pred"] != "und"}
    assert {900, 901, 902} <= named and not {903, 904} & named
    assert set(by_id(language_id.keep_known(df, model))) == named


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, ". ".join(prose(12) + (" dolt" if bad and k == 2 else "") for k in range(6))))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = by_id(toxicity.toxicity(df, model))
    truth = dict(labels)
    held = [i for i in truth if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all("dolt" in dict(rows)[i][x["start"] : x["end"]] for i in held if truth[i] for x in found[i]["offending"])
    assert found[900]["score"] == found[901]["score"] == 0
    assert toxicity.toxicity(empty(spark), model).count() == 0


def test_exact_top_k(spark):
    rows = [(i, [random.gauss(0, 0.3) for _ in range(8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    bad = [(500, None), (520, [None] + [0.1] * 7), (540, [float("nan")] + [0.1] * 7), (560, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in pivot_search.exact_top_k(df, df.where("vec_id % 20 = 0"), pivots=8, block_rows=16).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    import numpy as np

    v = {i: np.floor(np.array(x, dtype=np.float32).astype(float) * 64).astype(int) for i, x in rows}
    for q in (i for i in v if i % 20 == 0):
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:20]
        assert found[q] == [(i, -s) for s, i in best]
    assert set(found) == {i for i in v if i % 20 == 0}
    assert pivot_search.exact_top_k(df.where("false"), df).count() == 0


def test_exact_top_k_drops_no_finite_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.1e6, 0.5]), (2, [0.5, 0.5]), (3, [float("inf"), 0.0])], "vec_id long, embedding array<double>")
    found = pivot_search.exact_top_k(df, df.where("vec_id = 0"), pivots=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 64 * 70_400_000), (2, 64 * 32)]
    for wrong in ([2e6] * 2, [0.1] * 3):
        more = df.union(spark.createDataFrame([(4, wrong)], df.schema))
        with pytest.raises(ValueError):
            pivot_search.exact_top_k(more, df.where("vec_id = 0")).collect()


def test_fixture_counts():
    assert Counter(t for t in TEXTS if t)[BASE[0]] == 6
