"""Null and repeated ids, very long texts, clashing columns and empty tables, in every operator."""

import random

import public_tokenizers
import pytest

from lodestone.llm import compact_windows, decontaminate, language_id, near_dedup, pieces, pivot_search, pseudonyms, substrings, token_counts, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators use for columns of their own.
CLASH = ["id", "ID", "key", "row", "n", "spans", "place", "tag", "root", "class", "ids", "items", "score", "t"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(n))


LONG = prose(1, 40_000)
ROWS = [(1, prose(2, 80)), (2, prose(2, 80)), (3, prose(3, 80)), (3, prose(4, 80)), (4, prose(5, 70)), (4, prose(5, 70)), (None, prose(2, 80)), (None, None), (5, None), (6, ""), (7, LONG), (8, prose(6, 30) + " " + prose(2, 80))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * len(CLASH)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}_` string" for c in CLASH)).toDF("doc_id", "text", *CLASH)


def operators(spark):
    words = spark.createDataFrame([(1, prose(2, 80)), (1, prose(3, 80)), (None, prose(9, 12)), (2, None)], "item_id long, text string")
    learned = spark.createDataFrame([(i, prose(i, 20), "aa", i % 2) for i in range(40)], "doc_id long, text string, lang string, toxic int")
    language, toxic = language_id.learn(learned), toxicity.learn(learned, learned)
    return {
        "op1": lambda df: toxicity.toxicity(df, toxic),
        "op3": lambda df: token_counts.token_counts(df, BPE),
        "op4": lambda df: pseudonyms.personal_data(df, "key"),
        "op5": substrings.repeated_strings,
        "op6": lambda df: language_id.language_id(df, language),
        "op7": near_dedup.near_duplicates,
        "op8": lambda df: pieces.encode(df, MODEL, checked=True),
        "op9": lambda df: decontaminate.digest(decontaminate.contamination(df, words)),
        "op10": compact_windows.near_passages,
    }


def shown(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_odd_rows(spark, name):
    run = operators(spark)[name]
    df = table(spark, ROWS)
    whole = run(df)
    assert shown(whole) == shown(run(df.select("text", "doc_id").repartition(5)))
    found = whole.collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ROWS)
    assert run(table(spark, [])).count() == 0
    at = {i: [r for r in found if r["doc_id"] == i] for i in (1, 2, 3, 4, 5, 7, 8, None)}
    if name == "op5":
        # a copy goes whole, rows of one id don't remove from each other, null ids take no part
        assert at[2][0]["n_removed"] == len(prose(2, 80)) and {r["n_removed"] for r in at[3] + at[4] + at[None]} == {0}
        assert at[8][0]["n_removed"] == len(prose(2, 80))
    if name == "op7":
        assert at[2][0]["component_id"] == 1 and all(r["component_id"] == 4 and r["kept"] for r in at[4]) and all(r["component_id"] is None for r in at[None])
    if name == "op8":
        assert all(r["same"] for r in found)
    if name == "op9":
        assert at[1][0]["contaminated"] and at[1][0]["n_items"] == 1 and not at[5][0]["contaminated"]
    if name == "op10":
        assert at[8][0]["class_id"] == 1 and at[8][0]["n_spans"] == 1 and at[7][0]["n_spans"] == 0 and all(r["n_spans"] == 0 for r in at[None])


def test_token_classes_are_the_library_s():
    """Every code point in a context of letters, numbers, contractions and blanks."""
    import json

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    with open(BPE) as f:
        edge, kinds = token_counts.char_runs(json.dumps(json.load(f)))
    table = np.repeat(kinds, np.diff(np.append(edge, 0x110000)))
    for lo in range(0, 0x110000, 1 << 15):
        text = "".join(f"x{chr(c)}'s 1{chr(c)} {chr(c)}  ? " for c in range(lo, lo + (1 << 15)) if not 0xD800 <= c < 0xE000)
        if text:
            data = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            starts = token_counts.pretoken_starts(data, table[data])
            assert np.flatnonzero(starts).tolist() == [a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(lo)


def test_top_k_of_odd_rows(spark):
    rows = [(1, [0.5, 0.5]), (1, [0.9, 0.0]), (2, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.1, 0.2]), (3, None), (4, [float("nan"), 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, v string")
    found = [(r["rank"], r["vec_id"], r["score"]) for r in pivot_search.exact_top_k(df, df.where("vec_id = 20"), pivots=2).orderBy("rank").collect()]
    # every vector of a repeated id is a candidate
    assert [x[1:] for x in found] == [(1, 6 * 32 + 12 * 32), (2, 6 * 32 + 12 * 32), (1, 6 * 57)]
    assert pivot_search.exact_top_k(df, df.where("false")).count() == 0 and pivot_search.exact_top_k(df.where("false"), df).count() == 0
