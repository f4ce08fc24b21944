"""The five stages on a small folder of tables, each against a plain loop over its own input."""

import random
import re
import sys
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    base = [prose(rng, 80) for _ in range(30)]
    item = prose(rng, 25)
    near = base[4].split()
    near[40] = "changed"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    extra = [
        (30, base[3]), (31, " ".join(near)), (32, prose(rng, 20) + " " + item + " " + prose(rng, 20)), (33, prose(rng, 60) + " card 4111 1111 1111 1111"),
        (34, ""), (35, None), (36, "12 34 !"), (37, prose(rng, 9)), (37, prose(rng, 9)), (None, prose(rng, 30)), (None, item), (38, "x"), (39, prose(rng, 30000)),
    ]
    rows += [(i, t, "en", None, len(t) if t is not None else None) for i, t in extra]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def expected(name, rows, item):
    if name == "language":
        return [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    if name == "near_duplicates":
        # rows of one id are the document of its least set; here only two of an id, both unlinked
        sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
        root = {i: i for i, _ in sets}
        for _ in range(3):
            for i, a in sets:
                for j, b in sets:
                    if a and b and 100 * len(a & b) >= 80 * len(a | b):
                        root[i] = root[j] = min(root[i], root[j])
        return [r for r in rows if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]]
    assert name == "decontamination"
    w = re.findall("[0-9a-z]+", item)
    runs = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    own = lambda r: re.findall("[0-9a-z]+", (r["text"] or "").lower())
    return [r for r in rows if not runs & {tuple(own(r)[k : k + 10]) for k in range(len(own(r)) - 9)}]


def test_stages(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: tuple(str(r[c]) for c in COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        found = out.collect()
        if name == "pieces":
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert sorted((str(r["doc_id"]), list(r["ids"])) for r in found) == sorted((str(r["doc_id"]), sp.encode(r["text"])) for r in before)
        elif name == "pseudonyms":
            assert out.columns == COLUMNS and len(found) == len(before)
            old, new = ({str(r["doc_id"]): r for r in rows if r["doc_id"] is not None} for rows in (before, found))
            assert {i for i in old if old[i]["text"] != new[i]["text"]} == {"33"} and "4111 1111 1111 1111" not in new["33"]["text"]
            assert all(r["n_chars"] == len(r["text"]) for r in found)
        else:
            assert out.columns == COLUMNS
            assert sorted(map(key, found)) == sorted(map(key, expected(name, before, item))), name
            assert 0 < len(found) < len(before)
        docs = out


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 20
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
