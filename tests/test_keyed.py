"""The keyed table: against a dictionary, with writers that meet, and by the bytes it writes."""

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.sources.keyed import Conflict, KeyedTable, Log
from lodestone.sources.store import ChunkStore

SCHEMA = "k long, g string, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(table):
    return sorted(map(tuple, table.rows().collect()))


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


@pytest.mark.parametrize("few", [200_000, 0])
def test_against_a_dictionary(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("lodestone.sources.keyed.FEW_DEAD", few)
    rng = random.Random(1)
    table, own = KeyedTable(spark, str(tmp_path), SCHEMA, ["k", "g"], buckets=4, most_segments=5), {}
    assert held(table) == [] and table.count() == 0
    for step in range(14):
        rows = [(rng.randint(0, 40), rng.choice("ab"), f"{step}-{i}") for i in range(rng.randint(0, 25))]
        if step % 3 == 2:
            assert table.delete(frame(spark, rows)) == len({(k, g) for k, g, _ in rows} & own.keys())
            for k, g, _ in rows:
                own.pop((k, g), None)
        elif step == 9:
            table.compact(whole=True)
            table.vacuum(keep=1)
            assert table.files()["dead"] == 0 and table.files()["segments"] == 1
        else:
            done = table.upsert(frame(spark, rows).coalesce(1))
            assert done == {"rows": len({(k, g) for k, g, _ in rows}), "replaced": len({(k, g) for k, g, _ in rows} & own.keys())}
            own |= {(k, g): v for k, g, v in rows}
        assert held(table) == sorted((*k, v) for k, v in own.items()) and table.count() == len(own)
    some = sorted(own)[:3]
    assert [tuple(r) for r in table.get(*some[0]).collect()] == [(*some[0], own[some[0]])] and table.get(99, "a").count() == 0
    found = table.lookup(spark.createDataFrame([(*k, 1) for k in [*some, (99, "a")]], "k long, g string, x int")).collect()
    assert sorted((r["k"], r["g"], r["v"]) for r in found) == [(*k, own[k]) for k in some]
    table.clear()
    assert held(table) == []


def test_second_writer_isn_t_lost(spark, tmp_path):
    a, b = (KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=2) for _ in range(2))
    a.upsert(frame(spark, [(1, "x", "old")]))
    state = a._state
    # b commits after a has read the state
    calls = []

    def late():
        found = state()
        if len(calls) == 1:
            b.upsert(frame(spark, [(1, "x", "b"), (2, "x", "b")]))
        calls.append(1)
        return found

    a._state = late
    a.upsert(frame(spark, [(1, "x", "a"), (3, "x", "a")]))
    assert held(b) == [(1, "x", "a"), (2, "x", "b"), (3, "x", "a")] and b.count() == 3 and len(calls) == 3
    calls.clear()
    with pytest.raises(Conflict):
        a.upsert(frame(spark, [(9, "x", "a")]), tries=1)
    assert held(b) == [(1, "x", "b"), (2, "x", "b"), (3, "x", "a")]


def test_many_writers(spark, tmp_path):
    errors = []

    def write(i):
        try:
            KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=2, most_segments=99).upsert(frame(spark, [(i, "x", "own"), (100, "x", str(i))]), tries=20)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = held(KeyedTable(spark, str(tmp_path), SCHEMA, ["k"]))
    assert not errors and [r[0] for r in found] == [0, 1, 2, 3, 4, 100]


def test_compaction_beside_a_writer(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=2)
    for i in range(3):
        table.upsert(frame(spark, [(k, "x", str(i)) for k in range(i, 6)]))
    other, change = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"]), table._change

    def late(make, tries):
        table._change = change
        other.upsert(frame(spark, [(5, "x", "late"), (7, "x", "late")]))
        other.delete(frame(spark, [(0, "", "")]))
        return change(make, tries)

    table._change = late
    assert table.compact(whole=True)
    assert held(table) == [(1, "x", "1"), (2, "x", "2"), (3, "x", "2"), (4, "x", "2"), (5, "x", "late"), (7, "x", "late")] and table.files()["segments"] == 2


def test_a_change_writes_what_it_changes(spark, tmp_path):
    rng = random.Random(2)
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], buckets=4)
    text = lambda: "".join(rng.choices("abcdefgh ", k=400))
    table.upsert(frame(spark, [(i, "x", text()) for i in range(20_000)]))
    before = size(tmp_path)
    table.upsert(frame(spark, [(i * 100, "x", text()) for i in range(200)]))
    assert size(tmp_path) - before < 0.03 * before and table.count() == 20_000
    assert table.rows(version=1).where("k = 100").first()["v"] != table.get(100).first()["v"]
    table.compact(whole=True)
    table.vacuum(keep=1)
    assert size(tmp_path) < 1.1 * before and table.count() == table.rows().count() == 20_000
    plan = table.get(100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k,100)]" in plan


def test_log(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.last() == (0, 0, None)
    log.commit(1, {"a": 1})
    with pytest.raises(Conflict):
        log.commit(1, {"a": 2})
    # a number claimed by a writer that is gone
    (tmp_path / "log" / f"{2:012d}.json").write_text("{")
    log.PATIENCE = 0.2
    assert log.last() == (2, 1, {"a": 1}) and log.get(2) is None
    log.commit(3, {"a": 3})
    assert log.last() == (3, 3, {"a": 3})


def test_last_row_of_an_id_stays(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    store.upsert(spark.createDataFrame([("a", str(i)) for i in range(50)], "doc_id string, content string"))
    assert store.get("a").first()["content"] == "49" and store.count() == 1
    store.upsert(spark.createDataFrame([("a", str(i), i) for i in range(50)], "doc_id string, content string, n int"), [F.asc("n")])
    assert store.get("a").first()["content"] == "0" and store.remove(spark.createDataFrame([("a",), ("b",)], "doc_id string")) == 1


def test_index_writers(spark, tmp_path):
    """Of two changes of the stored index from one state the second fails and changes nothing."""
    from lodestone.operators.index import SparseIndex

    index, other = (SparseIndex(spark, str(tmp_path), id_type="string") for _ in range(2))
    rows = spark.createDataFrame([("a", "red fox"), ("a", "red owl"), ("b", "blue fox")], "doc_id string, text string")
    assert index.add(rows.coalesce(1)) == 2
    state = other._manifest()
    index.remove(spark.createDataFrame([("b",)], "doc_id string"))
    other._manifest = lambda: state
    with pytest.raises(Conflict):
        other.add(spark.createDataFrame([("c", "red hen")], "doc_id string, text string"))
    asked = spark.createDataFrame([(1, "fox"), (2, "owl"), (3, "hen")], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"]) for r in index.search(asked).collect()] == [(2, "a")] and index.stats()["documents"] == 1
    # the cut to k comes after what may be found
    within = spark.createDataFrame([("b",)], "doc_id string")
    assert index.search(asked, k=1, within=within).count() == 0
