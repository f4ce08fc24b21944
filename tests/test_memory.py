"""Bounded keyed state: equal to the batch, bounded, late rows, restarts and expiry."""

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import jobs, memory

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "event_id long, at long, event_type string, value double"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    memory.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def drained(df, state):
    rows = []
    df.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
    return {r["key"]: r for r in rows}


def same(a, b):
    return (a["n"], a["total"], a["successes"], a["last"]) == (b["n"], b["total"], b["successes"], b["last"]) and abs(a["confidence"] - b["confidence"]) < 1e-9


@pytest.mark.parametrize(("most", "shown"), [(10_000, 100), (7, 3)])
def test_stream_equals_batch(spark, tmp_path, most, shown):
    folder = str(tmp_path / "in")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    # files in order of time, so that several batches come
    parts = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").repartitionByRange(4, "ts")
    for i in range(4):
        parts.where(F.spark_partition_id() == i).coalesce(1).write.mode("append").parquet(folder)
    found = drained(memory.memory(jobs.stream(spark, folder, parts.schema, files=1), most, shown, 10**9), tmp_path / "state")
    own = {r["key"]: r for r in memory.memory_of_table(parts, most, shown).collect()}
    assert found.keys() == own.keys() and all(same(found[k], own[k]) for k in own)
    assert all(r["n"] <= most and len(r["last"]) <= shown for r in found.values()) and any(r["total"] > 7 for r in found.values())


def test_late_rows_restart_and_expiry(spark, tmp_path):
    folder, state = str(tmp_path / "in"), tmp_path / "state"

    def run(*rows):
        spark.createDataFrame(list(rows), SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        return {k: (r["n"], r["total"], r["successes"], r["last"]) for k, r in drained(memory.memory(jobs.stream(spark, folder, schema), 3, 2, 5000), state).items()}

    assert run((1, 100_000, "a", 50.0), (2, 100_001, "a", 500.0), (9, 100_000, "b", 1.0), (8, 100_000, None, 1.0)) == {"a": (2, 2, 1, [1, 2]), "b": (1, 1, 0, [9])}
    # a new run on the old state; one row far too late
    assert run((3, 100_100, "a", 400.0), (4, 100_200, "a", 1.0), (5, 10, "a", 400.0)) == {"a": (3, 4, 2, [3, 4])}
    # time passes: b expires, a has a new row in time
    found = run((6, 104_000, "a", 1.0), (7, 106_500, "c", 1.0))
    assert found["a"][:2] == (3, 5) and found["c"] == (1, 1, 0, [7]) and found["b"] == (0, 0, 0, [])
    assert run((10, 106_600, "b", 500.0))["b"] == (1, 1, 1, [10])
