"""Streams over files equal the batch; late rows and restarts."""

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet")


def drained(df, mode, state):
    """The rows that a stream gives until its input is used up; of an updated row the last form comes last."""
    rows = []
    job = df.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect())).outputMode(mode).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    job.awaitTermination()
    return rows


def test_windows_and_sessions(spark, events, tmp_path):
    source = jobs.stream(spark, f"{FOLDER}/events*.parquet", events.schema)
    last = events.agg(F.max("ts")).first()[0]
    for name, f, time in (("windows", jobs.windowed, "window_start"), ("sessions", jobs.sessions, "session_start")):
        rows = {tuple(r) for r in drained(f(source), "append", tmp_path / name)}
        batch = f(events)
        whole = {tuple(r) for r in batch.collect()}
        # append mode gives what the watermark has closed
        assert rows <= whole and all((last - r[batch.columns.index(time)]).total_seconds() < 3600 for r in whole - rows)
        assert len(rows) > 0.9 * len(whole)


def test_late_and_repeated_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(folder)
    state = tmp_path / "state"
    write([(1, 100_000, 1, "a", 1.0), (1, 100_000, 1, "a", 1.0), (2, 100_100, 1, "a", 1.0)])
    schema = spark.read.parquet(folder).schema
    run = lambda: drained(jobs.distinct_events(jobs.stream(spark, folder, schema)), "append", state)
    assert sorted(r["event_id"] for r in run()) == [1, 2]
    # after a restart: one that was seen, one that is far too late, a new one
    write([(2, 100_100, 1, "a", 1.0), (3, 10, 1, "a", 1.0), (4, 100_200, 1, "a", 1.0)])
    assert sorted(r["event_id"] for r in run()) == [4]


def test_state_equals_batch(spark, events, tmp_path):
    from lodestone.operators import analytics as A

    source = jobs.stream(spark, f"{FOLDER}/events*.parquet", events.schema)
    kept = drained(jobs.cooled(source, 3600.0), "append", tmp_path / "cooled")
    rows = events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    assert len(kept) == A.cooled(rows, "user_id", 3600.0).count()
    found = drained(jobs.chapters(source, 3600.0, 7200.0), "append", tmp_path / "chapters")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    batch = A.chapters(events.select("user_id", "event_id", at.alias("start"), at.alias("stop")), "user_id", 3600.0, 7200.0)
    assert {tuple(r) for r in found} == {tuple(r) for r in batch.select("user_id", "event_id", "chapter").collect()}
    last = drained(jobs.recent(source, 3, 10**9), "update", tmp_path / "recent")
    assert all(len(r["event_ids"]) <= 3 for r in last) and len({r["user_id"] for r in last}) == events.select("user_id").distinct().count()


def test_running_statistics(spark, events, tmp_path):
    source = jobs.stream(spark, f"{FOLDER}/events*.parquet", events.schema)
    found = drained(jobs.running_stats(source), "update", tmp_path / "stats")
    assert {r["strategy"]: r["n"] for r in found} == {r["strategy"]: r["n"] for r in jobs.running_stats(events).collect()}
    counted = {r["event_type"]: r for r in drained(jobs.counters(source, [10, 100]), "update", tmp_path / "counters")}
    assert sum(r["n"] for r in counted.values()) == events.count()


def test_ingest_stream(spark, tmp_path):
    from lodestone.config import Config
    from lodestone.pipeline import Engine

    folder = str(tmp_path / "docs")
    spark.createDataFrame([("a", "red apples"), ("b", "blue skies")], "source_path string, content string").write.parquet(folder)
    engine = Engine(spark, str(tmp_path / "engine"), Config(dimension=16))
    schema = spark.read.parquet(folder).schema
    for _ in range(2):  # the second run has nothing new
        jobs.ingest_into(engine, jobs.stream(spark, folder, schema), str(tmp_path / "state")).awaitTermination()
    assert engine.store.count() == 4 and engine.index.stats()["documents"] == 2
