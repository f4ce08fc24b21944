"""Structured Streaming jobs: the same plans over readStream, with watermarks and keyed state.

Late rows: a row that is older than the watermark (the latest time seen less ``late``) is dropped
by every stateful job.  Keyed state is bounded: a key's history has a limit and expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, ``files`` of them in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _marked(events: DataFrame, late: str) -> DataFrame:
    # watermarks need instants; times without a zone count in the session's
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def distinct_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once, as far as the watermark reaches back."""
    marked = _marked(events, late)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])


def windowed(events: DataFrame, size: str = "60 seconds", slide: str = "50 seconds", late: str = LATE) -> DataFrame:
    out = _marked(events, late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "120 seconds", late: str = LATE) -> DataFrame:
    out = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def running_stats(events: DataFrame) -> DataFrame:
    """Counts and sums of strategies so far: for update mode."""
    success = F.count_if(F.col("value") > 100).alias("successes")
    return events.groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"), F.sum(F.least(F.col("value") / 500, F.lit(1.0))).alias("confidence"), success)


def counters(events: DataFrame, bounds: list[float]) -> DataFrame:
    """Executions, errors and a latency histogram by kind so far: for update mode."""
    up_to = [F.count_if(F.col("value") <= b).alias(f"le_{b:g}") for b in bounds]
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), *up_to)


def _stateful(events: DataFrame, f, out: str, state: str, mode: str = "append") -> DataFrame:
    return events.groupBy("user_id").applyInPandasWithState(f, out, state, mode, GroupStateTimeout.EventTimeTimeout)


def cooled(events: DataFrame, gap: float, late: str = LATE, keep: int = 86_400) -> DataFrame:
    """(user_id, event_id, ts): a user's first event, and each that comes ``gap`` seconds after the last
    kept.  A user without events for ``keep`` seconds begins anew."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        chosen = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            chosen.append(last is None or t - last >= gap)
            last = t if chosen[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + keep) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.loc[chosen, ["user_id", "event_id", "ts"]]

    return _stateful(_marked(events, late), run, "user_id long, event_id long, ts timestamp", "last double")


def chapters(events: DataFrame, gap: float = 120.0, longest: float = 300.0, late: str = LATE, keep: int = 86_400) -> DataFrame:
    """(user_id, event_id, chapter): events numbered by chapters that end at a gap or when longer
    than ``longest`` seconds; events of a batch are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, begin, last = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            if not number or t - last > gap or t - begin > longest:
                number, begin = number + 1, t
            last = t
            out.append(number)
        state.update((number, begin, last))
        state.setTimeoutTimestamp(max(int((last + keep) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[["user_id", "event_id"]].assign(chapter=out)

    return _stateful(_marked(events, late), run, "user_id long, event_id long, chapter long", "number long, begin double, last double")


def recent(events: DataFrame, most: int = 50, ttl: int = 86_400, late: str = LATE) -> DataFrame:
    """(user_id, event_ids): after each batch a user's last ``most`` events of the last ``ttl`` seconds:
    for update mode."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, times = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        at = (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        both = sorted(zip(times + at, ids + rows["event_id"].tolist(), strict=True))
        both = [(t, i) for t, i in both if t > both[-1][0] - ttl][-most:]
        state.update(([i for _, i in both], [t for t, _ in both]))
        state.setTimeoutTimestamp(max(int((both[-1][0] + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "event_ids": [[i for _, i in both]]})

    return _stateful(_marked(events, late), run, "user_id long, event_ids array<long>", "ids array<long>, times array<double>", "update")


def ingest(documents: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch once through ``write`` (an idempotent upsert by id)."""
    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(engine, documents: DataFrame, checkpoint: str, id_col: str = "source_path", text_col: str = "content"):
    """Documents that arrive into an engine's store and index; a batch that is repeated after a
    failure changes nothing, as ids come from contents."""
    return ingest(documents, lambda rows, _: engine.ingest(rows, id_col, text_col), checkpoint)
