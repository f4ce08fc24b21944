"""Bounded histories of outcomes as keyed state: a map state as a ring, running sums, and expiry.

A key's outcomes lie in a map from place to outcome; the place is the outcome's number by ``most``, so a new outcome takes the
place of the one that falls out and no batch rewrites a history.  The sums over the kept ones are kept beside it.  A list
state holds the last ``shown`` for the output.  After ``ttl`` seconds of event time without a row the key's state goes.

Streams need the RocksDB state store; ``use_rocksdb`` sets it for the session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.jobs import LATE, _marked

MOST, SHOWN, TTL = 10_000, 100, 86_400
OUT = "key string, n long, total long, confidence double, successes long, last array<long>"
#: Confidences are summed as whole numbers of this part, so that taking one off gives what was before.
UNIT = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Memory(StatefulProcessor):
    def __init__(self, most: int = MOST, shown: int = SHOWN, ttl: int = TTL) -> None:
        self.most, self.shown, self.ttl = most, shown, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "place int", "confidence long, success int")
        self.last = handle.getListState("last", "event_id long")
        self.sums = handle.getValueState("sums", "total long, confidence long, successes long, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        total, confidence, successes, seen = self.sums.get() if self.sums.exists() else (0, 0, 0, 0)
        at = frame["ts"].astype("datetime64[ms]").astype("int64")
        for part, success in zip(frame["part"].tolist(), frame["success"].tolist(), strict=True):
            place = (total % self.most,)
            if total >= self.most:
                old = self.ring.getValue(place)
                confidence, successes = confidence - old[0], successes - old[1]
            self.ring.updateValue(place, (int(part), int(success)))
            total, confidence, successes = total + 1, confidence + int(part), successes + int(success)
        last = ([x[0] for x in self.last.get()] if self.last.exists() else []) + frame["event_id"].astype("int64").tolist()
        last = last[-self.shown :]
        self.last.put([(x,) for x in last])
        newest = max(seen, int(at.max()))
        self.sums.update((total, confidence, successes, newest))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(newest + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        n = min(total, self.most)
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total], "confidence": [confidence / UNIT / n], "successes": [successes], "last": [last]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (self.ring, self.last, self.sums):
            state.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [0], "total": [0], "confidence": [0.0], "successes": [0], "last": [[]]})

    def close(self) -> None:
        pass


def _outcomes(events: DataFrame) -> DataFrame:
    """events (event_id, ts, event_type, value) as outcomes of strategies; no null among them."""
    part = F.floor(F.least(F.col("value") / 500, F.lit(1.0)) * UNIT)
    rows = events.where("event_id is not null and ts is not null and event_type is not null and value is not null")
    return rows.select(F.col("event_type").alias("key"), "event_id", "ts", part.cast("long").alias("part"), (F.col("value") > 100).cast("int").alias("success"))


def memory(events: DataFrame, most: int = MOST, shown: int = SHOWN, ttl: int = TTL, late: str = LATE) -> DataFrame:
    """Per strategy after each batch: (key, n, total, confidence, successes, last): how many outcomes are kept and were seen, their mean
    confidence and successes, and the last ids.  For update mode; a key that expires gives a row of zeros.

    Rows of a batch count by time, batches as they come; rows behind the watermark are dropped."""
    rows = _outcomes(_marked(events, late))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Memory(most, shown, ttl), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def memory_of_table(events: DataFrame, most: int = MOST, shown: int = SHOWN) -> DataFrame:
    """The same of a whole table, in order of time: what a stream without late rows and expiry ends with."""
    w = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = _outcomes(events).withColumn("back", F.row_number().over(w))
    totals = rows.groupBy("key").agg(F.count("*").alias("total"))
    kept = rows.where(F.col("back") <= most).groupBy("key").agg(
        F.count("*").alias("n"), (F.sum("part") / UNIT / F.count("*")).alias("confidence"), F.sum("success").alias("successes"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("back") <= shown, F.struct((-F.col("back")).alias("b"), "event_id")))), lambda x: x["event_id"]).alias("last"),
    )
    return kept.join(totals, "key").select("key", "n", "total", "confidence", "successes", "last")
