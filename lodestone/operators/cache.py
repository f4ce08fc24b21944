"""A stored cache of results by key: only what isn't stored is computed.

Values lie in one keyed table, and when each was last used in another, so that a use doesn't rewrite a value.  Every call adds a
row of how many keys were asked, found and computed, from which ``stats`` makes the hit rate.  A key of more than ``LONG`` bytes is
stored as its SHA-256, so that whole texts as keys are moved once, to compute their values, and never written."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.keyed import KeyedTable
from lodestone.sources.store import written

LONG = 64


def stored_key(key: Column) -> Column:
    """The key, or a digest that no shorter key equals; null for null."""
    return F.when(F.octet_length(key) <= LONG, key).otherwise(F.concat(F.lit("sha256:"), F.sha2(key.cast("binary"), 256)))


class ResultCache:
    def __init__(self, spark: SparkSession, folder: str, value_type: str, ttl: float | None = None, most: int | None = None, clock: Callable[[], float] = time.time) -> None:
        """``value_type``: the values' SQL type.  ``ttl``: seconds after which a value is computed anew.  ``most``: how many values stay,
        those used last; more stay until the next ``evict``, which every call that stores something ends with."""
        self.spark, self.folder, self.ttl, self.most, self.clock = spark, folder.rstrip("/"), ttl, most, clock
        self.values = KeyedTable(spark, f"{self.folder}/values", f"key string, value {value_type}, made double", ["key"])
        self.uses = KeyedTable(spark, f"{self.folder}/uses", "key string, used double", ["key"])
        self.calls = f"{self.folder}/calls"

    def fetch(self, rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], out: str = "value") -> DataFrame:
        """rows with ``out``, the value of their ``key`` column.

        ``compute`` gets the distinct rows of keys that aren't stored, one a key, and returns (key, value); values that are null, and
        keys that are, aren't stored and stay null."""
        now = self.clock()
        given = rows.where(F.col(key).isNotNull()).withColumnRenamed(key, "key").withColumn("_id", stored_key(F.col("key").cast("string")))
        asked = written(given.select(F.col("_id").alias("key")).distinct(), "asked")
        fresh = self.values.rows().where(F.lit(True) if self.ttl is None else F.col("made") > now - self.ttl)
        hits = written(asked.join(fresh, "key", "left_semi"), "hits")
        absent = asked.join(hits, "key", "left_anti").withColumnRenamed("key", "_id")
        missing = given.join(absent, "_id", "left_semi").dropDuplicates(["_id"]).drop("_id")
        # written before it is filtered, as Spark may compute a function for the filter and again for the value
        made = written(compute(missing).select(stored_key(F.col("key").cast("string")).alias("key"), "value"), "made").where("value is not null")
        self.values.upsert(made.withColumn("made", F.lit(now)))
        self.uses.upsert(hits.union(made.select("key")).withColumn("used", F.lit(now)))
        n, hit = asked.count(), hits.count()
        self.spark.createDataFrame([(now, n, hit, n - hit)], "at double, asked long, hits long, misses long").coalesce(1).write.mode("append").parquet(self.calls)
        # settled before an eviction may delete files: written values are read, not the table
        values = written(asked.select("key").join(self.values.rows(), "key").select("key", F.col("value").alias(out)), "values")
        if n > hit:
            self.evict()
        found = rows.withColumn("_id", stored_key(F.col(key).cast("string"))).join(values.withColumnRenamed("key", "_id"), "_id", "left")
        return found.select(key, *[c for c in rows.columns if c != key], out)

    def evict(self) -> int:
        """Drop what has expired, and beyond ``most`` what was used longest ago, ties by key; how many values went."""
        gone = 0
        if self.ttl is not None:
            gone += self._drop(self.values.rows().where(F.col("made") <= self.clock() - self.ttl).select("key"))
        over = self.values.count() - self.most if self.most is not None else 0
        if over > 0:
            kept = self.uses.rows().join(self.values.rows().select("key"), "key", "left_semi")
            gone += self._drop(kept.orderBy("used", "key").limit(over).select("key"))
        return gone

    def _drop(self, keys: DataFrame) -> int:
        keys = written(keys, "gone")
        self.uses.delete(keys)
        return self.values.delete(keys)

    def stats(self) -> DataFrame:
        """One row: calls, asked, hits, misses, hit_rate, values."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.calls)
        none = self.spark.createDataFrame([], "at double, asked long, hits long, misses long")
        rows = self.spark.read.schema(none.schema).parquet(self.calls) if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) else none
        total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("asked", "hits", "misses")]
        return rows.agg(F.count("*").alias("calls"), *total).select("*", F.coalesce(F.col("hits") / F.nullif("asked", F.lit(0)), F.lit(0.0)).alias("hit_rate"), F.lit(self.values.count()).cast("long").alias("values"))

    def clear(self) -> None:
        self.values.clear()
        self.uses.clear()
