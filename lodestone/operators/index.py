"""A stored inverted index: segments of postings, deletions and a manifest in one folder.

Postings (term, doc_id, tf, dl) lie in folders by a hash bucket of their term, so that a
search reads the buckets of its terms alone.  Adding documents writes a segment, removing
some writes their ids; neither touches what stands.  A log of states names what counts, with the number of
documents and terms; its last one is the index, so readers see the state before a change or after it, and of two
writers from one state the second fails.  Document frequencies are counted over the postings
read, so weights are exact after every change.  ``compact`` writes everything anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import sparse as S
from lodestone.sources.keyed import Log
from lodestone.sources.store import written

#: Buckets of terms; query terms that become a filter at most.
BUCKETS, FEW_TERMS = 32, 200
EMPTY = {"segments": [], "removed": [], "n": 0, "terms": 0}


def _bucket(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class SparseIndex:
    def __init__(self, spark: SparkSession, folder: str, k1: float = 1.5, b: float = 0.75, id_type: str = "long", termless: bool = False) -> None:
        """``termless``: documents without a term are in the index too; they are counted, but found by no search."""
        self.spark, self.folder, self.k1, self.b, self.id_type, self.termless = spark, folder.rstrip("/"), k1, b, id_type, termless
        self.log = Log(spark, f"{self.folder}/manifests")
        self.kinds = {"docs": f"doc_id {id_type}, dl int", "postings": f"doc_id {id_type}, term string, tf long, dl int, bucket int"}

    # --- the manifest

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """The number of the next change, and the state."""
        top, _, state = self.log.last()
        return top, state or dict(EMPTY)

    def _commit(self, number: int, state: dict) -> None:
        """The state after this one; ``keyed.Conflict`` if another writer was first."""
        self.log.commit(number + 1, state)

    # --- what stands

    def _all(self, kind: str, state: dict, buckets: list[int] | None = None, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """``only``: what is left of the rows before those of removed documents go."""
        schema = self.kinds[kind]
        segments = list(state["segments"])
        if buckets is None:
            parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{x}/{kind}") for x in segments]
        else:
            # the folders of the asked buckets alone, so that no others are listed
            found = {x: self._buckets(f"{x}/{kind}", buckets) for x in segments}
            segments = [x for x in segments if found[x]]
            parts = [self.spark.read.schema(schema).option("basePath", f"{self.folder}/{x}/{kind}").parquet(*found[x]) for x in segments]
        if not parts:
            return self.spark.createDataFrame([], schema)
        gone = [self.spark.read.parquet(f"{self.folder}/{x}") for x in state["removed"]]
        # an id that is removed and added again counts from its new segment on
        at = {x: i for i, x in enumerate(state["segments"])}
        parts = [p.withColumn("segment", F.lit(at[x])) for x, p in zip(segments, parts, strict=True)]
        rows = only(reduce(DataFrame.unionByName, parts))
        if gone:
            late = reduce(DataFrame.unionByName, gone).groupBy("doc_id").agg(F.max("upto").alias("upto"))
            rows = rows.join(late, "doc_id", "left").where("upto is null or segment >= upto").drop("upto")
        return rows.drop("segment")

    def _buckets(self, folder: str, wanted: list[int]) -> list[str]:
        path, fs = self._path(folder)
        there = {f.getPath().getName() for f in fs.listStatus(path)}
        return [f"{self.folder}/{folder}/bucket={b}" for b in wanted if f"bucket={b}" in there]

    def documents(self) -> DataFrame:
        """(doc_id, dl) of the documents in the index."""
        return self._all("docs", self._manifest()[1])

    def postings(self) -> DataFrame:
        return self._all("postings", self._manifest()[1])

    def stats(self) -> dict:
        _, state = self._manifest()
        return {"documents": state["n"] + state.get("termless", 0), "avgdl": state["terms"] / state["n"] if state["n"] else 0.0, "terms": self.postings().select("term").distinct().count() if state["n"] else 0}

    # --- changes

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add documents that aren't in the index and have a term, or may be without; how many those were.  Of rows of one id the last in
        the frame counts."""
        number, state = self._manifest()
        rows = docs.select(F.col(id_col).cast(self.id_type).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at")).where("doc_id is not null")
        if state["segments"]:
            rows = rows.join(self.documents().select("doc_id"), "doc_id", "left_anti")
        rows = rows.groupBy("doc_id").agg(F.max_by("text", "at").alias("text"))
        name = f"segment-{uuid.uuid4().hex}"
        rows = written(rows, "added") if self.termless else rows
        post = S.counted(rows).withColumn("bucket", _bucket(F.col("term")))
        # a frequent term's postings are dealt to several tasks and files
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = post.repartition(parts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, parts // BUCKETS))))
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/postings")
        # from the postings as written, so that both tell of the same texts
        stands = self.spark.read.schema(self.kinds["postings"]).parquet(f"{self.folder}/{name}/postings")
        lengths = stands.groupBy("doc_id").agg(F.max("dl").alias("dl"))
        if self.termless:
            lengths = rows.select("doc_id").join(lengths, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        lengths.write.parquet(f"{self.folder}/{name}/docs")
        new = self._sums(f"{name}/docs")
        if new[0] + new[2]:
            self._commit(number, state | {"segments": [*state["segments"], name], "n": state["n"] + new[0], "terms": state["terms"] + new[1], "termless": state.get("termless", 0) + new[2]})
        return new[0] + new[2]

    def _sums(self, folder: str) -> tuple[int, int, int]:
        """How many documents with a term a folder names, their terms, and how many without."""
        rows = self.spark.read.schema(self.kinds["docs"]).parquet(f"{self.folder}/{folder}")
        return tuple(rows.agg(F.count_if(F.col("dl") > 0), F.coalesce(F.sum("dl"), F.lit(0)), F.count_if(F.col("dl") == 0)).first())

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        """Remove the documents of these ids; how many there were."""
        number, state = self._manifest()
        if not state["segments"]:
            return 0
        name = f"removed-{uuid.uuid4().hex}"
        gone = self.documents().join(ids.select(F.col(id_col).cast(self.id_type).alias("doc_id")).distinct(), "doc_id", "left_semi")
        gone.withColumn("upto", F.lit(len(state["segments"]))).write.parquet(f"{self.folder}/{name}")
        old = self._sums(name)
        if old[0] + old[2]:
            self._commit(number, state | {"removed": [*state["removed"], name], "n": state["n"] - old[0], "terms": state["terms"] - old[1], "termless": state.get("termless", 0) - old[2]})
        return old[0] + old[2]

    def sync(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
        """Make the index hold exactly these documents' ids: (added, removed)."""
        there = docs.select(F.col(id_col).cast(self.id_type).alias("doc_id"))
        removed = self.remove(self.documents().join(there, "doc_id", "left_anti")) if self._manifest()[1]["segments"] else 0
        return self.add(docs, id_col, text_col), removed

    def rebuild(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        self.clear()
        return self.add(docs, id_col, text_col)

    def clear(self) -> None:
        """An empty index; files of former states stay until ``compact``."""
        number, _ = self._manifest()
        self._commit(number, dict(EMPTY))

    def compact(self) -> None:
        """One segment of all documents, without deletions; what it replaces is deleted."""
        number, state = self._manifest()
        name = f"segment-{uuid.uuid4().hex}"
        if state["n"] + state.get("termless", 0):
            self.postings().repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/postings")
            self.documents().write.parquet(f"{self.folder}/{name}/docs")
        self._commit(number, state | {"segments": [name] if state["n"] + state.get("termless", 0) else [], "removed": []})
        for old in [*state["segments"], *state["removed"]]:
            path, fs = self._path(old)
            fs.delete(path, True)

    # --- search

    def search(self, queries: DataFrame, k: int = 10, within: DataFrame | None = None) -> DataFrame:
        """queries (query_id, text) to (query_id, doc_id, score, rank) by BM25; ``within``: the documents (doc_id) that
        may be found, all without it.  Weights are those of the whole index."""
        _, state = self._manifest()
        made = S.result_type(queries, self.spark.createDataFrame([], self.kinds["docs"]).schema["doc_id"].dataType)
        parts = []
        for ids, terms, times in S.blocks(S.asked_terms(queries)) if state["n"] else ():
            rows = self._matched(state, terms)
            parts.append(S.ranked(rows, ids, times, state["n"], state["terms"] / state["n"], k, self.k1, self.b, made, within))
        return S.top_k(reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], made), k)

    def _matched(self, state: dict, terms: list[str]) -> DataFrame:
        """``sparse.matched`` from the postings of these terms: written, a row a document."""
        slots = self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "slot": pa.array(range(len(terms)), pa.int32())}))
        slots = slots.withColumn("bucket", _bucket(F.col("term")))
        buckets = [r[0] for r in slots.select("bucket").distinct().collect()]  # at most BUCKETS numbers

        def asked(post: DataFrame) -> DataFrame:
            # files are sorted by term, so that a filter by few terms skips what can't hold them
            post = post.where(F.col("term").isin(terms)) if len(terms) <= FEW_TERMS else post
            return post.join(F.broadcast(slots.select("term", "slot")), "term")

        post = self._all("postings", state, buckets, asked)
        pairs = F.collect_list(F.struct("slot", F.col("tf").cast("int").alias("tf")))
        rows = post.groupBy("doc_id", "dl").agg(pairs.alias("p"))
        return written(rows.select("doc_id", "dl", F.col("p.slot").alias("slots"), F.col("p.tf").alias("tfs")), "matched")
