"""Approximate vector search: a stored index of inverted lists around centroids.

``train`` makes centroids by rounds of Spark jobs over unit vectors.  ``add`` puts each vector into the list of its nearest
one: folders by ``cell``, with the vector, its sign bits, and the level and language that searches filter by.  A search
finds each query's ``probes`` nearest centroids, reads those lists' folders alone, and joins blocks of queries with
blocks of list rows by cell; scores are exact cosines, and only k rows a query leave a block.  ``quantised`` reads the
sign bits first, and vectors only for the candidates that have the fewest differing bits.

What counts is told by a log of states, as in ``sources.keyed``: adding writes a segment, replacing and removing write
the ids that are gone.  Only centroids, and a number for each cell, pass through the driver.

Vectors that are null, empty, hold nulls or have another length than the centroids aren't in the index, nor are null ids;
queries of that kind find nothing.  A vector of length 0 lies in some list and scores 0.  Ties go to the smaller id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.operators.clusters import matrix, train
from lodestone.operators.dense import WHOLE
from lodestone.operators.sparse import DECIMALS, top_k
from lodestone.sources.keyed import Log

#: Rows of queries and of lists that meet at once; rows of a cell beyond which its query blocks are sent to several tasks.
QUERY_ROWS, LIST_ROWS, HOT_ROWS = 256, 4096, 262_144
SAMPLE, MOST_CELLS, FEW_GONE = 100_000, 4096, 200_000


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _unit(matrix(batch.column("embedding")))
                cell = ((centroids * centroids).sum(1)[None] - 2 * m @ centroids.T).argmin(1)
                code = np.packbits(m > 0, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in code], pa.binary()), pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "code", "cell"])

    return run


def _probe(centroids: np.ndarray, probes: int, hot: np.ndarray):
    """For each query a row for each of its nearest cells, and for each part of a hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _unit(matrix(batch.column(1)))
                far = (centroids * centroids).sum(1)[None] - 2 * m @ centroids.T
                cells = np.argsort(far, axis=1, kind="stable")[:, :probes].reshape(-1)
                who, times = np.repeat(np.arange(len(m)), min(probes, len(centroids))), hot[cells]
                part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                who, cells = np.repeat(who, times), np.repeat(cells, times)
                for lo in range(0, len(who), 8192):
                    at = slice(lo, lo + 8192)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[at].astype(np.int32)), pa.array(part[at].astype(np.int32)), batch.column(0).take(pa.array(who[at])), pa.array([x.tobytes() for x in m[who[at]]], pa.binary())], names=["cell", "part", "query_id", "q"])

    return run


def _pack(size: int, hot: np.ndarray | None, kind: pa.DataType):
    """Consecutive rows (cell, part or not, id, bytes) of one cell as one row; a list's blocks are dealt to the parts of
    its cell in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            cell = batch.column(0).to_numpy()
            part = np.zeros(len(cell), np.int32) if hot is not None else batch.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)).tolist()
            for a, b in zip(edge, [*edge[1:], len(cell)], strict=True):
                for lo in range(a, b, size):
                    n = min(size, b - lo)
                    own = part[lo] if hot is None else turn % hot[cell[lo]]
                    turn += 1
                    ids, data = (batch.column(i).slice(lo, n) for i in (-2, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[lo : lo + 1]), pa.array([own], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.cast(kind)), pa.array([b"".join(data.to_pylist())], pa.binary())], names=["cell", "part", "ids", "data"])

    return run


def _meet(k: int, bits: int | None, kinds: list[pa.DataType]):
    """The k best of each query in a block: by cosine, or by sign bits where ``bits`` is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, ids, data = (batch.column(c)[i] for c in range(4))
                q_ids, ids = q_ids.values, ids.values
                order = pc.sort_indices(ids)
                q = np.frombuffer(q.as_buffer()).reshape(len(q_ids), -1)
                if bits is None:
                    m = _unit(np.frombuffer(data.as_buffer(), np.float32).reshape(len(ids), -1).astype(np.float64))[order.to_numpy()]
                    score = q @ m.T
                else:
                    code = np.frombuffer(data.as_buffer(), np.uint8).reshape(len(ids), -1)[order.to_numpy()]
                    asked = np.packbits(q > 0, axis=1)
                    score = np.empty((len(asked), len(code)))
                    for j in range(len(asked)):
                        score[j] = -np.bitwise_count(code ^ asked[j]).sum(1, dtype=np.int64)
                # rows by id, so a stable sort leaves ties to the smaller
                best = np.argsort(-np.round(score, DECIMALS), axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(np.repeat(np.arange(len(q_ids)), n))).cast(kinds[0]), ids.take(order).take(pa.array(best.reshape(-1))).cast(kinds[1]), pa.array(np.take_along_axis(score, best, 1).reshape(-1)), pa.array(np.full(best.size, batch.column(4)[i].as_py()), pa.int32())],
                    names=["query_id", "doc_id", "score", "cell"],
                )

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of 32-bit floats."""
    for batch in batches:
        m = matrix(batch.column(2)).astype(np.float32) if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in m], pa.binary())], names=["cell", "doc_id", "data"])


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long") -> None:
        self.spark, self.folder, self.id_type = spark, folder.rstrip("/"), id_type
        self.log = Log(spark, f"{self.folder}/log")
        self.schema = f"doc_id {id_type}, doc_level string, language_code string, embedding array<float>, code binary, cell int"

    def _state(self) -> tuple[int, dict]:
        top, _, state = self.log.last()
        if state is None:
            raise ValueError("train the index first")
        return top, state

    def _centroids(self, state: dict) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.folder}/{state['centroids']}").orderBy("cell").toArrow()
        return matrix(rows.column("v"))

    # --- building

    def train(self, vectors: DataFrame, cells: int | None = None, rounds: int = 10, sample: int = SAMPLE) -> int:
        """Centroids from about ``sample`` of the vectors (doc_id, embedding), all if fewer; how many.  The index is empty then.

        ``cells``: by default four times the square root of the number of vectors, within 8 and MOST_CELLS."""
        rows = vectors.where(WHOLE).where("doc_id is not null").select("doc_id", "embedding")
        n = rows.count()
        wanted = cells or min(max(8, int(4 * math.sqrt(n))), MOST_CELLS)
        share = rows if n <= sample else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < (1 << 20) * sample // n)
        size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        units = share.select(F.col("doc_id").alias("id"), F.transform("embedding", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0)).alias("v"))
        place = f"{self.folder}/train-{uuid.uuid4().hex}"
        units.write.parquet(place)
        centroids = train(self.spark.read.schema(units.schema).parquet(place), min(wanted, MOST_CELLS), rounds)
        self.log.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(place), True)
        name = f"centroids-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(i, v) for i, v in enumerate(centroids.tolist())], "cell int, v array<double>").coalesce(1).write.parquet(f"{self.folder}/{name}")
        self.log.commit(self.log.last()[0] + 1, {"centroids": name, "dimension": int(centroids.shape[1]) if len(centroids) else 0, "cells": [0] * len(centroids), "segments": [], "gone": []})
        return len(centroids)

    def _lists(self, state: dict) -> DataFrame:
        """Rows that count, with their segment's number."""
        if not state["segments"]:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, seq int").option("basePath", f"{self.folder}/lists").parquet(*[f"{self.folder}/lists/{s['name']}" for s in state["segments"]])
        if state["gone"]:
            gone = self.spark.read.schema(f"doc_id {self.id_type}, upto int").option("basePath", f"{self.folder}/gone").parquet(*[f"{self.folder}/gone/{g['name']}" for g in state["gone"]])
            gone = gone.groupBy("doc_id").agg(F.max("upto").alias("upto"))
            gone = F.broadcast(gone) if sum(g["rows"] for g in state["gone"]) <= FEW_GONE else gone
            rows = rows.join(gone, "doc_id", "left").where("upto is null or seq >= upto").drop("upto")
        return rows.drop("seq")

    def vectors(self) -> DataFrame:
        return self._lists(self._state()[1])

    def _kill(self, ids: DataFrame, number: int, state: dict) -> tuple[dict | None, np.ndarray]:
        """A deletion entry for the ids that are in the index, and how many each cell loses."""
        lost = np.zeros(len(state["cells"]), np.int64)
        if not state["segments"]:
            return None, lost
        name = f"upto={number}/writer={uuid.uuid4().hex}"
        self._lists(state).select("doc_id", "cell").join(ids.distinct(), "doc_id", "left_semi").write.parquet(f"{self.folder}/gone/{name}")
        for cell, n in self.spark.read.schema("cell int").parquet(f"{self.folder}/gone/{name}").groupBy("cell").count().collect():
            lost[cell] = n
        return ({"name": name, "rows": int(lost.sum()), "upto": number} if lost.any() else None), lost

    def add(self, vectors: DataFrame) -> int:
        """Add or replace vectors (doc_id, embedding, and doc_level and language_code or not); how many.  Of rows of one id the
        last in the frame counts."""
        top, state = self._state()
        number, have = top + 1, set(vectors.columns)
        extra = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("doc_level", "language_code")]
        rows = vectors.where(WHOLE).where((F.col("doc_id").isNotNull()) & (F.size("embedding") == state["dimension"]))
        rows = rows.select(F.col("doc_id").cast(self.id_type), *extra, F.col("embedding").cast("array<float>"), F.monotonically_increasing_id().alias("at"))
        rows = rows.groupBy("doc_id").agg(F.max_by(F.struct("doc_level", "language_code", "embedding"), "at").alias("x")).select("doc_id", "x.*")
        name = f"seq={number}/writer={uuid.uuid4().hex}"
        made = rows.mapInArrow(_assign(self._centroids(state)), self.schema)
        # a large cell is dealt to several tasks
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, parts // max(1, len(state["cells"])))))
        made.repartition(parts, "cell", salt).sortWithinPartitions("cell", "doc_id").write.partitionBy("cell").parquet(f"{self.folder}/lists/{name}")
        own = self.spark.read.schema(f"doc_id {self.id_type}, cell int").parquet(f"{self.folder}/lists/{name}")
        new = np.zeros(len(state["cells"]), np.int64)
        for cell, n in own.groupBy("cell").count().collect():
            new[cell] = n
        if not new.any():
            return 0
        gone, lost = self._kill(own.select("doc_id"), number, state)
        cells = (np.array(state["cells"], np.int64) + new - lost).tolist()
        self.log.commit(number, state | {"segments": [*state["segments"], {"name": name, "seq": number}], "gone": [*state["gone"], *([gone] if gone else [])], "cells": cells})
        return int(new.sum())

    def remove(self, ids: DataFrame) -> int:
        """Remove the vectors of these ids (doc_id); how many there were."""
        top, state = self._state()
        gone, lost = self._kill(ids.select(F.col("doc_id").cast(self.id_type)), top + 1, state)
        if gone:
            self.log.commit(top + 1, state | {"gone": [*state["gone"], gone], "cells": (np.array(state["cells"]) - lost).tolist()})
        return int(lost.sum())

    def compact(self) -> None:
        """One segment without deletions; the files it replaces are deleted."""
        top, state = self._state()
        name, path = f"seq={top + 1}/writer={uuid.uuid4().hex}", self.spark._jvm.org.apache.hadoop.fs.Path
        self._lists(state).repartition("cell").sortWithinPartitions("cell", "doc_id").write.partitionBy("cell").parquet(f"{self.folder}/lists/{name}")
        self.log.commit(top + 1, state | {"segments": [{"name": name, "seq": top + 1}] if any(state["cells"]) else [], "gone": []})
        for kind, entries in (("lists", state["segments"]), ("gone", state["gone"])):
            for x in entries:
                self.log.fs.delete(path(f"{self.folder}/{kind}/{x['name']}"), True)

    def tune(self, recall: float = 0.97, k: int = 10, sample: int = 300) -> int:
        """Set how many lists a search visits by default: the fewest with which about ``sample`` of the stored vectors, as
        queries, find that share of their exact k best."""
        top, state = self._state()
        every = self._lists(state)
        queries = every.orderBy(F.xxhash64("doc_id", F.lit("tune")), "doc_id").limit(sample).select(F.col("doc_id").alias("query_id"), "embedding")
        exact = self.search(queries, k, probes=len(state["cells"])).select("query_id", "doc_id")
        # sample * k rows and sample vectors
        cells = exact.join(every.select("doc_id", "cell"), "doc_id").select("query_id", "cell").toArrow()
        asked = queries.toArrow()
        centroids, m = self._centroids(state), _unit(matrix(asked.column("embedding")))
        order = np.argsort((centroids * centroids).sum(1)[None] - 2 * m @ centroids.T, axis=1, kind="stable")
        rank = {q: {c: i for i, c in enumerate(o)} for q, o in zip(asked.column("query_id").to_pylist(), order.tolist(), strict=True)}
        depth = sorted(rank[q][c] for q, c in zip(cells.column("query_id").to_pylist(), cells.column("cell").to_pylist(), strict=True))
        probes = depth[max(0, math.ceil(recall * len(depth)) - 1)] + 1 if depth else 1
        self.log.commit(top + 1, state | {"probes": probes})
        return probes

    def stats(self) -> dict:
        _, state = self._state()
        return {"vectors": sum(state["cells"]), "cells": len(state["cells"]), "largest": max(state["cells"], default=0), "segments": len(state["segments"]), "removed": sum(g["rows"] for g in state["gone"])}

    # --- search

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, level: str | None = None, language: str | None = None, quantised: bool = False, multiple: int = 4, least: float | None = None) -> DataFrame:
        """queries (query_id, embedding) to (query_id, doc_id, score, rank) by cosine, over the ``probes`` nearest lists of each
        (by default what ``tune`` found, else a quarter of all), of one level or language if asked; scores under ``least`` go."""
        _, state = self._state()
        kinds = [queries.schema["query_id"].dataType, self.spark.createDataFrame([], self.schema).schema["doc_id"].dataType]
        result = StructType([StructField("query_id", kinds[0]), StructField("doc_id", kinds[1]), StructField("score", DoubleType())])
        cells = np.array(state["cells"], np.int64)
        if not cells.any():
            return top_k(self.spark.createDataFrame([], result), k)
        arrow = [to_arrow_type(t) for t in kinds]
        hot = np.maximum(1, -(-cells // HOT_ROWS))
        probes = min(len(cells), probes or state.get("probes") or -(-len(cells) // 4))
        asked = queries.where(WHOLE).where(F.size("embedding") == state["dimension"]).select("query_id", "embedding")
        ids, name = (t.simpleString() for t in kinds)
        pairs = asked.mapInArrow(_probe(self._centroids(state), probes, hot), f"cell int, part int, query_id {ids}, q binary")
        # written, as it is read for the cells and for the join
        place = f"{self.folder}/asked-{uuid.uuid4().hex}"
        pairs.write.parquet(place)
        pairs = self.spark.read.schema(pairs.schema).parquet(place)
        wanted = [r[0] for r in pairs.select("cell").distinct().collect()]  # as many numbers as there are cells, at most
        rows = self._lists(state).where(F.col("cell").isin(wanted))
        rows = rows if level is None else rows.where(F.col("doc_level") == level)
        rows = rows if language is None else rows.where(F.col("language_code") == language)
        block = f"cell int, part int, ids array<{{}}>, data binary"
        left = pairs.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_pack(QUERY_ROWS, None, arrow[0]), block.format(ids))

        def met(column: DataFrame, most: int, bits: int | None) -> DataFrame:
            right = column.mapInArrow(_pack(LIST_ROWS, hot, arrow[1]), block.format(name)).withColumnsRenamed({"ids": "own", "data": "of"})
            both = left.join(right.hint("merge"), ["cell", "part"]).select("ids", "data", "own", "of", "cell")
            made = StructType([*result.fields, right.schema["cell"]])
            return both.mapInArrow(_meet(most, bits, arrow), made)

        if not quantised:
            plain = rows.select("cell", "doc_id", "embedding").mapInArrow(_bytes, f"cell int, doc_id {name}, data binary")
            found = met(plain, k, None)
        else:
            near = top_k(met(rows.select("cell", "doc_id", F.col("code").alias("data")), k * multiple, state["dimension"]), k * multiple)
            both = near.select("query_id", "doc_id", "cell").join(rows.select("cell", "doc_id", "embedding"), ["cell", "doc_id"]).join(asked.withColumnRenamed("embedding", "q"), "query_id")
            found = both.select("query_id", "doc_id", _cosine(F.col("embedding"), F.col("q")).alias("score"))
        best = top_k(found.select("query_id", "doc_id", "score"), k)
        return best if least is None else best.where(F.col("score") >= least)


def _cosine(a: F.Column, b: F.Column) -> F.Column:
    from lodestone.functions.vector import dot, norm

    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
