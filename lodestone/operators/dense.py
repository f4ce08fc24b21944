"""Dense retrieval: exact top-k in blocks of queries, and the quantised two-stage search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions.vector import dot, int8, norm
from lodestone.operators.sparse import DECIMALS, TILE, best, top_k

BLOCK = 2048
#: Vectors that are compared: neither null nor empty nor with null components.
WHOLE = "size(embedding) > 0 and forall(embedding, x -> x is not null)"


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Query ids and unit vectors, a bounded block at a time."""
    rows = queries.where(WHOLE).select("query_id", "embedding")
    few = rows.limit(BLOCK + 1).toArrow()
    ids, vectors = [], []
    for r in few.to_pylist() if few.num_rows <= BLOCK else (r.asDict() for r in rows.coalesce(1).toLocalIterator()):
        if vectors and len(r["embedding"]) != len(vectors[0]):
            yield ids, np.array(vectors, dtype=np.float64)
            ids, vectors = [], []
        ids.append(r["query_id"])
        vectors.append(r["embedding"])
        if len(ids) == BLOCK:
            yield ids, np.array(vectors, dtype=np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, dtype=np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _search(ids: list, queries: np.ndarray, k: int, binary: bool, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(ids, kinds[0])
        q = np.where(queries > 0, 1.0, -1.0) if binary else _unit(queries)
        for batch in batches:
            if not batch.num_rows:
                continue
            # by id, so that places tell which of equal scores comes first, whatever the type of ids
            order = pc.sort_indices(batch.column(0))
            doc, m = batch.column(0).take(order), _matrix(batch.column(1))[order.to_numpy()]
            m = np.where(m > 0, 1.0, -1.0) if binary else _unit(m)
            # as many scores at once whatever the number of queries
            step, kept = max(64, TILE // len(ids)), []
            for lo in range(0, len(doc), step):
                score = q @ m[lo : lo + step].T
                # as binary: agreeing less differing signs, so that the distance is (d - score) / 2
                score = -(q.shape[1] - score) / 2 if binary else score
                row, column = best(score, k)
                kept.append((row, column + lo, score[row, column]))
            row, column, score = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((column, -np.round(score, DECIMALS), row))
            row, column, score = row[order], column[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(row[first])), doc.take(pa.array(column[first])), pa.array(score[first])], names=["query_id", "doc_id", "score"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, binary: bool = False, least: float | None = None) -> DataFrame:
    """vectors (doc_id, embedding), queries (query_id, embedding) to (query_id, doc_id,
    score, rank) by cosine, 0 where a norm is 0; binary: by minus the Hamming distance of
    signs.  Scores under ``least`` go.  Vectors of another length than a query's, and
    those with null components, aren't its candidates.  Each batch keeps its k best, so little
    more than the result is shuffled."""
    rows = vectors.where(WHOLE).select("doc_id", "embedding")
    made = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", rows.schema["doc_id"].dataType), StructField("score", DoubleType())])
    kinds = to_arrow_type(made["query_id"].dataType), to_arrow_type(made["doc_id"].dataType)
    parts = [rows.where(F.size("embedding") == q.shape[1]).mapInArrow(_search(ids, q, k, binary, kinds), made) for ids, q in _blocks(queries)]
    if not parts:
        parts = [rows.sparkSession.createDataFrame([], made)]
    found = top_k(reduce(DataFrame.unionByName, parts), k)
    return found if least is None else found.where(F.col("score") >= least)


def similarity(distance: F.Column, metric: str) -> F.Column:
    """A distance of an index as similarity, by its metric: cosine, l2 or ip."""
    return {"cosine": 1 - distance, "l2": 1 / (1 + distance), "ip": -distance}[metric]


def two_stage(vectors: DataFrame, queries: DataFrame, k: int = 10, multiple: int = 4, ranges: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """Candidates by sign bits, k * multiple a query, rescored by the full cosine; or, with
    the components' ``ranges`` (pos, lo, hi), by the dot product with the eight-bit copies of those
    that lie in them, as a store of quantised copies has them."""
    found = dense(vectors, queries, k * multiple, binary=True).select("query_id", "doc_id")
    wide = found.join(vectors.select("doc_id", "embedding"), "doc_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    if ranges is None:
        both = norm(F.col("embedding")) * norm(F.col("q"))
        score = F.when(both == 0, 0.0).otherwise(dot(F.col("embedding"), F.col("q")) / both)
    else:
        # one row by construction: the two arrays of all components' bounds
        ordered = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
        bounds = ranges.agg(ordered.alias("r")).select(F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
        wide = wide.crossJoin(F.broadcast(bounds))
        score = dot(int8(F.col("embedding"), F.col("lo"), F.col("hi")), F.col("q"))
    out = top_k(wide.select("query_id", "doc_id", score.alias("score")), k)
    return out if least is None else out.where(F.col("score") >= least)


def int8_ranges(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
