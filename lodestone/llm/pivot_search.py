"""Operator 2: exact top-k by inner product with a pivot-distance index.

Vectors become integers, floor(64 * x).  One further component, sqrt(M - |x|^2) with M the
largest square length (0 for queries), turns the largest inner product into the least
Euclidean distance, so that the triangle inequality holds: d(q, x) >= |d(q, p) - d(x, p)|.

1. Each vector is keyed by its nearest of ``PIVOTS`` pivots (a sample by hash) and its
   distance to it; sorted by both, vectors are cut into blocks, annuli around pivots.
   A hot pivot has many blocks.  Every row is indexed.
2. Queries are put into blocks likewise.  First each query meets the annuli nearest to it
   that hold k others; its k-th best score is a bound.
3. Then annuli are taken whose least possible distance may still reach that bound; a
   pair of blocks is scored by one matrix product, and only k rows a query leave it.

The block list holds a pivot, two distances and a count for each block, and blocks grow
so that it never has more than about ``MOST_BLOCKS`` lines: that is what tasks are given.

Vectors that are null, empty or hold null or non-finite components take no part; nor do
null ids.  Vectors of several lengths, and those too long for exact scores (a square
length of integers of 2**53 or more), are an error.  Rows of the query's own id aren't
its candidates.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Blocks, only, settle

PIVOTS, MOST_BLOCKS, BLOCK_ROWS, QUERY_ROWS = 128, 1 << 18, 2048, 512


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id long, v array<int>) of the rows that take part."""
    rows = only(df, id=id_col, v=vec_col).where("id is not null and size(v) > 0")
    x = F.transform("v", lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.where(fine)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.pow(F.floor(c.cast("double") * scale).cast("double"), F.lit(2.0)))
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(square).alias("square")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors have lengths from {sizes['least']} to {sizes['most']}")
    if (sizes["square"] or 0) >= 1 << 53:
        raise ValueError("a vector's square length is beyond exact scores")
    return rows.select(F.col("id").cast("long"), x.cast("array<int>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _raised(m: np.ndarray, most: float) -> np.ndarray:
    """With the further component of vectors that are searched."""
    return np.hstack((m, np.sqrt(np.maximum(0, most - (m * m).sum(1)))[:, None]))


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * m @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assign(pivots: np.ndarray, most: float, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                d = _distances(np.hstack((m, np.zeros((len(m), 1)))) if query else _raised(m, most), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(m)), cell]), batch.column(0), batch.column(1)], names=["cell", "r", "id", "v"])

    return run


def _pack(size: int, cells: bool):
    """Consecutive rows, of one cell if ``cells``, as blocks of up to ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept = Blocks(), []

        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            r = t.column("r").to_numpy()
            v = _matrix(t.column("v").combine_chunks()).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([block()], pa.int64()), pa.array([t.column("cell")[0].as_py()], pa.int32()), pa.array([r.min()]), pa.array([r.max()]), pa.array([len(r)], pa.int64()), pa.array([t.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                names=["block", "cell", "low", "high", "n", "ids", "v"],
            )

        for batch in batches:
            cell = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)] if cells else [0, len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while a < b:
                    if kept and cells and kept[0].column(0)[0].as_py() != cell[a]:
                        yield out(kept)
                        kept = []
                    take = min(b - a, size - sum(x.num_rows for x in kept))
                    kept.append(batch.slice(a, take))
                    a += take
                    if sum(x.num_rows for x in kept) == size:
                        yield out(kept)
                        kept = []
        if kept:
            yield out(kept)

    return run


BLOCK = "block long, cell int, low double, high double, n long, ids binary, v binary"


def _blocks(rows: DataFrame, size: int, cells: bool) -> DataFrame:
    # by id as well, so that equal vectors don't meet in one task
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return settle(rows.repartitionByRange(parts, "cell", "r", "id").sortWithinPartitions("cell", "r", "id").mapInArrow(_pack(size, cells), BLOCK))


def _choose(meta: np.ndarray, pivots: np.ndarray, most: float, k: int, bounded: bool):
    """Which data blocks the queries of a block meet: the nearest with k others at first,
    then (bounded) the rest of those that may hold a score not under the query's bound."""
    block, cell, low, high, n = meta["block"], meta["cell"], meta["low"], meta["high"], meta["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = np.frombuffer(row["v"], np.int32).reshape(row["n"], -1).astype(np.float64)
                to_pivot = _distances(np.hstack((m, np.zeros((len(m), 1)))), pivots)
                square = (m * m).sum(1)
                wanted = np.zeros((len(m), len(block)), dtype=bool)
                bound = dict(row["bounds"] or []) if bounded else {}
                ids = np.frombuffer(row["ids"], np.int64)
                for i in range(len(m)):
                    d = to_pivot[i][cell]
                    least = np.maximum(0, np.maximum(d - high, low - d))
                    order = np.argsort(least, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1
                    first = order[:enough]
                    if bounded:
                        # slack for rounding in distances: a relative millionth and one
                        best = (square[i] + most - least * least) / 2
                        wanted[i] = best * (1 + 1e-6) + 1 >= bound.get(int(ids[i]), -np.inf)
                        wanted[i, first] = False
                    else:
                        wanted[i, first] = True
                for j in np.flatnonzero(wanted.any(0)).tolist():
                    which = np.flatnonzero(wanted[:, j]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([int(block[j])], pa.int64()), pa.array([ids[which].tobytes()], pa.binary()), pa.array([m[which].astype(np.int32).tobytes()], pa.binary())], names=["block", "q_ids", "q"])

    return run


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["q"], np.int32).reshape(len(q_ids), -1).astype(np.float64)
                m = np.frombuffer(row["v"], np.int32).reshape(len(ids), -1).astype(np.float64)
                order = np.argsort(ids, kind="stable")
                ids, score = ids[order], (q @ m[order].T).astype(np.int64)
                # ids ascend, so a stable sort leaves ties to the smaller
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1 + int(np.unique(ids, return_counts=True)[1].max())]
                value, found = np.take_along_axis(score, best, 1).reshape(-1), ids[best].reshape(-1)
                asked = np.repeat(q_ids, best.shape[1])
                keep = asked != found
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (asked, found, value)], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = 64, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of ``vectors`` for each row of
    ``queries``, both with columns ``id_col`` and ``vec_col``."""
    spark = vectors.sparkSession
    rows, asked = whole_vectors(vectors, id_col, vec_col, scale), whole_vectors(queries, id_col, vec_col, scale)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    fact = rows.agg(F.count("*").alias("n"), F.max(square).alias("most")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not fact["n"]:
        return empty
    most = float(fact["most"])
    chosen = rows.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(pivots).select("v").toPandas()["v"]
    points = _raised(np.array(chosen.tolist(), dtype=np.float64), most)
    schema = "cell int, r double, id long, v array<int>"
    size = max(block_rows, -(-fact["n"] // MOST_BLOCKS))
    data = _blocks(rows.mapInArrow(_assign(points, most, False), schema), size, True)
    ask = _blocks(asked.mapInArrow(_assign(points, most, True), schema), QUERY_ROWS, False)
    # at most about MOST_BLOCKS lines of five numbers
    meta = data.select("block", "cell", "low", "high", "n").toPandas().to_records(index=False)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def scored(pairs: DataFrame) -> DataFrame:
        made = pairs.join(data.select("block", "ids", "v"), "block").select("q_ids", "q", "ids", "v").mapInArrow(_score(k), "query_id long, vec_id long, score long")
        return made.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    pair = "block long, q_ids binary, q binary"
    near = settle(scored(ask.mapInArrow(_choose(meta, points, most, k, False), pair)))
    bound = near.where(F.col("rank") == k).select("query_id", "score")
    member = ask.select("block", F.expr("explode(transform(sequence(0, n - 1), i -> reverse(substring(ids, cast(8 * i + 1 as int), 8)))) as raw"))
    member = member.select("block", F.conv(F.hex("raw"), 16, -10).cast("long").alias("query_id"))
    bounds = member.join(bound, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("bounds"))
    asking = ask.join(bounds.select("block", F.map_from_entries("bounds").alias("bounds")), "block", "left")
    rest = scored(asking.mapInArrow(_choose(meta, points, most, k, True), pair))
    found = near.drop("rank").unionByName(rest.drop("rank")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
