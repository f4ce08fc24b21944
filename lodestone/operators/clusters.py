"""K-means in rounds of Spark jobs: tasks sum their vectors by nearest centroid, the sums meet by centroid.

Only centroids pass through the driver: ``k`` of them, a number that the caller bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to centroids."""
    square = (m * m).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * m @ centroids.T
    return np.sqrt(np.maximum(square, 0))


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0))
                cell = distances(m, centroids).argmin(1)
                order = np.argsort(cell, kind="stable")
                own, first = np.unique(cell[order], return_index=True)
                total[own] += np.add.reduceat(m[order], first, axis=0)
                count += np.bincount(cell, minlength=len(centroids))
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array([x.tobytes() for x in total[used]], pa.binary())], names=["cell", "n", "sum"])

    return run


def _added(table: pa.Table) -> pa.Table:
    # in a fixed order, so that sums of doubles don't depend on the order of arrival
    parts = sorted(table.column("sum").to_pylist())
    n = sum(table.column("n").to_pylist())
    mean = np.sum([np.frombuffer(x) for x in parts], axis=0) / n
    return pa.table({"cell": table.column("cell").slice(0, 1), "mean": pa.array([mean.tobytes()], pa.binary())})


def train(rows: DataFrame, k: int, rounds: int = 8, column: str = "v", order: str = "id") -> np.ndarray:
    """Up to ``k`` centroids of ``rows`` (a column of vectors of one length and one to start by), as a matrix.

    It starts from k rows by a hash of ``order``; a centroid that loses all its rows stays where it is.
    Each round reads the rows once: give it a table, or a bounded sample of one."""
    start = rows.orderBy(F.xxhash64(F.col(order), F.lit("centroid")), order).limit(k).select(column).toArrow()
    if not start.num_rows:
        return np.zeros((0, 0))
    centroids = np.unique(matrix(start.column(0)), axis=0)
    for _ in range(rounds):
        sums = rows.select(column).mapInArrow(_sums(centroids), "cell int, n long, sum binary")
        found = sums.groupBy("cell").applyInArrow(_added, "cell int, mean binary").toArrow()
        moved = centroids.copy()
        for cell, mean in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            moved[cell] = np.frombuffer(mean)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids
