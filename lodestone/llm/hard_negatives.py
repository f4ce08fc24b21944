"""Operator 12: hard negatives from inverted lists of k-means clusters.

Vectors become integers, floor(scale * x).  Their clusters' centroids are trained by Spark rounds on a sample of about ``SAMPLE``
rows (all, if fewer), and every row is put into the list of its nearest centroid.  A list is cut, by distance
to the centroid, into blocks of up to ``BLOCK_ROWS`` rows, each with the largest distance in it, its radius.

By Cauchy-Schwarz no row of a block scores more than q.c + |q| r with a query q, or less than q.c - |q| r.

1. Positives: each anchor visits blocks from the highest upper bound on until they hold enough rows of its label; its
   k-th score then tells which of the others are visited: those whose bound isn't strictly below it.
2. Negatives: each positive's score gives a window.  Blocks outside the window, by both bounds, are skipped, else the visit goes the
   same way.  All windows of an anchor share one matrix product a block.

An anchor goes to a block with its vector and windows; scores stay in the task but for k rows a window.

Rows with a null label, vector or id, or a null or non-finite component, take no part.  A vector shorter than the longest counts as
filled up with zeros.  Rows of one id are rows of their own; none is a candidate of an anchor of its id, and each anchor row
has its own result.  Scores are exact: in doubles while squares of lengths stay under 2**53, else in 64-bit integers; beyond
2**63 is an error.  Labels are whole numbers.  Ties go to the smaller id.  Other columns don't matter, whatever their names.
Empty tables, and anchors without positives, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.clusters import distances, matrix, train

from .common import Blocks, only, settle

CLUSTERS, SAMPLE, BLOCK_ROWS, ANCHOR_ROWS, MOST_BLOCKS = 256, 50_000, 2048, 256, 1 << 18
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v array<long>) of the rows that take part."""
    rows = only(df, id=id_col, label=label_col, v=vec_col).where("id is not null and label is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col("id").cast("long"), F.col("label").cast("long"), F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column(2)), centroids)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), *batch.columns], names=["cell", "r", "id", "label", "v"])

    return run


def _lists(size: int, kind: np.dtype):
    """Consecutive rows of a cell as blocks of up to ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = Blocks(), [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = t.column("v").combine_chunks()
            bytes_of = lambda name: t.column(name).to_numpy().astype("<i8").tobytes()
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([block()], pa.int64()), pa.array([t.column("cell")[0].as_py()], pa.int32()), pa.array([t.column("r").to_numpy().max()]), pa.array([t.num_rows], pa.int64()), *[pa.array([x], pa.binary()) for x in (bytes_of("id"), bytes_of("label"), flat)]],
                names=["block", "cell", "reach", "n", "ids", "labels", "v"],
            )

        for batch in batches:
            cell = batch.column(0).to_numpy()
            at = 0
            while at < len(cell):
                if held and (held[0].column(0)[0].as_py() != cell[at] or rows == size):
                    yield out()
                    held, rows = [], 0
                own = int(np.searchsorted(cell, cell[at], side="right"))
                take = min(own - at, size - rows)
                held.append(batch.slice(at, take))
                rows += take
                at += take
        if held:
            yield out()

    return run


def _vectors(batch: pa.RecordBatch | pa.Table, exact: bool) -> np.ndarray:
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64 if exact else np.float64).reshape(len(column), -1)


def _choose(meta: dict[str, np.ndarray], centroids: np.ndarray, kind: np.dtype, first: int, bounded: bool):
    """For each anchor, the blocks it visits: at first those of the highest bounds, with ``first`` rows;
    when bounded, the others that a window may still gain from."""
    cell, reach, n, number = meta["cell"], meta["reach"], meta["n"], meta["block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo_row in range(0, whole.num_rows, ANCHOR_ROWS):
                batch = whole.slice(lo_row, ANCHOR_ROWS)
                v = _vectors(batch, False)
                middle, width = (v @ centroids.T)[:, cell], np.sqrt((v * v).sum(1))[:, None] * reach[None]
                # room for rounding
                width = width + 1e-6 * (np.abs(middle) + width) + 1
                upper, lower = middle + width, middle - width
                low, high, bound = (batch.column(x).to_pylist() for x in ("low", "high", "bound"))
                wanted = np.zeros(upper.shape, dtype=bool)
                for i in range(batch.num_rows):
                    for a, b, least in zip(low[i], high[i], bound[i] or [None] * len(low[i]), strict=True):
                        open_ = np.flatnonzero((upper[i] >= a) & (lower[i] <= b))
                        order = open_[np.argsort(-upper[i][open_], kind="stable")]
                        visited = order[: int(np.searchsorted(np.cumsum(n[order]), first)) + 1]
                        if bounded:
                            rest = order[len(visited) :]
                            wanted[i, rest if least is None else rest[upper[i][rest] >= least]] = True
                        else:
                            wanted[i, visited] = True
                v = v.astype(kind)
                wide = max(map(len, low), default=0)
                # an empty window where an anchor has fewer than others
                edges = np.array([[*x, *[HIGH] * (wide - len(x)), *y, *[LOW] * (wide - len(y))] for x, y in zip(low, high, strict=True)], dtype="<i8")
                head = np.stack([batch.column(x).to_numpy() for x in ("key", "id", "label")], axis=1).astype("<i8")
                for j in np.flatnonzero(wanted.any(0)).tolist():
                    who = np.flatnonzero(wanted[:, j])
                    yield pa.RecordBatch.from_arrays([pa.array([int(number[j])], pa.int64()), *[pa.array([x[who].tobytes()], pa.binary()) for x in (head, edges, v)]], names=["block", "head", "edges", "q"])

    return run


def _score(k: int, same: bool, kind: np.dtype, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.int64 if exact else np.float64
        for batch in batches:
            for row in batch.to_pylist():
                head = np.frombuffer(row["head"], "<i8").reshape(-1, 3)
                edges = np.frombuffer(row["edges"], "<i8").reshape(len(head), 2, -1)
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], labels[order]
                q = np.frombuffer(row["q"], kind).reshape(len(head), -1).astype(number)
                m = np.frombuffer(row["v"], kind).reshape(len(ids), -1).astype(number)[order]
                score = (q @ m.T).astype(np.int64)
                fits = (labels[None] == head[:, 2:3]) == same
                fits &= ids[None] != head[:, 1:2]
                key, window, found, value = [], [], [], []
                for i in range(len(head)):
                    may = np.flatnonzero(fits[i])
                    own = score[i][may]
                    # ids ascend, so a stable sort leaves ties to the smaller
                    by = np.argsort(-own, kind="stable")
                    may, falling = may[by], -own[by]
                    for w in range(edges.shape[2]):
                        a, b = edges[i, 0, w], edges[i, 1, w]
                        begin = 0 if b == HIGH else int(np.searchsorted(falling, -b, side="left"))
                        end = len(may) if a == LOW else int(np.searchsorted(falling, -a, side="right"))
                        if b == LOW or end <= begin:
                            continue
                        take = slice(begin, min(end, begin + k))
                        found.append(ids[may[take]])
                        value.append(-falling[take])
                        key.append(np.full(len(found[-1]), head[i, 0]))
                        window.append(np.full(len(found[-1]), w, dtype=np.int32))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, window, found, value)], names=["key", "w", "id", "score"])

    return run


class InvertedLists:
    """All rows in lists of clusters, and the search for an anchor's k best in windows of scores."""

    def __init__(self, rows: DataFrame, clusters: int, sample: int, block_rows: int) -> None:
        spark = rows.sparkSession
        fact = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("square"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
        self.n, self.d = fact["n"], max(1, fact["d"])
        if (fact["square"] or 0) >= 2.0**63:
            raise ValueError("scores don't fit 64-bit integers")
        self.exact = (fact["square"] or 0) >= 2.0**53
        self.kind = np.dtype("<i2" if (fact["most"] or 0) < 1 << 15 else "<i4" if (fact["most"] or 0) < 1 << 31 else "<i8")
        if not self.n:
            return
        rows = self.even(rows)
        part = rows if self.n <= sample else rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * sample / self.n)).limit(2 * sample)
        self.centroids = train(settle(part.select("id", "v")), min(clusters, max(1, self.n // 64)))
        if not len(self.centroids):
            self.centroids = np.zeros((1, self.d))
        size = max(block_rows, -(-self.n // MOST_BLOCKS))
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.mapInArrow(_assign(self.centroids), "cell int, r double, id long, label long, v array<long>").repartitionByRange(parts, "cell", "r", "id").sortWithinPartitions("cell", "r", "id")
        self.lists = settle(dealt.mapInArrow(_lists(size, self.kind), "block long, cell int, reach double, n long, ids binary, labels binary, v binary"))
        # five numbers a block, and at most about MOST_BLOCKS blocks and a few for each cell and task
        self.meta = {name: column.to_numpy() for name, column in zip(("block", "cell", "reach", "n"), self.lists.select("block", "cell", "reach", "n").toArrow().columns, strict=True)}

    def even(self, rows: DataFrame) -> DataFrame:
        """Vectors of one length, shorter ones filled up."""
        return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(self.d) - F.size("v"))))

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(key, w, rank, id, score): the k best of each window w of anchors (key, id, label, v, low, high), of
        the anchor's label or of the others."""
        order = Window.partitionBy("key", "w").orderBy(F.desc("score"), "id")

        def visited(asking: DataFrame, bounded: bool) -> DataFrame:
            pairs = asking.select("key", "id", "label", "v", "low", "high", "bound").mapInArrow(_choose(self.meta, self.centroids, self.kind, 4 * k, bounded), "block long, head binary, edges binary, q binary")
            # Spark's estimate of the pairs' size is far too small: without the hint it may broadcast them
            met = pairs.hint("merge").join(self.lists.select("block", "ids", "labels", "v"), "block").select("head", "edges", "q", "ids", "labels", "v")
            made = met.mapInArrow(_score(k, same, self.kind, self.exact), "key long, w int, id long, score long")
            return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        near = settle(visited(anchors.withColumn("bound", F.lit(None).cast("array<long>")), False))
        known = near.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("at"))
        bound = F.transform(F.sequence(F.lit(0), F.size("low") - 1), lambda w: F.try_element_at("at", w))
        rest = visited(anchors.join(known, "key", "left").withColumn("bound", bound), True)
        both = near.drop("rank").unionByName(rest.drop("rank"))
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, scale: int = 256, least_percent: int = 80, clusters: int = CLUSTERS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: a condition on ``id_col`` that tells which rows are anchors.  Their positives are the best ``positives`` other rows of
    their label; for each, the best ``negatives`` rows of other labels with least_percent * positive_score <= 100 * negative_score
    <= 100 * positive_score."""
    rows = settle(whole_numbers(vectors, id_col, vec_col, label_col, scale))
    lists = InvertedLists(rows, clusters, sample, block_rows)
    empty = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not lists.n:
        return empty
    asking = lists.even(rows.withColumn(id_col, F.col("id")).where(anchors).select("id", "label", "v"))
    asking = settle(asking.select(F.monotonically_increasing_id().alias("key"), "*"))
    every = asking.withColumns({"low": F.array(F.lit(LOW).cast("long")), "high": F.array(F.lit(HIGH).cast("long"))})
    found = settle(lists.search(every, positives, True).select("key", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    by_rank = F.array_sort(F.collect_list(F.struct("w", "positive_score")))
    windows = found.groupBy("key").agg(by_rank.alias("p"))
    # the least score in the window: a quotient rounded up
    low = F.transform("p", lambda x: F.ceil(x["positive_score"].cast("decimal(19,0)") * least_percent / 100).cast("long"))
    windows = windows.select("key", low.alias("low"), F.transform("p", lambda x: x["positive_score"]).alias("high"))
    second = lists.search(settle(asking.join(windows, "key")), negatives, False)
    out = second.select("key", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["key", "w"]).join(asking.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
