"""Joins of the members of a key without all pairs: stars, then blocks of what stars leave.

Members of a key are compared with the key's centre (as many pairs as rows).  Where a
member isn't in the component of its key's centre it is a stray; strays are compared
with the members of that component's keys, a block of strays with a block of members in a
task, so that comparisons never become rows.  Sets (row, size in bytes, own, ...) hold what
is compared; about TASK bytes of them meet in a task at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle

TASK = 8 << 20

Compare = Callable[[pa.Table, pa.Table], pa.Table]


def centres(slim: DataFrame) -> DataFrame:
    """(key, first) of (row, key, members): the row whose keys have the most members."""
    weight = slim.groupBy("row").agg(F.sum("members").alias("weight"))
    chosen = slim.join(weight, "row").groupBy("key").agg(F.min(F.struct(-F.col("weight"), "row")).alias("c"))
    return chosen.select("key", F.col("c.row").alias("first"))


def _met(left: DataFrame, right: DataFrame, f: Compare, schema: str) -> DataFrame:
    """f over the rows of either side of each bucket."""
    left, right = (t.toDF(*t.columns) for t in (left, right))  # columns of their own
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(f, schema)


def _buckets(rows: DataFrame) -> int:
    """How many buckets of about TASK bytes the rows fill."""
    return max(1, -(-int(rows.agg(F.sum("size")).first()[0] or 0) // TASK))


def star(pairs: DataFrame, sets: DataFrame, f: Compare, schema: str) -> DataFrame:
    """f of pairs (bucket, a, b, own of b) and centres (bucket, a, own), from pairs (a, b, size of b).

    A centre's pairs are dealt to as many parts as their sets need; it goes to each once."""
    parts = settle(pairs.groupBy("a").agg(F.ceil(F.sum("size") / TASK).cast("int").alias("parts")))
    bucket = F.pmod(F.xxhash64("a", "part"), F.lit(_buckets(pairs))).alias("bucket")
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", bucket)
    left = dealt.join(sets.select(F.col("row").alias("b"), "own"), "b").select("bucket", "a", "b", "own")
    right = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("a", bucket).distinct()
    right = right.join(sets.select(F.col("row").alias("a"), "own"), "a").select("bucket", "a", "own")
    out = settle(_met(left, right, f, schema))
    release(parts)
    return out


def placed(banded: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, row, root, grp) of banded (key, row, first): the roots of the row and of the centre."""
    rows = banded.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    rows = rows.join(roots.toDF("first", "grp"), "first", "left")
    return settle(rows.select("key", "row", "root", F.coalesce("grp", "first").alias("grp")))


def strays(at: DataFrame, sets: DataFrame, f: Compare, schema: str) -> DataFrame:
    """f of blocks of strays and of members (bucket, grp, i, j, root, stray, columns of sets), from placed rows."""
    alone = at.where("root != grp")
    mixed = at.join(alone.select("key").distinct(), "key", "left_semi").select("grp", "row", "root").distinct()
    rows = settle(mixed.join(sets.select("row", "size"), "row").withColumn("stray", F.expr("root != grp")))
    blocks = lambda size: F.ceil(F.sum(size) / TASK).cast("int")
    counted = rows.groupBy("grp").agg(blocks(F.col("size")).alias("jj"), blocks(F.when(F.col("stray"), F.col("size"))).alias("ii"))
    dealt = rows.join(counted, "grp")
    turn = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["grp", "i", "j", "row", "root", "stray", "size"]
    x = settle(dealt.where("stray").withColumn("i", turn("ii")).withColumn("j", every("jj")).select(*names))
    y = settle(dealt.withColumn("j", turn("jj")).withColumn("i", every("ii")).select(*names))
    bucket = F.pmod(F.xxhash64("grp", "i", "j"), F.lit(_buckets(x.select("size").union(y.select("size"))))).alias("bucket")
    left, right = (t.select("*", bucket).join(sets.drop("size"), "row") for t in (x, y))
    out = settle(_met(left, right, f, schema))
    release(rows, x, y)
    return out


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def blocks(strays: pa.Table, members: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The blocks that meet, of those in a bucket."""

    def cut(t: pa.Table) -> dict[tuple, pa.Table]:
        t = t.sort_by([("grp", "ascending"), ("i", "ascending"), ("j", "ascending")])
        v = np.stack([numbers(t[c]).astype(np.int64) for c in ("grp", "i", "j")])
        edge = [0, *(np.flatnonzero((v[:, 1:] != v[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        return {tuple(v[:, a].tolist()): t.slice(a, b - a) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a}

    other = cut(members)
    for k, x in cut(strays).items():
        if k in other:
            yield x, other[k]


class Joined:
    """Which components links have joined within a task."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, r: int) -> int:
        while r in self.above:
            r = self.above[r]
        return r

    def join(self, a: int, b: int) -> bool:
        """Whether a and b weren't joined before."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b
