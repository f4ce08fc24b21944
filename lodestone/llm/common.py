"""Small helpers of the operators: column choice, shared folder, hashing, batches."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns alone, as new name=column; of columns of equal name the first.

    Operators begin with this, so that other columns, whatever their names, can't clash
    with those they add."""
    lower = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(lower))])
    return plain.select(*[F.col(f"c{lower.index(old.lower())}").alias(new) for new, old in wanted.items()])


def held_out(column: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/lodestone-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: With it the shuffle files of a written step are deleted as soon as the step stands.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and
    lost executors cost no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pack(*parts: object) -> bytes:
    """Arrays in their least unsigned type, and other values, compressed."""
    small = [p.astype(np.min_scalar_type(p.max(initial=0))) if isinstance(p, np.ndarray) and p.dtype.kind in "iu" and p.min(initial=0) >= 0 else p for p in parts]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(small, protocol=5))


def unpack(blob: bytes) -> list:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f over every Arrow batch. Batches may differ between attempts; f must not mind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


class Blocks:
    """Numbers for blocks of rows, distinct between tasks and equal in each attempt of one."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def __call__(self) -> int:
        self.next += 1
        return self.next - 1
