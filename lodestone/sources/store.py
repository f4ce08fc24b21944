"""Sources and the chunk store: files in, Parquet tables out, ids by content."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.keyed import KeyedTable


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints; a temporary one where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base}/lodestone-{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str = "step") -> DataFrame:
    """The rows, written to a work folder and read again: what stands before isn't computed twice."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kind, size) of the files in folders, to any depth, but those whose names begin with a dot."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    out = rows.select("path", T.file_kind(F.col("path")).alias("kind"), F.col("length").alias("size"))
    return out.where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def read_files(spark: SparkSession, paths: list[str], lower: bool = False, kinds: tuple[str, ...] = ("text", "html", "json", "document")) -> DataFrame:
    """(source_path, kind, content) of whole files: bytes that aren't UTF-8 become marks, HTML
    becomes text, white space is cleaned; empty files go.  JSON stays as it is."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    rows = rows.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).withColumn("kind", T.file_kind(F.col("path"))).where(F.col("kind").isin(*kinds))
    # a file that isn't UTF-8 is decoded with marks in place of what can't be read
    text = F.coalesce(F.expr("try_validate_utf8(cast(content as string))"), F.expr("make_valid_utf8(cast(content as string))"))
    content = F.when(F.col("kind") == "html", T.html_text(text)).when(F.col("kind") == "json", text).otherwise(T.clean(text, lower=lower))
    return rows.select(F.col("path").alias("source_path"), "kind", content.alias("content")).where("length(content) > 0")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line from 0, text) of text files, such as JSON lines."""
    rows = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True)
    cut = rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return cut


def preview(before: DataFrame, id_col: str, text_col: str, n: int = 12, most: int = 800) -> DataFrame:
    """(id, before, after) of the first rows that cleaning changes."""
    after = T.clean(F.col(text_col))
    cut = lambda c: F.substring(c, 1, most)
    return before.where(after != F.col(text_col)).orderBy(id_col).limit(n).select(id_col, cut(F.col(text_col)).alias("before"), cut(after).alias("after"))


def _json(value: Column) -> Column:
    """A JSON scalar as Python writes it."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))


def content_id(content: Column, meta: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the content, a line feed and the metadata as JSON with sorted keys; null for null.

    Without metadata of the content alone."""
    if meta is None:
        return F.sha2(content.cast("binary"), 256)
    pairs = [F.concat(F.lit(f'"{k}": '), F.when(meta[k].isNull(), "null").otherwise(_json(meta[k]))) for k in sorted(meta)]
    return F.sha2(F.concat(content, F.lit("\n{"), F.concat_ws(", ", *pairs), F.lit("}")).cast("binary"), 256)


def text_key(operation: str, query: Column, **options: object) -> Column:
    """A cache key: the operation, the query and the options by name; null for null."""
    key = F.sha2(F.concat_ws("|", F.lit(operation), query, *[F.lit(f"{k}={v}") for k, v in sorted(options.items())]).cast("binary"), 256)
    return F.when(query.isNotNull(), key)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes first in ``order``: for an upsert, the last written."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Stored rows whose keys aren't in new, and of each key in new the row that comes first in
    ``order``; without it the last in the frame."""
    if order:
        chosen = latest(new, keys, order)
    else:
        chosen = latest(new.withColumn("_at", F.monotonically_increasing_id()), keys, [F.desc("_at")]).drop("_at")
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(chosen)


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys), keys, "left_anti")


def sync_diff(store: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, side): ids of one side alone."""
    a, b = store.select(key).distinct(), index.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("store")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("index")))


def level_filter(level: str | None) -> Column:
    """doc_level by the names of levels and scopes; ``all`` takes every row, names that aren't known are ``leaves``."""
    wanted = {"parent": "parent", "parents": "parent", "all": None}.get(level or "all", "child")
    return F.col("doc_level") == wanted if wanted else F.lit(True)


def meta_filter(values: dict[str, str]) -> Column:
    """Rows whose ``meta`` (a map) has all of these values."""
    out = F.lit(True)
    for key, value in values.items():
        out &= F.coalesce(F.try_element_at("meta", F.lit(key)) == value, F.lit(False))
    return out


CHUNK = "doc_id string, content string, doc_level string, parent_id string, language_code string, embedding array<float>, meta map<string,string>"


class ChunkStore:
    """Chunks (CHUNK) in a keyed table: a change writes what it changes, readers see the state before or
    after it, and of two writers none is lost."""

    def __init__(self, spark: SparkSession, folder: str, longest: int = 200_000, **table: int) -> None:
        self.spark, self.longest = spark, longest
        self.table = KeyedTable(spark, folder, CHUNK, ["doc_id"], **table)

    def chunks(self) -> DataFrame:
        return self.table.rows()

    def _chunk(self, rows: DataFrame, level: str) -> DataFrame:
        """Rows in the store's columns: long contents are cut and marked, defaults filled in."""
        have = {c.lower() for c in rows.columns}
        col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
        meta = F.coalesce(col("meta", "map<string,string>"), F.create_map().cast("map<string,string>"))
        cut = F.length("content") > self.longest
        meta = F.when(cut, F.map_concat(F.map_filter(meta, lambda k, _: k != "truncated"), F.create_map(F.lit("truncated"), F.lit("true")))).otherwise(meta)
        return rows.select(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.substring("content", 1, self.longest).alias("content"),
            F.coalesce(col("doc_level", "string"), F.lit(level)).alias("doc_level"),
            F.coalesce(col("parent_id", "string"), F.lit("")).alias("parent_id"),
            F.coalesce(col("language_code", "string"), F.lit("en")).alias("language_code"),
            col("embedding", "array<float>").alias("embedding"),
            meta.alias("meta"),
        )

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> dict:
        """Add or replace embedded chunks; of rows of one id the last counts, by ``order`` or by place."""
        kept = latest(rows, ["doc_id"], order) if order else rows
        return self.table.upsert(self._chunk(kept, "child"))

    def upsert_documents(self, rows: DataFrame) -> dict:
        """Add or replace chunks without vectors: parents unless they say otherwise."""
        return self.table.upsert(self._chunk(rows.drop("embedding"), "parent"))

    def remove(self, ids: DataFrame) -> int:
        return self.table.delete(ids.select("doc_id"))

    def clear(self, confirm: bool = False) -> bool:
        """Empty the store, if confirmed."""
        if confirm:
            self.table.clear()
        return confirm

    def get(self, doc_id: str) -> DataFrame:
        return self.table.get(doc_id)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """ids (doc_id, ...) with their chunks, those that are there."""
        return self.table.lookup(ids)

    def ids(self, pattern: str = "*", limit: int | None = None, embedded: bool = False) -> DataFrame:
        """doc_id by a glob pattern, in order."""
        like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        rows = self.chunks().where(F.col("doc_id").like(like))
        rows = (rows.where("embedding is not null") if embedded else rows).select("doc_id")
        return rows if limit is None else rows.orderBy("doc_id").limit(limit)

    def embedded(self, ids: DataFrame) -> DataFrame:
        """(doc_id, embedded) of the asked ids."""
        have = self.chunks().where("embedding is not null").select("doc_id", F.lit(True).alias("embedded"))
        return ids.select("doc_id").distinct().join(have, "doc_id", "left").select("doc_id", F.coalesce("embedded", F.lit(False)).alias("embedded"))

    def count(self) -> int:
        return self.table.count()

    def info(self) -> dict:
        row = self.chunks().agg(F.count("*").alias("documents"), F.count("embedding").alias("embedded"), F.count_if(F.col("doc_level") == "parent").alias("parents"), F.countDistinct("language_code").alias("languages")).first()
        return row.asDict() | {"version": self.table.version()}

    def healthy(self) -> bool:
        try:
            self.chunks().limit(1).collect()
        except Exception:  # noqa: BLE001  a probe: any failure means no
            return False
        return True


def write(rows: DataFrame, path: str, mode: str = "append", by: list[str] | None = None) -> None:
    rows.write.mode(mode).partitionBy(*(by or [])).parquet(path)
