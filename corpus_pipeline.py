"""From raw documents to token ids: five stages, each written as Parquet and read again.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, the next one's docs.  All but the last return the columns of documents, and
other columns as they are.  An empty table stays empty in every stage.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read, shared_dir
from lodestone.llm.decontaminate import without_phrases
from lodestone.llm.language_id import keep_known, learn
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.pieces import encode
from lodestone.llm.pseudonyms import pseudonymise

#: Key of the pseudonyms where the environment names no other.
KEY = os.environ.get("LODESTONE_PSEUDONYM_KEY", "lodestone public demonstration key")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null and letterless texts go.  Rows are
    judged one by one: repeated and null ids pass through."""
    return keep_known(docs, learn(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates (five words, 0.8).

    Rows of one id are one document: they stay or go together.  Rows without id, and texts
    without words, stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no phrase of the benchmark.  Rows are judged one by one; null and
    wordless texts stay, and all do if the benchmark is empty."""
    return without_phrases(docs, read(spark, sf_dir, "benchmark"))


def without_names(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by pseudonyms, n_chars of the new texts.
    Null texts stay null, and keep their n_chars."""
    size = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return pseudonymise(docs, KEY).withColumn("n_chars", size)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids: doc_id, ids, n_pieces, a row for every row; null and empty
    texts have none."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pseudonyms", without_names),
    ("pieces", token_ids),
]

# no SQL for trained filters, sketches or tokenizers: tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/lodestone-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
