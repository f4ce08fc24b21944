"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir
from .compact_windows import near_passages
from .decontaminate import contamination, digest
from .hard_negatives import hard_negatives
from .language_id import language_id, learn
from .lexical import index, search
from .near_dedup import near_duplicates
from .packed_ids import documents, write_ids
from .pieces import encode
from .pivot_search import exact_top_k
from .pseudonyms import personal_data
from .substrings import repeated_strings
from .token_counts import token_counts
from .toxicity import learn as learn_toxicity
from .toxicity import toxicity

#: Key of the pseudonyms where the environment names no other.
KEY = os.environ.get("LODESTONE_PSEUDONYM_KEY", "lodestone public demonstration key")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity(docs, learn_toxicity(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), F.to_json("offending").alias("offending"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"), KEY)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(read(spark, sf_dir, "documents")).drop("spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id(docs, learn(docs))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), checked=True)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op10_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(read(spark, sf_dir, "documents"))


def op11_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/lodestone-ids-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_topk": op2_exact_topk,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontaminate": op9_decontaminate,
    "op10_near_passages": op10_near_passages,
    "op11_packed_ids": op11_packed_ids,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}

_WHOLE = "list_transform(embedding, lambda x: floor(64 * x::double)::bigint)"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": f"""with v as (select vec_id, {_WHOLE} as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(list_transform(q.e, lambda x: x::double), list_transform(v.e, lambda x: x::double))::bigint as score from v, (select * from v where vec_id % 20 = 0) q where v.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 20""",
    "op12_hard_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_inner_product(a.e, v.e)::bigint as score from v, (select * from v where vec_id % 100 = 0) a where v.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5""",
    "op13_lexical_search": r"""with d as (select row_number() over () as r, doc_id, text from documents),
low as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as a, 'abcdefghijklmnopqrstuvwxyz' as z, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' as term),
t as (select r, doc_id, unnest(regexp_extract_all(translate(text, a, z), low.term)) as term from d, low),
n as (select r, count(*) as n from t group by r),
g as (select count(*)::bigint as docs, sum(n)::bigint as total from n),
tf as (select r, doc_id, term, count(*) as tf from t group by all),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, a, z), low.term)) as term from benchmark, low where item_id is not null),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, g where term in (select term from q) group by term, docs),
s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::bigint as score from q join w using (term) join tf using (term) join n using (r), g group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from s where score > 0 qualify rank <= 10""",
}
