"""Operator 13: ranked lexical search, document at a time over compressed postings.

1. Each task deals its documents into shards of about ``SHARD_BYTES`` of text, sorted by id.  For each
   distinct term of a shard there is one row: the documents that hold it, as gaps of their numbers in the shard, and how
   often, as variable-length bytes.  One further row has the documents' ids and lengths.  That is the index; every
   term of every text is in it.
2. Queries are dealt into blocks by a hash.  The terms of a block meet their postings, so a list is sent once for each
   block that asks it.  They are broadcast if they are few (``FEW_TERMS``), else joined by term and a salt.
3. A shard and a block of queries meet in one group.  Each query's lists are merged document by document through a heap
   of one cursor a list; a result heap of k entries keeps the best by score, then id.
4. The shards' results meet, k rows a shard and query at most, and the best k of each query stay.

Scores are 64-bit integers but for the weight of a term, which is computed in doubles; see ``search``.  A group is bounded by
a shard's size and a block's.  A text of any length is a shard of its own at most; it is cut into terms a piece at a time.

Null text has no terms.  Each row is a document of its own, also where ids repeat; a null id comes last among equal
scores.  Rows of one item id are one query of all their terms; rows without item id take no part.  Items without a
term, or without a document that holds one, have no rows.  Other columns don't matter, whatever their names.  Empty tables
give an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Blocks, only, settle

SHARD_BYTES, PIECE, BLOCK_QUERIES, FEW_TERMS, SALTS = 8 << 20, 1 << 20, 512, 1 << 17, 16
#: What isn't part of a term becomes a blank; A to Z become a to z.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a bounded piece at a time; a longer term stays whole."""
    clean, at = text.translate(_TERM), 0
    while len(clean) - at > PIECE:
        cut = clean.find(b" ", at + PIECE)
        cut = len(clean) if cut < 0 else cut
        yield clean[at:cut].split()
        at = cut
    yield clean[at:].split()


# --- variable-length numbers


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number in groups of seven bits, the highest bit set on all bytes but its last; and the bytes each takes."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        size += values >> bits > 0
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(values)), size)
    place = np.arange(int(end[-1]) if len(end) else 0) - (end - size)[owner]
    out = (values[owner] >> 7 * place & 127).astype(np.uint8)
    out[place < size[owner] - 1] |= 128
    return out, size


def from_bytes(data: np.ndarray) -> np.ndarray:
    """The numbers again."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    begin = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin)


# --- the index


def _index(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Blocks()
        ids: list[pa.Array] = []
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        found: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0

        def out() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            order = pc.sort_indices(own, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            size = np.array(lengths, np.int64)
            doc, term = np.repeat(place, size), np.concatenate(found).astype(np.int64)
            pair, tf = np.unique(term * len(own) + doc, return_counts=True)
            term, doc = pair // len(own), pair % len(own)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            gap = np.diff(doc, prepend=0)
            gap[first] = doc[first]
            data, width = to_bytes(np.stack((gap, tf), axis=1).reshape(-1))
            cuts = np.concatenate(([0], np.cumsum(width)))[np.append(2 * first, 2 * len(term))]
            n, number = len(first), shard()
            lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
            whole = pa.array(list(numbers), pa.binary()).cast(pa.string())
            none = lambda kind, m: pa.nulls(m, kind)
            size = size[order]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, number)),
                    pa.concat_arrays([whole, none(pa.string(), 1)]),
                    pa.array(np.append(np.diff(np.append(first, len(term))), (size > 0).sum())),
                    pa.array(np.append(np.zeros(n, np.int64), size.sum())),
                    pa.concat_arrays([lists, none(pa.binary(), 1)]),
                    pa.concat_arrays([none(pa.list_(id_type), n), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.take(pa.array(order)))]),
                    pa.concat_arrays([none(pa.binary(), n), pa.array([size.astype("<i8").tobytes()], pa.binary())]),
                ],
                names=["shard", "term", "df", "n_terms", "postings", "ids", "lengths"],
            )

        for batch in batches:
            data, offsets = K.utf8_column(batch.column(1))
            cut = offsets.tolist()
            for i in range(batch.num_rows):
                total = 0
                for piece in terms(data[cut[i] : cut[i + 1]].tobytes()):
                    found.append(np.fromiter(map(numbers.__getitem__, piece), np.int32, len(piece)))
                    total += len(piece)
                lengths.append(total)
                ids.append(batch.column(0).slice(i, 1))
                held += cut[i + 1] - cut[i] + 16
                if held >= SHARD_BYTES:
                    yield out()
                    numbers, held = defaultdict(count().__next__), 0
                    ids, found, lengths = [], [], []
        if ids:
            yield out()

    return run


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all texts, written: rows (shard, term, df, postings), and for each shard one row without term
    of (df: documents with a term, n_terms, ids, lengths)."""
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType
    made = rows.mapInArrow(_index(rows.limit(0).toArrow().schema.field("id").type), f"shard long, term string, df long, n_terms long, postings binary, ids array<{kind.simpleString()}>, lengths binary")
    return settle(made, "zstd")


# --- the search


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = sorted({t for piece in terms((text or "").encode()) for t in piece})
            yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(own), batch.column(0).type), pa.array(own, pa.binary()).cast(pa.string())], names=["item", "term"])


def best(lists: list[list[int]], k: int, bits: int) -> list[tuple[int, int]]:
    """(score, document) of the k best by the merge of ascending lists of document << bits | gain."""
    top: list[tuple[int, int]] = []
    mask = (1 << bits) - 1
    for doc, keys in groupby(heapq.merge(*lists), lambda key: key >> bits):
        entry = (sum(key & mask for key in keys), -doc)
        if entry[0] > 0:
            if len(top) < k:
                heapq.heappush(top, entry)
            elif entry > top[0]:
                heapq.heapreplace(top, entry)
    return [(score, -doc) for score, doc in sorted(top, reverse=True)]


def _search(k: int, n: int, total: int, id_type: pa.DataType, item_type: pa.DataType):
    def run(lists: pa.Table, shard: pa.Table) -> pa.Table:
        names = {"item": item_type, "id": id_type, "score": pa.int64()}
        out = {x: [] for x in names}
        if lists.num_rows and shard.num_rows:
            ids = shard.column("ids").combine_chunks().flatten()
            length = np.frombuffer(shard.column("lengths")[0].as_py(), "<i8")
            m = 100 - 90 + 90 * length * n // total
            values = from_bytes(np.frombuffer(b"".join(lists.column("postings").to_pylist()), np.uint8))
            gap, tf = values[::2], values[1::2]
            df = lists.column("held").to_numpy()
            weight = np.repeat(lists.column("weight").to_numpy(), df)
            begin = np.cumsum(df) - df
            doc = np.cumsum(gap)
            doc -= np.repeat(doc[begin] - gap[begin], df)
            gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            bits = int(gain.max()).bit_length()
            keys = [(int(d) << bits) + int(g) for d, g in zip(doc, gain, strict=True)] if int(doc.max()).bit_length() + bits > 62 else (doc << bits | gain).tolist()
            wanted: dict[object, list[list[int]]] = {}
            for a, size, items in zip(begin.tolist(), df.tolist(), lists.column("items").to_pylist(), strict=True):
                for item in items:
                    wanted.setdefault(item, []).append(keys[a : a + size])
            for item, own in wanted.items():
                for score, at in best(own, k, bits):
                    out["item"].append(item)
                    out["id"].append(ids[at].as_py())
                    out["score"].append(score)
        return pa.table({x: pa.array(out[x], kind) for x, kind in names.items()})

    return run


def search(indexed: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", block_queries: int = BLOCK_QUERIES, few_terms: int = FEW_TERMS) -> DataFrame:
    """Rows (item, rank, id, score): the k documents of an ``index`` that score highest above 0 for each item.

    With N documents that hold a term, L terms in all, n terms in the document, of which tf are the term, and df documents
    that hold it: the weight w of a term is floor(1000 * ln((2 * N + 2) / (2 * df + 1))) in doubles, m is
    100 - 90 + 90 * n * N div L, and the score the sum over the item's distinct terms of
    w * (1000000000 * tf div (1000 * tf + 8 * m))."""
    spark = indexed.sparkSession
    asked = only(items, item=item_col, text=text_col).where("item is not null")
    kinds = indexed.limit(0).toArrow().schema.field("ids").type.value_type, asked.limit(0).toArrow().schema.field("item").type
    item_kind, id_kind = asked.schema["item"].dataType.simpleString(), indexed.schema["ids"].dataType.elementType.simpleString()
    asked = settle(asked.mapInArrow(_asked, f"item {item_kind}, term string").distinct())
    shards = indexed.where("term is null")
    fact = shards.agg(F.sum("df").alias("n"), F.sum("n_terms").alias("total")).first()
    size = asked.agg(F.count_distinct("item").alias("items"), F.count_distinct("term").alias("terms")).first()
    n, total = int(fact["n"] or 0), int(fact["total"] or 0)
    result = f"item {item_kind}, id {id_kind}, score long"
    if not n or not size["items"]:
        found = spark.createDataFrame([], result)
    else:
        blocks = -(-size["items"] // block_queries)
        few = size["terms"] <= few_terms
        post = indexed.where("term is not null").select("shard", "term", "df", "postings")

        def met(left: DataFrame, wanted: DataFrame) -> DataFrame:
            """left with the asked terms' columns: broadcast where these are few, else by term and salt."""
            if few:
                return left.join(F.broadcast(wanted), "term")
            salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            return left.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")

        held = met(post.select("shard", "term", "df"), asked.select("term").distinct()).groupBy("term").agg(F.sum("df").alias("all"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("all") + 1)))
        block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
        wanted = asked.groupBy(block.alias("block"), "term").agg(F.collect_list("item").alias("items"))
        wanted = settle(wanted.join(held.select("term", weight.alias("weight")), "term"))
        # a block's terms are at most those of its queries: few in all means few here
        lists = met(post, wanted).select("block", "shard", "weight", "items", F.col("df").alias("held"), "postings")
        every = shards.select(F.col("shard").alias("own"), "ids", "lengths").withColumn("own_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        # groups are small in bytes and long in time: as many tasks as there are partitions, none put together
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        lists, every = lists.repartition(parts, "block", "shard"), every.repartition(parts, "own_block", "own")
        found = lists.groupBy("block", "shard").cogroup(every.groupBy("own_block", "own")).applyInArrow(_search(k, n, total, *kinds), result)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
