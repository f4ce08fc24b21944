"""Operator 3: token counts from distinct pre-tokens, without token ids.

A byte-level BPE tokenizer splits a text into pre-tokens and encodes each alone,
so a text's count is the sum, over its distinct pre-tokens, of frequency times
pieces.  Three steps:

1. Each task cuts its texts, a slab of some megabytes at a time, into pre-tokens
   (vectorised over code points), and writes, for each of ``buckets`` buckets of
   pre-tokens, one row with the slab's distinct pre-tokens and for each of them
   the documents and frequencies.  A frequent word is one entry per slab.
2. All rows of a bucket meet in one task; it has each distinct pre-token encoded
   once by the library, multiplies, and returns one row of sums for each slab.
3. The rows of a slab meet, and its documents' sums are added up.

Nothing grows beyond a slab but the memory of counted pre-tokens, which is
emptied at ``memo`` entries (a later meeting is then counted again: same result).

Null text counts as empty.  Null or repeated ids are no matter: rows are told
apart by their place.  Other columns don't matter, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Blocks, only, pack, unpack

SEPARATOR = 0x10FFFF
#: Buckets at least and at most; between, as many as the session's shuffle partitions.
BUCKETS = (64, 4096)
MEMO = 400_000
#: Larger slabs have fewer distinct pre-tokens in all.
SLAB = 4 << 20


@cache
def _char_codes() -> np.ndarray:
    return K.mix(np.arange(1, 0x110001, dtype=K.U64) * K.U64(0x9E3779B97F4A7C15))


@cache
def char_runs(spec: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the classes of code points change, and the classes, as the library's own pattern
    has them: each code point stands between a letter, a number and a mark, and what it is
    joined with tells its class.  Planes 4 to 13, 15 and 16 have neither letters nor numbers."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(spec).pre_tokenizer
    kind = np.full(0x110000, K.OTHER, dtype=np.uint8)
    for lo in [*range(0, 0x40000, 1 << 14), 0xE0000]:
        codes = np.array([c for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000])
        if not len(codes):
            continue
        probe = "".join(f"a{chr(c)}1{chr(c)}!\n" for c in codes.tolist())
        starts = np.zeros(len(probe), dtype=bool)
        starts[[a for _, (a, _) in split.pre_tokenize_str(probe)]] = True
        _, letter, number, _, apart, _ = starts.reshape(-1, 6).T
        kind[codes] = np.where(~letter, K.LETTER, np.where(~number, K.NUMBER, np.where(apart, K.SPACE, K.OTHER)))
    kind[32] = K.SPACE  # the one blank that joins what follows
    edge = np.concatenate(([0], np.flatnonzero(np.diff(kind)) + 1))
    return edge, kind[edge]


def pretoken_starts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens of the byte-level pattern start.

    ``kind`` holds the character classes, and 4 for separators; separators start too.
    The pattern takes contractions, runs of letters, numbers or others with one blank
    before them, and white space, whose last character it leaves to what follows."""
    n = len(data)
    starts = np.ones(n, dtype=bool)
    starts[1:] = kind[1:] != kind[:-1]
    separator = kind == 4
    starts |= separator
    at = starts.copy()
    space_begin, space_end = K.runs(kind == K.SPACE)
    if len(space_begin):
        inner = space_end < n
        inner[inner] = kind[space_end[inner]] != 4
        last = space_end[inner] - 1
        at[last] = True
        at[last[data[last] == 32] + 1] = False
    quote = np.flatnonzero((data[:-2] == 39) & at[:-2]) if n > 2 else np.zeros(0, np.int64)
    if len(quote):
        a = data[quote + 1]
        b = data[quote + 2]
        one = np.isin(a, np.array([ord(c) for c in "stmd"], dtype=np.uint32))
        two = np.zeros(len(quote), dtype=bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1]))
        for hit, size in ((quote[one], 2), (quote[two], 3)):
            at[hit + 1] = False
            after = hit[hit + size < n] + size
            at[after[kind[after] == K.LETTER]] = True
    return at


def _map(special: list[str], buckets: int, edge: np.ndarray, classes: np.ndarray):
    marks = [np.array([ord(c) for c in s], dtype=np.uint32) for s in special]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Blocks()
        classes_of = np.repeat(classes, np.diff(np.append(edge, 0x110000)))
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = np.diff(K.utf8_column(column)[1])
            for s in K.code_slabs(column, SEPARATOR, SLAB):
                number, docs = block(), s.hi - s.lo
                base = np.zeros(docs, dtype=np.int64)
                data = s.data
                kind = classes_of[data]
                kind[s.end] = 4
                text = None
                for word, mark in zip(special, marks, strict=True):
                    text = text or data.tobytes().decode("utf-32-le")
                    p = text.find(word)
                    while p >= 0:
                        kind[p : p + len(mark)] = 4
                        base[int(s.doc_of(np.array([p]))[0])] += 1
                        p = text.find(word, p + len(mark))
                text = text or data.tobytes().decode("utf-32-le")
                start = np.flatnonzero(pretoken_starts(data, kind))
                end = np.append(start[1:], len(data))
                keep = kind[start] != 4
                start, end = start[keep], end[keep]
                out_bucket = [buckets + zlib.crc32(str(number).encode()) % buckets]
                out_data = [pack(ids.slice(s.lo, docs).to_pylist(), sizes[s.lo : s.hi], base)]
                if len(start):
                    prefix = K.prefix_hash(_char_codes()[data])
                    doc = s.doc_of(start)
                    _, first, token = np.unique(K.span_hash(prefix, start, end), return_index=True, return_inverse=True)
                    pair, freq = np.unique(token.astype(np.int64) * docs + doc, return_counts=True)
                    token, doc = pair // docs, pair % docs
                    strings = [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                    to = np.fromiter((zlib.crc32(x.encode()) % buckets for x in strings), dtype=np.int64, count=len(strings))
                    order = np.argsort(to[token], kind="stable")
                    token, doc, freq = token[order], doc[order], freq[order]
                    cut = np.searchsorted(to[token], np.arange(buckets + 1))
                    for b in range(buckets):
                        i, j = cut[b], cut[b + 1]
                        if i == j:
                            continue
                        own, times = np.unique(token[i:j], return_counts=True)
                        mine = [strings[x] for x in own.tolist()]
                        out_bucket.append(b)
                        out_data.append(pack("".join(mine), np.fromiter(map(len, mine), dtype=np.int64, count=len(mine)), times, doc[i:j], freq[i:j], docs))
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array([number] * len(out_bucket), pa.int64()), pa.array(out_data, pa.binary())], names=["bucket", "block", "data"])

    return run


def _count(spec: str, buckets: int, memo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        counted: dict[str, int] = {}
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket >= buckets:
                    out.append(data)
                    continue
                text, lengths, times, doc, freq, docs = unpack(data)
                ends = np.cumsum(lengths.astype(np.int64)).tolist()
                tokens = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                if new := [x for x in tokens if x not in counted]:
                    if len(counted) + len(new) > memo:
                        counted.clear()
                        new = tokens
                    counted.update(zip(new, (len(e.ids) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
                pieces = np.fromiter((counted[x] for x in tokens), dtype=np.int64, count=len(tokens))
                sums = np.bincount(doc, np.repeat(pieces, times) * freq, minlength=docs).astype(np.int64)
                out.append(pack(sums))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["block", "data"])

    return run


def _total(table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    ids, sizes, base = next(p for p in parts if len(p) == 3)
    total = base.astype(np.int64) + sum(p[0].astype(np.int64) for p in parts if len(p) == 1)
    return pa.table({"id": pa.array(ids, pa.string()), "n_bytes": pa.array(sizes.astype(np.int64)), "n_tokens": pa.array(total, pa.int64())})


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, buckets: int | None = None, memo: int = MEMO) -> DataFrame:
    """Per row: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``tokenizer_path``: a byte-level BPE file of the tokenizers library, read on the
    driver and sent to the tasks.  Strings of its special tokens inside a text count
    one each, as the library handles them by default.  ``buckets``: into how many parts
    the distinct pre-tokens are dealt, by default as many as the session has shuffle partitions."""
    if buckets is None:
        buckets = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKETS[0]), BUCKETS[1])
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"]:
        raise ValueError("a byte-level BPE without normalizer is needed")
    added = spec["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that strip or match single words aren't supported")
    spec["truncation"] = spec["padding"] = None
    rows = only(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select(F.col("id").cast("string"), "text")
    parts = rows.mapInArrow(_map([t["content"] for t in added], buckets, *char_runs(json.dumps(spec))), "bucket int, block long, data binary")
    sums = parts.repartition(buckets, "bucket").mapInArrow(_count(json.dumps(spec), buckets, memo), "block long, data binary")
    out = sums.groupBy("block").applyInArrow(_total, "id string, n_bytes long, n_tokens long")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
