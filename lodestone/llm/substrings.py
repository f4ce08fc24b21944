"""Operator 5: removal of repeated strings, by hash grouping of sampled positions.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with
a smaller id.  Ranking every position would sort many times the corpus, so positions are
sampled: the anchor of a string is, among the starts of its grams of ``GRAM`` bytes, the
one of least hash, leftmost of equals.  Equal strings have their anchors at the same
place, so they meet whatever else is dropped; an anchor has all strings that chose it.
This stands in place of prefix doubling (figures in the README): anchors are grouped by
longer and longer strings, and what is unique stops:

1. By their grams: an anchor whose gram is in one document alone is done.
2. By 35 bytes from the anchor on, or up to the gram's end, for the strings that hold
   either half, with the whole neighbourhood as class: the members of a class beyond its
   least document lose all their strings.
3. By whole strings, for the least document of each class, where a half has several
   classes: these are the ends of passages, or chance.

Bytes go by two 64-bit hashes (of a half and the whole, or of a string's halves).  Every
step is a grouping with partial sums and a join, never a list of pairs; marks meet the
text by document.

Null text is empty; null ids take no part (nothing removed).  Repeated ids: rows of equal
id and text share their marks, and rows of one id never remove from each other.  Texts of
one id are told apart by 23 bits of a hash.  Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import map_arrow, only, release, settle

LENGTH, GRAM = 50, 20
#: A place: the text's tag (23 bits of its hash, for rows of one id), how many further
#: string starts follow (6 bits), and the first start (34 bits).
TAG, MORE = 40, 34


def places(tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    return pa.array((tag << TAG) | ((last - first) << MORE) | first)


def starts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string start of each place."""
    first = place & ((1 << MORE) - 1)
    return first, first + ((place >> MORE) & 63)


def anchors(s: K.Slab, prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last string start (places in the slab) of each run of strings of one anchor."""
    h = K.window_hash(prefix, gram)
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return none, none, none
    least, at, size = h, np.arange(len(h), dtype=np.int32 if len(h) < 2**31 else np.int64), 1
    while size < width:
        step = min(size, width - size)
        n = len(least) - step
        right = least[step:] < least[:n]
        least, at = np.where(right, least[step:], least[:n]), np.where(right, at[step:], at[:n])
        size += step
    inside = np.zeros(len(s.data) + 1, dtype=np.int8)
    long = s.end - s.start >= length
    inside[s.start[long]] += 1
    inside[s.end[long] - length + 1] -= 1
    begin = np.flatnonzero(np.cumsum(inside)[: len(at)])
    if not len(begin):
        return none, none, none
    own = at[begin].astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero((np.diff(own) != 0) | (np.diff(begin) != 1)) + 1))
    last = np.append(first[1:], len(begin)) - 1
    return own[first], begin[first], begin[last]


def _prefix(s: K.Slab) -> np.ndarray:
    return K.prefix_hash(K.byte_codes()[s.data])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _grams(length: int, gram: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tags = batch.column(1).to_numpy()
        for s in K.slabs(batch.column(2), 0):
            prefix = _prefix(s)
            at, _, _ = anchors(s, prefix, length, gram)
            if len(at):
                doc = s.doc_of(at)
                key = K.span_hash(prefix, at, at + gram)
                first = (at - s.start[doc]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + s.lo)), _signed(key), places(tags[doc + s.lo], first, first)], names=["id", "key", "place"])

    return run


def _halves(length: int, gram: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tags, asked_at = batch.column(1).to_numpy(), batch.column(3)
        offsets, flat = asked_at.offsets.to_numpy(), starts(asked_at.values.to_numpy())[0]
        for s in K.slabs(batch.column(2), 0):
            prefix = _prefix(s)
            at, a, b = anchors(s, prefix, length, gram)
            if not len(at):
                continue
            asked = np.zeros(len(s.data) + 1, dtype=bool)
            size = np.diff(offsets[s.lo : s.hi + 1])
            asked[flat[offsets[s.lo] : offsets[s.hi]] + np.repeat(s.start, size)] = True
            keep = asked[at]
            at, a, b = at[keep], a[keep], b[keep]
            # strings that start at least ``reach`` before the anchor hold the bytes from there to
            # the gram's end; the others hold ``length - reach + 1`` from the anchor on
            reach = (length - gram + 1) // 2
            for side in (0, 1):
                lo, hi = (a, np.minimum(b, at - reach)) if side == 0 else (np.maximum(a, at - reach + 1), b)
                ok = lo <= hi
                p, lo, hi = at[ok], lo[ok], hi[ok]
                if not len(p):
                    continue
                left, right = (p - reach, p + gram) if side == 0 else (p, p - reach + 1 + length)
                half = K.mix(K.span_hash(prefix, left, right) + K.U64(side))
                whole = K.mix(K.span_hash(prefix, lo, hi + length) ^ K.mix(((p - lo) * 128 + (hi - p + 128)).astype(K.U64)))
                doc = s.doc_of(p)
                base = s.start[doc]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + s.lo)), _signed(half), _signed(whole), places(tags[doc + s.lo], lo - base, hi - base)], names=["id", "half", "whole", "place"])

    return run


def _strings(length: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tags, spans = batch.column(1).to_numpy(), batch.column(3)
        offsets = spans.offsets.to_numpy()
        a_all, b_all = starts(spans.values.to_numpy())
        for s in K.slabs(batch.column(2), 0):
            prefix = _prefix(s)
            size = np.diff(offsets[s.lo : s.hi + 1])
            doc = np.repeat(np.arange(s.hi - s.lo), size)
            a, b = a_all[offsets[s.lo] : offsets[s.hi]], b_all[offsets[s.lo] : offsets[s.hi]]
            n = b - a + 1
            start = np.repeat(a + s.start[doc], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start, which = np.unique(start, return_index=True)
            doc = np.repeat(doc, n)[which]
            first = start - s.start[doc]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + s.lo)), _signed(K.span_hash(prefix, start, start + length // 2)), _signed(K.span_hash(prefix, start + length // 2, start + length)), places(tags[doc + s.lo], first, first)], names=["id", "key", "key2", "place"])

    return run


def _remove(length: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
        offsets, copy = spans.offsets.to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        a_all, b_all = starts(spans.values.to_numpy())
        for s in K.slabs(batch.column(1), 0):
            docs = s.hi - s.lo
            doc = np.repeat(np.arange(docs), np.diff(offsets[s.lo : s.hi + 1]))
            cover = np.zeros(len(s.data) + 1, dtype=np.int64)
            np.add.at(cover, a_all[offsets[s.lo] : offsets[s.hi]] + s.start[doc], 1)
            np.add.at(cover, b_all[offsets[s.lo] : offsets[s.hi]] + s.start[doc] + length, -1)
            whole = np.flatnonzero(copy[s.lo : s.hi])
            np.add.at(cover, s.start[whole], 1)
            np.add.at(cover, s.end[whole], -1)
            gone = np.cumsum(cover[:-1]) > 0
            left, right = K.runs(gone)
            of = s.doc_of(left)
            n_spans = np.bincount(of, minlength=docs)
            n_removed = np.bincount(of, right - left, minlength=docs).astype(np.int64)
            edges = np.split(np.stack((left - s.start[of], right - s.start[of]), 1).reshape(-1), 2 * np.cumsum(n_spans)[:-1])
            kept = [s.data[x:y].tobytes() if not n else s.data[x:y][~gone[x:y]].tobytes() for x, y, n in zip(s.start.tolist(), s.end.tolist(), n_spans.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(s.lo, docs), pa.array((s.end - s.start).astype(np.int64)), pa.array(n_removed), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.tolist() for x in edges], pa.list_(pa.int64()))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def repeated_strings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: its id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay)
    and the removed ``spans`` (starts and ends in bytes, alternating)."""
    gram = max(1, length * GRAM // LENGTH)
    rows = only(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    tag = F.xxhash64("text").bitwiseAND(F.lit((1 << 23) - 1)).alias("tag")
    long = rows.where(f"id is not null and octet_length(text) >= {length}")
    # copies of a text beyond its least document go whole and take no further part
    oldest = long.groupBy(F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")).agg(F.min("id").alias("least"))
    known = rows.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), tag).join(oldest, ["t1", "t2"], "left")
    known = settle(known.select("id", "text", "tag", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("copy")), "zstd")
    part = known.where(f"id is not null and not copy and octet_length(text) >= {length}").select("id", "tag", "text")
    # cheaper made twice than written: most grams are in one document alone
    found = map_arrow(part, _grams(length, gram), f"id {kind}, key long, place long")
    keys = settle(found.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"))
    own = ["id", F.shiftright("place", TAG).alias("tag")]
    alive = settle(found.join(keys, "key", "left_semi").groupBy(*own).agg(F.collect_list("place").alias("at")))
    release(keys)
    # rows of equal id and text give the same rows twice, which no step minds
    halves = settle(map_arrow(part.join(alive, ["id", "tag"]), _halves(length, gram), f"id {kind}, half long, whole long, place long"))
    release(alive)
    classes = settle(halves.groupBy("half", "whole").agg(F.min("id").alias("least")))
    late = settle(halves.join(classes, ["half", "whole"]).where("id > least").select("id", "place"))
    several = classes.groupBy("half").agg(F.count("*").alias("n"), F.min("least").alias("lo"), F.max("least").alias("hi")).where("n > 1 and lo < hi").select("half")
    firsts = settle(classes.join(several, "half", "left_semi").withColumnRenamed("least", "id"))
    release(classes)
    asked = settle(halves.join(firsts, ["half", "whole", "id"], "left_semi").groupBy(*own).agg(F.collect_list("place").alias("at")))
    release(halves, firsts)
    strings = settle(map_arrow(part.join(asked, ["id", "tag"]), _strings(length), f"id {kind}, key long, key2 long, place long"))
    release(asked)
    first = settle(strings.groupBy("key", "key2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "key2", "lo"))
    single = strings.join(first, ["key", "key2"]).where("id > lo").select("id", "place")
    marks = settle(late.union(single).groupBy(*own).agg(F.collect_list("place").alias("spans")))
    release(late, strings, first)
    whole = known.join(marks, ["id", "tag"], "left").select("id", "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"), "copy")
    out = map_arrow(whole, _remove(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out.withColumnRenamed("id", id_col)
