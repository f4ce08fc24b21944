"""Operator 9: benchmark decontamination by an FM-index per training shard.

A shard is a slab of some megabytes of whole documents.  Its words become symbols, one
for each word of the benchmark; words that no test phrase holds end a phrase match, so
only runs of benchmark words as long as a phrase are kept (nothing that a phrase could
match is lost).  Over the kept runs the shard builds its suffix array (prefix
doubling), the Burrows-Wheeler transform, a wavelet matrix for rank queries, and keeps
the suffix positions at every ``SAMPLE``-th place.  All test phrases are then searched
backward at once, one symbol a step, and their occurrences located by walking to
sampled positions.  The occurrences give removal spans, which are merged per document.

A phrase (window) is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one phrase.  Phrases are grouped by length, each group with its own
index.  Documents never shuffle and never meet: only the benchmark travels.  It is
read by the driver in blocks of ``block_words`` words, so that what a task gets is
bounded; each further block is one more pass over the rows of a task, which merges its spans
with those before.

Null or empty text has no words; null ids and repeated rows pass through; an empty
benchmark hits nothing.  Words and phrases compare by 64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import only

WINDOW = 10
SAMPLE = 8
#: Bytes of a shard.
SHARD = 4 << 20


def word_bytes() -> np.ndarray:
    """0-9, a-z and all bytes from 0x80: what remains after lower-casing A-Z."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


@dataclass
class Phrases:
    """Phrases of one length over their own symbols 1..n; items[owner] lists who has each."""

    length: int
    vocabulary: np.ndarray
    symbols: np.ndarray
    owner: np.ndarray
    item: np.ndarray


def phrases_of(ids: list, texts: list[str | None], window: int) -> list[Phrases]:
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    column = pa.array(texts, pa.string())
    for s in K.slabs(column, 0):
        _, _, doc, word = K.words(s, word_bytes())
        for d in np.unique(doc):
            own = word[doc == d]
            size = min(window, len(own))
            for i in range(len(own) - size + 1):
                by_length.setdefault(size, []).append((s.lo + int(d), own[i : i + size]))
    out = []
    for size, found in sorted(by_length.items()):
        grams = np.stack([g for _, g in found])
        unique, owner = np.unique(grams, axis=0, return_inverse=True)
        vocabulary = np.unique(unique)
        out.append(Phrases(size, vocabulary, np.searchsorted(vocabulary, unique) + 1, owner.reshape(-1), np.array([i for i, _ in found])))
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling: ranks of pairs at growing offsets."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        key = (rank + 1) << 32
        key[: n - step] |= rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search over text (symbols below ``size``) by the ranks of a wavelet matrix.

    Symbols are kept one higher: 0 is the end alone, so that it is told from separators."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE) -> None:
        text, size = np.append(text + 1, 0), size + 1
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = text[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros, self.counts = [], []
        level = self.bwt
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.counts.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        marked = sa % sample == 0
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))
        self.marked, self.sampled = marked, sa[marked]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        begin, end = np.zeros_like(row), row
        for k, b in enumerate(reversed(range(self.bits))):
            ones, bit = self.counts[k], ((symbol >> b) & 1).astype(bool)
            b1, e1 = ones[begin], ones[end]
            begin = np.where(bit, self.zeros[k] + b1, begin - b1)
            end = np.where(bit, self.zeros[k] + e1, end - e1)
        return end - begin

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes begin with each phrase."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k] + 1
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled position, add the steps."""
        out, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        live, at = np.arange(len(row)), row.copy()
        while len(live):
            hit = self.marked[at]
            out[live[hit]] = self.sampled[self.mark_rank[at[hit]]] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            c = self.bwt[at]
            at = self.first[c] + self.rank(c, at)
            steps[live] += 1
        return out


def occurrences(p: Phrases, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and phrase of each occurrence of a phrase within a document."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(p.vocabulary, word)
    at[at == len(p.vocabulary)] = 0
    known = p.vocabulary[at] == word
    breaks = np.flatnonzero(np.diff(doc)) + 1
    # runs of known words within a document
    begin, end = K.runs(known)
    inner = breaks[known[breaks] & known[breaks - 1]]
    begin, end = np.sort(np.concatenate((begin, inner))), np.sort(np.concatenate((end, inner)))
    keep = end - begin >= p.length
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - begin
    stop = np.cumsum(size + 1)
    text = np.zeros(int(stop[-1]), dtype=np.int64)
    origin = np.repeat(begin - (stop - size - 1), size + 1)
    place = np.arange(len(text))
    inside = np.ones(len(text), dtype=bool)
    inside[stop - 1] = False
    text[inside] = at[(place + origin)[inside]] + 1
    index = FMIndex(text, len(p.vocabulary) + 1)
    lo, hi = index.search(p.symbols)
    times = hi - lo
    phrase = np.repeat(np.arange(len(lo)), times)
    row = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + lo[phrase]
    position = index.locate(row)
    return position + origin[position], phrase


def scan(groups: list[Phrases], slab: K.Slab) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per document; per document its merged hit spans (word numbers, start and end
    alternating); and the distinct item places."""
    _, _, doc, word = K.words(slab, word_bytes())
    docs = slab.hi - slab.lo
    n_words = np.bincount(doc, minlength=docs)
    first = np.concatenate(([0], np.cumsum(n_words)))
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    items: list[np.ndarray] = []
    for p in groups:
        at, phrase = occurrences(p, doc, word)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + p.length, -1)
        d, ph = K.distinct_pairs(doc[at], phrase)
        # phrase -> its items
        order = np.argsort(p.owner, kind="stable")
        start = np.searchsorted(p.owner[order], np.arange(len(p.symbols) + 1))
        times = start[ph + 1] - start[ph]
        pick = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[ph], times)
        items.append(np.stack((np.repeat(d, times), p.item[order][pick])))
    hit = np.cumsum(cover[:-1]) > 0
    begin, end = K.runs(hit)
    # a span ends with its document
    inner = np.unique(first[1:-1])
    inner = inner[(inner > 0) & (inner < len(word))]
    inner = inner[hit[inner] & hit[inner - 1]]
    begin, end = np.sort(np.concatenate((begin, inner))), np.sort(np.concatenate((end, inner)))
    of = doc[begin] if len(begin) else begin
    edge = np.stack((begin - first[of], end - first[of]), axis=1)
    spans = np.split(edge, np.searchsorted(of, np.arange(1, docs)))
    d, i = K.distinct_pairs(*np.concatenate(items, axis=1)) if items else (begin[:0], begin[:0])
    return n_words, [x.reshape(-1) for x in spans], np.split(i, np.searchsorted(d, np.arange(1, docs)))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for r in only(benchmark, item=item_col, text=text_col).where(F.col("text").isNotNull()).toLocalIterator():
        ids.append("" if r["item"] is None else str(r["item"]))
        texts.append(r["text"])
        size += len(r["text"]) // 4
        if size >= block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _scan_rows(groups: list[Phrases], names: np.ndarray):
    """Adds a block's spans and items to those that the rows bring along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slabs(batch.column(1), 0, SHARD):
                n_words, spans, items = scan(groups, s)
                part = batch.slice(s.lo, s.hi - s.lo)
                spans = [merge_spans([np.array(x, dtype=np.int64), y]).tolist() if x else y.tolist() for x, y in zip(part.column(3).to_pylist(), spans, strict=True)]
                items = [sorted({*x, *names[y].tolist()}) for x, y in zip(part.column(4).to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["id", "text", "n_words", "spans", "items"])

    return run


def merge_spans(spans: list[np.ndarray]) -> np.ndarray:
    """The union of spans, each array holding starts and ends alternating."""
    flat = np.concatenate([np.zeros(0, np.int64), *spans]).reshape(-1, 2)
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    out: list[list[int]] = []
    for a, b in flat.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, dtype=np.int64).reshape(-1)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = 2_000_000) -> DataFrame:
    """Per row: its id, n_words, the merged hit ``spans`` in words (starts and ends
    alternating) and the ids, as text, of ``items`` with a phrase in it."""
    rows = only(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, spans array<bigint>, items array<string>"
    out = rows.select("id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    empty = True
    for ids, texts in _blocks(benchmark, item_col, text_col, block_words):
        out, empty = out.mapInArrow(_scan_rows(phrases_of(ids, texts, window), np.array(ids, dtype=object)), schema), False
    if empty:
        out = out.mapInArrow(_scan_rows([], np.array([], dtype=object)), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def without_phrases(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = 2_000_000) -> DataFrame:
    """The rows of df, all columns kept, whose text holds no test phrase: each row is judged
    where it is read, block by block of the benchmark, without a join."""
    at = [c.lower() for c in df.columns].index(text_col.lower())
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = out.schema

    def pick(groups: list[Phrases]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in K.slabs(batch.column(at), 0, SHARD):
                    clean = [not len(x) for x in scan(groups, s)[1]]
                    yield batch.slice(s.lo, s.hi - s.lo).filter(pa.array(clean, pa.bool_()))

        return run

    for ids, texts in _blocks(benchmark, item_col, text_col, block_words):
        out = out.mapInArrow(pick(phrases_of(ids, texts, window)), schema)
    return out.toDF(*df.columns)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.expr("aggregate(sequence(0, greatest(size(spans), 1) - 1), 0L, (a, i) -> a + if(size(spans) = 0, 0L, if(i % 2 = 1, spans[i], -spans[i])))")
    items = F.array_sort("items")
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

