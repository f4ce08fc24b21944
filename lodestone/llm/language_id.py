"""Operator 6: language identification by language-bitmask n-gram filters.

For each language the n-grams that are typical of it form a set.  All sets share one
bit-sliced Bloom filter: slot s holds a bitmask (one word for each 64 languages) with bit
l set where language l has some n-gram that hashes to s, so that the AND of an n-gram's
slots returns, at once, all languages whose set contains it.  A document counts, for each language, the
n-grams whose mask has its bit; the filter's false positives are subtracted (the
share p of n-grams that hit by chance is known from how full each bit slice is, so
the true share is (hits / n - p) / (1 - p)); the largest corrected share decides.

Fitting takes a bounded sample: about ``per_language`` documents of each language (by
a hash of the id), read by the driver, and one count for each language.  The model is one
array of 2**``bits`` masks (2 MB by default for up to 64 languages) whatever the corpus.

Null text or a text without letters gives ``und`` with score 0.  Ties go to the
language first in the alphabet.  Rows are handled one by one, so that repeated rows and
null ids pass through, and other columns, whatever their names, don't matter; a null id
is never held out, nor learned from.  With nothing to learn from every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, map_arrow, only

SIZES = (3,)
HASHES = 2
UNKNOWN = "und"


def _grams(column: pa.Array) -> Iterator[tuple[K.CodeSlab, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slab: the document and hash of each n-gram, and each document's letters.

    An n-gram lies in a word (a run of letters) with one mark before and after it."""
    for s in K.code_slabs(column):
        letter = K.char_classes()[s.data] == K.LETTER
        letters = np.add.reduceat(np.append(letter, False).astype(np.int64), s.start) * (s.end > s.start)
        data = np.where(letter, K.lower_chars()[s.data], 32)
        # one blank for each run of others
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        at = np.flatnonzero(keep)
        data = np.concatenate(([32], data[at])).astype(K.U64)
        doc = s.doc_of(at)
        doc = np.concatenate((doc[:1], doc))
        prefix = K.prefix_hash(K.mix(data + K.U64(1)))
        blank = np.concatenate(([0], np.cumsum(data == 32)))
        docs, hashes = [], []
        for n in SIZES:
            m = len(data) - n + 1
            if m <= 0:
                continue
            inner = blank[n - 1 : n - 1 + m] - blank[1 : 1 + m] == 0 if n > 2 else np.ones(m, dtype=bool)
            inner &= (data[:m] != 32) | (data[n - 1 :] != 32)
            p = np.flatnonzero(inner)
            docs.append(doc[p + n - 1])
            hashes.append(K.window_hash(prefix, n)[p])
        none = np.zeros(0, np.int64)
        yield s, np.concatenate([none, *docs]), np.concatenate([none.astype(K.U64), *hashes]), letters


@dataclass
class LanguageFilter:
    """The bit-sliced filter: masks (slot, word), and for each language the chance that a strange n-gram hits."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        m = K.U64(len(self.masks) - 1)
        return [(K.mix(h + K.U64(i)) & m).astype(np.int64) for i in range(HASHES)]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        first, *more = (self.masks[s] for s in self.slots(h))
        for x in more:
            first = first & x
        return first


def fit(texts: list[str], labels: list[str], bits: int = 18, typical: float = 0.2, least: int = 2) -> LanguageFilter:
    """A language has an n-gram if it stands in ``least`` of its texts and its rate there is
    at least ``typical`` of the highest rate among languages."""
    languages = sorted(set(labels))
    grams, rates, spread = [], [], []
    for x in languages:
        own = pa.array([t for t, y in zip(texts, labels, strict=True) if y == x], pa.string())
        hs, ds = [np.zeros(0, K.U64)], [np.zeros(0, np.int64)]
        for s, doc, h, _ in _grams(own):
            hs.append(h)
            ds.append(doc + s.lo)
        h, d = np.concatenate(hs), np.concatenate(ds)
        value, count = np.unique(h, return_counts=True)
        _, distinct = K.distinct_pairs(d, h)
        _, seen = np.unique(distinct, return_counts=True)
        grams.append(value)
        rates.append(count / max(1, len(h)))
        spread.append(seen)
    every = np.unique(np.concatenate(grams)) if grams else np.zeros(0, K.U64)
    best = np.zeros(len(every))
    for g, r in zip(grams, rates, strict=True):
        at = np.searchsorted(every, g)
        best[at] = np.maximum(best[at], r)
    model = LanguageFilter(languages, np.zeros((1 << bits, max(1, -(-len(languages) // 64))), dtype=K.U64), np.zeros(len(languages)))
    for i, (g, r, n) in enumerate(zip(grams, rates, spread, strict=True)):
        chosen = g[(r >= typical * best[np.searchsorted(every, g)]) & (n >= min(least, max(1, n.max(initial=1))))]
        for s in model.slots(chosen):
            model.masks[s, i >> 6] |= K.U64(1 << (i & 63))
    for i in range(len(languages)):
        model.chance[i] = ((model.masks[:, i >> 6] >> K.U64(i & 63)) & K.U64(1)).mean() ** HASHES
    return model


def decide(model: LanguageFilter, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    out: list[str] = []
    scores = []
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    for s, doc, h, letters in _grams(column):
        docs = s.hi - s.lo
        n = np.maximum(np.bincount(doc, minlength=docs), 1)
        share = np.zeros((max(1, len(model.languages)), docs))
        mask = model.lookup(h)
        for i, p in enumerate(model.chance):
            hits = np.bincount(doc, ((mask[:, i >> 6] >> K.U64(i & 63)) & K.U64(1)).astype(np.float64), minlength=docs)
            share[i] = (hits / n - p) / (1 - p)
        best = np.argmax(share, axis=0)
        known = (letters > 0) & (len(model.languages) > 0)
        out += names[np.where(known, best, len(model.languages))].tolist()
        scores.append(np.where(known, np.clip(share[best, np.arange(docs)], 0, 1), 0.0))
    return out, np.concatenate([np.zeros(0), *scores])


def learn(df: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """Fit on about ``per_language`` rows of each language, chosen by a hash of the id,
    among those that aren't held out and have a language and text."""
    rows = only(df, doc_id=id_col, text=text_col, lang=lang_col).where(~held_out() & F.expr("doc_id is not null and lang is not null and text is not null"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    scale = 1 << 30
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(scale))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(scale * min(1.0, per_language / n)))])
    chosen = place < limit[F.col("lang")]
    sample = rows.where(chosen).select("text", "lang").toPandas()
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def language_id(df: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, held_out, lang_pred and score, by the given model."""
    rows = only(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", held_out().alias("held_out"), "text")

    def predict(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, score = decide(model, batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(rows, predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def keep_known(df: DataFrame, model: LanguageFilter, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows that have a language, as op6 names it, with a score of ``least`` or more, all columns kept."""
    at = [c.lower() for c in df.columns].index(text_col.lower())
    names = [f"c{i}" for i in range(len(df.columns))]

    def pick(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, score = decide(model, batch.column(at))
        keep = np.array([x != UNKNOWN for x in lang], dtype=bool) & (score >= least)
        yield batch.filter(pa.array(keep))

    plain = df.toDF(*names)
    return plain.mapInArrow(lambda batches: (out for b in batches if b.num_rows for out in pick(b)), plain.schema).toDF(*df.columns)
