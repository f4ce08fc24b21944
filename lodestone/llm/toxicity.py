"""Operator 1: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence with words of weights w has the log odds
z = bias + sum(w), each distinct word once; a document is toxic unless all its sentences
are clean: P = 1 - prod(1 - p) (noisy-or).  Only documents have labels; the gradient of
their likelihood reaches the sentences through the product, so that training decides
which sentences carry the label.  The same weights then locate the offending sentences.

Fitting takes a bounded sample: about ``per_class`` labelled documents of each class, by a
hash of the id, read by the driver; words are the ``features`` that tell the classes best
in it.  Scoring goes through every whole text in slabs, without a shuffle.

Null or empty text has no sentence: score 0.  Rows are scored one by one, so repeated
rows and null ids pass through.  With no labels of both classes every score is 0.
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

PER_CLASS, FEATURES, STEPS = 1500, 4096, 300
# A sentence ends with one of these.
ENDS = ".!?\n"


def letters() -> np.ndarray:
    """a-z, the apostrophe and all bytes from 0x80."""
    table = K.byte_table("abcdefghijklmnopqrstuvwxyz'")
    table[0x80:] = True
    return table


def sentences(column: pa.Array) -> Iterator[tuple[K.Slab, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slab: sentence number and hash of each distinct word of a sentence, and each
    sentence's start and end; a sentence has a word at least."""
    for s in K.slabs(column, 0x0A):
        start, end, _, word = K.words(s, letters())
        ends = np.concatenate(([0], np.cumsum(K.byte_table(ENDS)[s.data])))
        number = np.unique(ends[start], return_inverse=True)[1] if len(start) else start
        first = np.flatnonzero(np.diff(number, prepend=-1))
        last = np.append(first[1:], len(number))[: len(first)] - 1
        yield s, *K.distinct_pairs(number, word), start[first], end[last]


@dataclass
class Bags:
    """Known words by sentence: feature[first[i]:first[i + 1]] are those of sentence i."""

    sentence: np.ndarray
    feature: np.ndarray
    doc: np.ndarray


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float

    def odds(self, sentence: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """The log odds of n sentences."""
        if not len(self.words):
            return np.full(n, -np.inf)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[at] == word
        return self.bias + np.bincount(sentence[known], self.weights[at[known]], minlength=n)


def noisy_or(odds: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """-log(1 - P) of each document: the sum of its sentences' softplus."""
    return np.bincount(doc, np.logaddexp(0, odds), minlength=docs)


def fit(texts: list[str], labels: np.ndarray, features: int = FEATURES, steps: int = STEPS, penalty: float = 1e-3) -> Model:
    """Full-batch Adam on the noisy-or likelihood, classes weighted evenly."""
    nothing = Model(np.zeros(0, K.U64), np.zeros(0), 0.0)
    if len(set(labels.tolist())) < 2:
        return nothing
    sentence, word, doc = [], [], []
    total = 0
    for s, number, h, start, _ in sentences(pa.array(texts, pa.string())):
        sentence.append(number + total)
        word.append(h)
        doc.append(s.doc_of(start) + s.lo)
        total += len(start)
    sentence, word, doc = np.concatenate(sentence), np.concatenate(word), np.concatenate(doc)
    if not len(word):
        return nothing
    vocabulary, feature = np.unique(word, return_inverse=True)
    d, f = K.distinct_pairs(doc[sentence], feature)
    size = np.bincount(labels, minlength=2).astype(float)
    count = np.stack([np.bincount(f[labels[d] == c], minlength=len(vocabulary)) for c in (0, 1)])
    rate = (count + 0.5) / (size[:, None] + 1)
    gain = np.abs(rate[1] - rate[0]) * np.abs(np.log(rate[1] / rate[0]))
    chosen = np.sort(np.argsort(-gain, kind="stable")[:features])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    known = place[feature] >= 0
    sentence, feature = sentence[known], place[feature][known]
    weight = np.where(labels == 1, 0.5 / size[1], 0.5 / size[0]) * len(labels)
    x = np.concatenate((np.zeros(len(chosen)), [-5.0]))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        odds = x[-1] + np.bincount(sentence, x[feature], minlength=total)
        bag = noisy_or(odds, doc, len(texts))
        slope = weight * np.where(labels == 1, 1 / np.maximum(np.expm1(np.minimum(bag, 50)), 1e-6), -1.0)
        each = slope[doc] / (1 + np.exp(-odds))
        g = np.concatenate((np.bincount(feature, each[sentence], minlength=len(chosen)), [each.sum()])) / len(texts)
        g[:-1] -= penalty * np.sign(x[:-1])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(vocabulary[chosen], x[:-1], float(x[-1]))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on about ``per_class`` labelled rows of each class that aren't held out."""
    known = only(labels, doc_id=id_col, label=label_col).where(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return fit([], np.zeros(0, int))
    scale = 1 << 30
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(scale))
    chosen = F.lit(False)
    for label, n in counts.items():
        chosen |= (F.col("label") == label) & (place < int(scale * min(1.0, per_class / n)))
    # at most about 2 * per_class rows by the filter above
    picked = F.broadcast(known.where(chosen))
    sample = only(df, doc_id=id_col, text=text_col).where(F.col("text").isNotNull()).join(picked, "doc_id").select("doc_id", "text", "label").toPandas().sort_values(["doc_id", "text"])
    return fit(sample["text"].tolist(), sample["label"].to_numpy(dtype=int))


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, held_out, score, predicted, and the offending sentences (start and
    end in bytes of the text, score) of 0.5 and more."""
    rows = only(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", held_out().alias("held_out"), "text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s, number, word, start, end in sentences(batch.column(2)):
            docs = s.hi - s.lo
            doc = s.doc_of(start)
            odds = model.odds(number, word, len(start))
            score = -np.expm1(-noisy_or(odds, doc, docs)) + 0.0  # no negative zero
            own = 1 / (1 + np.exp(-odds))
            bad = np.flatnonzero(own >= 0.5)
            found: list[list] = [[] for _ in range(docs)]
            for i in bad.tolist():
                at = int(s.start[doc[i]])
                found[int(doc[i])].append({"start": int(start[i]) - at, "end": int(end[i]) - at, "score": float(own[i])})
            head = batch.slice(s.lo, docs)
            yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, pa.list_(span))], names=["doc_id", "held_out", "score", "predicted", "offending"])

    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>").withColumnRenamed("doc_id", id_col)
