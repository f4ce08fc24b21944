"""Operator 7: near-duplicates by banded MinHash candidates and odd sketches.

1. A document becomes the set of its distinct word shingles (64-bit hashes).  Documents
   with equal sets (by count and two 64-bit sums) form a class; one of them stands for it.
2. A class has ``BANDS * ROWS`` MinHash samples for the bands.  Its odd sketch folds
   further samples, the least hash in each of ``BINS`` ranges of the hashes (one-permutation
   MinHash), into a parity bitmap: the population count of the XOR of two sketches tells how
   many samples differ, most precisely where similarity is high.
3. Classes that agree in all samples of a band meet under the band's key.  First each is
   compared with the key's centre (a star: as many pairs as rows): the class whose keys have
   the most members, as the original of a group of edited copies has.  A pair is a candidate
   if sizes and sketches allow the threshold, and a link if the full sets confirm it.  The
   links' components settle most groups of copies.
4. What a star leaves are strays: classes outside the component of their key's centre.  They
   are compared with the members of that component's keys, blocks of strays with blocks of
   members in a task; sketches and then full sets decide there, and only links that join two
   components come out.  No pair that isn't a link becomes a row.  The comparisons (not the
   rows) of a group are its strays times its members.
5. The components of all links are the result.

A pair at the threshold misses every band with a chance of (1 - 0.8**ROWS)**BANDS, about
5e-8, and is rejected by its sketches if samples or folding are ``SIGMAS`` standard
deviations off, a chance of about 6e-7; for pairs above it both are less.

Null or wordless text: empty set, linked with nothing.  A null id forms no links and
passes through as its own.  Rows of one id count as one document with the least of their
sets.  An empty table gives an empty result.  Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import stars as S
from .common import map_arrow, only, release, settle
from .components import components

BANDS, ROWS, BINS, SKETCH = 32, 4, 2048, 2048
SIGMAS = 5.0


def ascii_space_words() -> np.ndarray:
    """All bytes but blank and 9 to 13: a word is a run of them."""
    table = np.ones(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[K.Slab, np.ndarray, np.ndarray]]:
    """Per slab: each document's distinct shingle hashes, and where each document's begin."""
    for s in K.slabs(column, 0x20):
        _, _, doc, word = K.words(s, ascii_space_words())
        d, h = K.distinct_pairs(*K.shingles(doc, word, size))
        yield s, h, np.searchsorted(d, np.arange(s.hi - s.lo + 1))


def minhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples of each set; h[first[i]:first[i + 1]] is set i, none is empty."""
    out = np.empty((BANDS * ROWS, len(first) - 1), dtype=K.U64)
    for k in range(BANDS * ROWS):
        salt = K.mix(np.array([k + 1], dtype=K.U64))[0]
        # multiply-shift on mixed hashes: one product and one fold per element
        x = (h ^ salt) * (salt | K.U64(1))
        out[k] = np.minimum.reduceat(x ^ (x >> K.U64(29)), first[:-1])
    return out


def odd_sketch(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's least hash in each of BINS ranges, folded into a parity bitmap of SKETCH
    bits, as words; and how many samples each set has.  Hashes ascend within a set."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = (of << 32) | (h // K.U64((1 << 64) // BINS)).astype(np.int64)
    least = np.flatnonzero(np.diff(place, prepend=-1))
    of, bit = of[least], K.mix(h[least]) % K.U64(SKETCH)
    words = np.zeros((len(first) - 1, SKETCH // 64), dtype=K.U64)
    np.bitwise_xor.at(words, (of, (bit >> K.U64(6)).astype(np.int64)), K.U64(1) << (bit & K.U64(63)))
    return words, np.bincount(of, minlength=len(first) - 1)


def sketch_limit(n: np.ndarray, m: np.ndarray, e: np.ndarray, g: np.ndarray, similarity: float) -> np.ndarray:
    """The highest XOR population count that sets of n and m elements, with e and g samples,
    may show at that similarity or above."""
    union = (n + m) / (1 + similarity)
    full = union / BINS
    # samples of the union are a random part of it: a hypergeometric share is in both sets
    samples = BINS * -np.expm1(-full)
    spread = BINS * np.exp(-full) * -np.expm1(-full) + 1
    both = similarity * samples
    noise = samples * similarity * (1 - similarity) * np.clip((union - samples) / np.maximum(union - 1, 1), 0, 1)
    differ = np.maximum(e + g - 2 * (both - SIGMAS * np.sqrt(similarity**2 * spread + noise)), 0)
    one, two = (1 - 2 / SKETCH) ** differ, (1 - 4 / SKETCH) ** differ
    folding = np.maximum(SKETCH + SKETCH * (SKETCH - 1) * two - SKETCH**2 * one**2, 0) / 4
    return SKETCH / 2 * (1 - one) + SIGMAS * np.sqrt(folding)


def sizes_allow(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two ascending arrays have in common."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = shared(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _blobs(h: np.ndarray, first: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(h).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(data)])


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set; 0 for empty ones."""
    out, full = np.zeros((2, len(first) - 1), dtype=K.U64), np.flatnonzero(np.diff(first))
    if len(full):
        out[0, full] = np.add.reduceat(h, first[:-1][full])
        out[1, full] = np.add.reduceat(K.mix(h), first[:-1][full])
    return out.view(np.int64)


def _features(size: int):
    """Size, sums and band keys of each text's set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s, h, first in shingle_sets(batch.column(1), size):
            n = np.diff(first)
            full = np.flatnonzero(n)
            sums = _sums(h, first)
            keys = np.zeros((len(n), BANDS), dtype=np.int64)
            if len(full):
                samples = minhash(h, np.append(first[:-1][full], len(h)))
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, dtype=K.U64)
                    for row in samples[b * ROWS : (b + 1) * ROWS]:
                        key = K.mix(key * K.U64(0x9E3779B97F4A7C15) + row)
                    keys[full, b] = key.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], names=["id", "n", "s1", "s2", "keys"])

    return run


def _sets(size: int):
    """The sketch and the set of each text (text, row, n, s1, s2) whose size and sums these are."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, s1, s2 = (batch.column(c).to_numpy() for c in ("n", "s1", "s2"))
        for s, h, first in shingle_sets(batch.column(0), size):
            sums, part = _sums(h, first), slice(s.lo, s.hi)
            own = pa.array((np.diff(first) == n[part]) & (sums[0] == s1[part]) & (sums[1] == s2[part]))
            sketch, e = odd_sketch(h, first)
            blobs = [_blobs(sketch.reshape(-1), np.arange(len(e) + 1) * (SKETCH // 64)), _blobs(h, first)]
            out = [batch.column("row").slice(s.lo, s.hi - s.lo), batch.column("n").slice(s.lo, s.hi - s.lo), pa.array(e.astype(np.int64)), *blobs]
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in out], names=["row", "n", "e", "sketch", "own"])

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=K.U64).reshape(len(column), -1)


def _likely(percent: int):
    """The pairs (a, b) whose sizes and sketches allow the threshold."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, e, m, g = (S.numbers(batch.column(c)) for c in ("n", "e", "m", "g"))
        differ = np.bitwise_count(_sketches(batch.column("x")) ^ _sketches(batch.column("y"))).sum(axis=1)
        keep = pa.array(sizes_allow(n, m, percent) & (differ <= sketch_limit(n, m, e, g, percent / 100)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "n")], names=["a", "b", "n"])

    return run


def _confirm(percent: int):
    """The pairs whose full sets reach the threshold."""

    def run(pairs: pa.Table, centres: pa.Table) -> pa.Table:
        sets = {a: np.frombuffer(x.as_buffer(), K.U64) for a, x in zip(centres["a"].to_pylist(), centres["own"], strict=True)}
        keep = [linked(sets[a], np.frombuffer(x.as_buffer(), K.U64), percent) for a, x in zip(pairs["a"].to_pylist(), pairs["own"], strict=True)]
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _join_strays(percent: int):
    """Links that join two components, each component joined once in a task."""

    def links(x: pa.Table, y: pa.Table) -> Iterator[tuple[int, int]]:
        joined = S.Joined()
        n, e, row, root = (S.numbers(x[c]) for c in ("n", "e", "row", "root"))
        m, g, row2, root2, stray = (S.numbers(y[c]) for c in ("n", "e", "row", "root", "stray"))
        p, q = _sketches(x["sketch"]), _sketches(y["sketch"])
        sets, sets2 = ([np.frombuffer(v.as_buffer(), K.U64) for v in t["own"]] for t in (x, y))
        for i in range(len(n)):
            # two strays meet once, by their numbers
            ok = np.flatnonzero((root2 != root[i]) & (~stray | (row2 > row[i])) & sizes_allow(n[i], m, percent))
            differ = np.bitwise_count(q[ok] ^ p[i]).sum(axis=1)
            near = differ <= sketch_limit(n[i], m[ok], e[i], g[ok], percent / 100)
            for j in ok[near][np.argsort(differ[near], kind="stable")].tolist():
                a, b = int(root[i]), int(root2[j])
                if joined.root(a) != joined.root(b) and linked(sets[i], sets2[j], percent):
                    joined.join(a, b)
                    yield int(row[i]), int(row2[j])

    def run(strays: pa.Table, members: pa.Table) -> pa.Table:
        found = [p for x, y in S.blocks(strays, members) for p in links(x, y)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: its id, n_shingles, component_id (the least id reachable) and kept
    (the id is the component's).  Links: similarity of shingle sets >= percent / 100."""
    rows = only(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    made = map_arrow(rows, _features(shingle), f"id {kind}, n long, s1 long, s2 long, keys array<long>")
    made = settle(made.withColumn("row", F.monotonically_increasing_id()))
    base = made.select("id", "n", "s1", "s2", "row")
    # a repeated id has the least of its sets
    chosen = base.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("n", "s1", "s2", "row")).alias("set")).select("id", "set.*")
    classes = settle(chosen.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "row")).alias("rep")).select("n", "s1", "s2", "rep.id", "rep.row"))
    member = settle(chosen.drop("row").join(classes.select("n", "s1", "s2", F.col("row").alias("rep")), ["n", "s1", "s2"]).select("id", "rep"))
    keyed = made.select("row", "keys").join(classes.select("row"), "row", "left_semi").select("row", F.explode("keys").alias("key"))
    # a key that one class alone has links nothing
    common = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    slim = settle(keyed.join(common, "key"))
    # a repeated text of one id may stand twice here: its pairs are then met twice
    needed = classes.join(slim.select("row").distinct(), "row", "left_semi")
    sets = settle(map_arrow(rows.join(needed, "id").select("text", "row", "n", "s1", "s2"), _sets(shingle), "row long, n long, e long, sketch binary, own binary"))
    release(classes)
    banded = settle(slim.select("row", "key").join(S.centres(slim), "key"))
    pairs = banded.where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct()
    x = sets.select(F.col("row").alias("a"), F.col("n").alias("m"), F.col("e").alias("g"), F.col("sketch").alias("x"))
    y = sets.select(F.col("row").alias("b"), "n", "e", F.col("sketch").alias("y"))
    likely = settle(map_arrow(pairs.join(x, "a").join(y, "b"), _likely(percent), "a long, b long, n long"))
    links = S.star(likely.select("a", "b", (F.col("n") * 8).alias("size")), sets, _confirm(percent), "a long, b long")
    roots = settle(components(links))
    at = S.placed(banded, roots)
    more = S.strays(at, sets.withColumn("size", F.col("n") * 8), _join_strays(percent), "a long, b long")
    release(slim, banded, likely, at, sets)
    found = settle(components(links.union(more)))
    release(links, more, roots)
    whole = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    least = whole.groupBy("root").agg(F.min("id").alias("least"))
    whole = whole.join(least, "root").select("id", "least")
    out = base.select("id", "n").join(whole, "id", "left")
    root = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))
