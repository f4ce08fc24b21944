"""Operator 10: near-duplicate passages by compact windows.

Tokens are word shingles.  For a hash function, the runs of tokens whose least hash stands
at c are those from l..c to c..r, where l and r are c's bounds in the Cartesian tree of the
hashes: one compact window (l, c, r) stands for all of them, and windows under ``least``
tokens are dropped, which leaves about 2 / least of the tokens a function.

Passages with equal least tokens meet.  One shingle alone may be frequent, so a window is
keyed by its token and the one ``REACH`` tokens after it, and by its token and the one
``REACH`` before it; a passage keeps one of both inside.  Exact copies form one text.  The
texts of a key are verified against the key's centre, the text whose keys have the most
members; those that this leaves outside the centre's component against the members of the
component's keys, in blocks (``stars``).  So no pair that isn't confirmed becomes a row.

Verification takes whole texts: a run of ``least`` tokens counts if the share of its tokens
that the other text's runs have gives a similarity of ``percent`` or more.  A document's
result are the class, the least document reachable over confirmed pairs, and the merged
spans of its runs against every text that it was verified with: the centres of its keys,
and for strays one of each component that they join.  (Where two texts share more with
each other than with their centre, a span may end early; no text of a class is without.)
Copies confirm their whole text.  A near copy is missed only if no key is shared: with
FUNCTIONS functions and two keys a window that takes an edit beside each of its least
shingles.

Null and short texts: no spans, a class of their own.  Null ids take no part.  Rows of one
id with different texts are compared like others, and each row has its own result.  Other
columns don't matter, whatever their names; an empty table gives an empty result.
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
from .near_dedup import ascii_space_words

FUNCTIONS, REACH = 4, 15
#: Tokens of the pairs that are verified at a time, but for one pair of more.
BATCH = 1 << 19


def tokens(s: K.Slab, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each shingle; documents of fewer words have none."""
    _, _, doc, word = K.words(s, ascii_space_words())
    if len(word) < shingle:
        return np.zeros(0, np.int64), np.zeros(0, K.U64)
    h = K.window_hash(K.prefix_hash(word), shingle)
    n = len(word) - shingle + 1
    ok = doc[:n] == doc[shingle - 1 :]
    return doc[:n][ok], np.append(h, K.span_hash(K.prefix_hash(word), np.array([n - 1]), np.array([len(word)])) if len(h) < n else h[:0])[:n][ok]


def compact_windows(doc: np.ndarray, h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and centres (l, c, r inclusive) of the tree's windows of ``least`` tokens and more."""
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    first = np.searchsorted(doc, doc)
    last = np.searchsorted(doc, doc, side="right") - 1
    # levels[k][i]: the least of 2**k hashes from i on
    levels, size = [h], 1
    longest = int((last - first).max()) + 1
    while size * 2 <= longest:
        x = levels[-1]
        levels.append(np.minimum(x[: len(x) - size], x[size:]))
        size *= 2
    k = int(least).bit_length() - 1
    run = np.minimum(levels[k][: n - least + 1], levels[k][least - (1 << k) : least - (1 << k) + n - least + 1]) if len(levels) > k else h[:0]
    if not len(run):
        return none, none, none
    # a centre is the least of some run of ``least`` tokens of its document: it equals the
    # highest of the leasts of the runs that hold it
    edge = np.zeros(least - 1, dtype=K.U64)
    highest = np.concatenate((edge, np.where(doc[: n - least + 1] == doc[least - 1 :], run, K.U64(0)), edge))
    width = 1
    while width * 2 <= least:
        highest = np.maximum(highest[:-width], highest[width:])
        width *= 2
    rest = least - width
    c = np.flatnonzero(np.maximum(highest[: len(highest) - rest], highest[rest:]) == h)
    if not len(c):
        return none, none, none
    left, right, value = c.copy(), c.copy(), h[c]
    for k in reversed(range(len(levels))):
        step, x = 1 << k, levels[k]
        ok = left - step >= first[c]
        # to the left strictly greater, to the right also equal: of equal hashes the first is the centre
        ok[ok] = x[left[ok] - step] > value[ok]
        left = np.where(ok, left - step, left)
        ok = right + step <= last[c]
        ok[ok] = x[right[ok] + 1] >= value[ok]
        right = np.where(ok, right + step, right)
    keep = right - left + 1 >= least
    return left[keep], c[keep], right[keep]


def keyed_windows(doc: np.ndarray, h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and bounds (inclusive) of the windows of all functions, one for each key of a window."""
    found = []
    for f in range(FUNCTIONS):
        x = K.mix(h ^ K.mix(np.array([f + 1], dtype=K.U64))[0])
        left, c, right = compact_windows(doc, x, least)
        for sign in (1, -1):
            other = c + sign * REACH
            ok = (other >= left) & (other <= right)
            key = K.mix(K.mix(h[c[ok]] + K.U64(2 + sign)) ^ h[other[ok]])
            found.append((key.view(np.int64), left[ok], right[ok]))
    key, left, right = (np.concatenate(v) for v in zip(*found, strict=True))
    return key, left, right


def _keys(shingle: int, least: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in K.slabs(batch.column(1), 0x20):
            doc, h = tokens(s, shingle)
            if not len(h):
                continue
            key, left, _ = keyed_windows(doc, h, least)
            d, key = K.distinct_pairs(doc[left], key)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d + s.lo)), pa.array(key)], names=["row", "key"])

    return run


def _sets(shingle: int):
    """Each text's tokens by 32 bits: a chance match changes one token in 46."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for s in K.slabs(batch.column(1), 0x20):
            doc, h = tokens(s, shingle)
            first = np.searchsorted(doc, np.arange(s.hi - s.lo + 1))
            data = (h >> K.U64(32)).astype(np.uint32).view(np.uint8)
            own = pa.Array.from_buffers(pa.binary(), s.hi - s.lo, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(np.diff(first) * 4), own], names=["row", "size", "own"])

    return run


def matched(x: np.ndarray, part: np.ndarray, other: np.ndarray, least: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the merged runs of ``least`` tokens of x of which ``other`` has
    ``needed`` or more.  Tokens carry their pair in the upper bits; a run keeps to one part."""
    if len(x) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.concatenate(([0], np.cumsum(np.isin(x, other))))
    good = np.flatnonzero((both[least:] - both[:-least] >= needed) & (part[least - 1 :] == part[: len(x) - least + 1]))
    cover = np.bincount(good, minlength=len(x) + 1) - np.bincount(good + least, minlength=len(x) + 1)
    inside = np.cumsum(cover[:-1]) > 0
    turn = np.concatenate(([True], part[1:] != part[:-1], [True]))
    begins = inside & (turn[:-1] | np.concatenate(([True], ~inside[:-1])))
    ends = inside & (turn[1:] | np.concatenate((~inside[1:], [True])))
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


Run = tuple[int, int]


def verified(pairs: list[tuple[np.ndarray, np.ndarray]], least: int, needed: int) -> Iterator[tuple[int, list[Run], list[Run]]]:
    """Of pairs of texts' tokens the confirmed ones, by number, with the runs of both sides."""

    def side(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens under their pair's number, their pair, and where each pair's begin."""
        size = np.array([len(v) for v in own])
        part = np.repeat(np.arange(len(own)), size)
        return np.concatenate(own).astype(K.U64) | (part.astype(K.U64) << K.U64(32)), part, np.cumsum(size) - size

    def within(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return x[np.cumsum(np.bincount(a, minlength=len(x) + 1) - np.bincount(b, minlength=len(x) + 1))[:-1] > 0]

    def runs(part: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[int, list[Run]]:
        out: dict[int, list[Run]] = {}
        for p, l, r in zip(part[a].tolist(), (a - first[part[a]]).tolist(), (b - first[part[a]]).tolist(), strict=True):
            out.setdefault(p, []).append((l, r))
        return out

    lo = 0
    while lo < len(pairs):
        hi, total = lo, 0
        while hi < len(pairs) and (hi == lo or total + len(pairs[hi][0]) + len(pairs[hi][1]) <= BATCH):
            total += len(pairs[hi][0]) + len(pairs[hi][1])
            hi += 1
        (x, part_x, first_x), (y, part_y, first_y) = side([p for p, _ in pairs[lo:hi]]), side([q for _, q in pairs[lo:hi]])
        # each side's runs against the other's runs, not against tokens scattered over it
        own_y = matched(y, part_y, x, least, needed)
        own_x = matched(x, part_x, within(y, *own_y), least, needed)
        own_y = matched(y, part_y, within(x, *own_x), least, needed)
        left, right = runs(part_x, first_x, *own_x), runs(part_y, first_y, *own_y)
        for p in sorted(left.keys() & right.keys()):
            yield lo + p, left[p], right[p]
        lo = hi


class Found:
    """Links and, per text, merged runs; as a table with a row for each."""

    def __init__(self) -> None:
        self.links: list[tuple[int, int]] = []
        self.runs: dict[int, list[Run]] = {}

    def add(self, row: int, runs: list[Run]) -> None:
        own = self.runs.setdefault(row, [])
        own += runs
        if len(own) > 64:
            self.runs[row] = union(own)

    def table(self) -> pa.Table:
        a, b = ([v[k] for v in self.links] + [None] * len(self.runs) for k in (0, 1))
        rows = [None] * len(self.links) + list(self.runs)
        spans = [None] * len(self.links) + [[e for run in union(v) for e in run] for v in self.runs.values()]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "row": pa.array(rows, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))})


FOUND = "a long, b long, row long, spans array<long>"


def union(runs: list[Run]) -> list[Run]:
    out: list[Run] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _tokens(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint32) for v in column]


def _verify(least: int, needed: int):
    """Texts against their centres."""

    def run(pairs: pa.Table, centres: pa.Table) -> pa.Table:
        sets = dict(zip(centres["a"].to_pylist(), _tokens(centres["own"]), strict=True))
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        found = Found()
        for k, x, y in verified([(sets[c], own) for c, own in zip(a, _tokens(pairs["own"]), strict=True)], least, needed):
            found.links.append((a[k], b[k]))
            found.add(a[k], x)
            found.add(b[k], y)
        return found.table()

    return run


def _verify_strays(least: int, needed: int):
    """Strays against members: one confirmed pair for each component that a stray joins."""

    def run(strays: pa.Table, members: pa.Table) -> pa.Table:
        found = Found()
        for x, y in S.blocks(strays, members):
            joined = S.Joined()
            row, root = (S.numbers(x[c]) for c in ("row", "root"))
            row2, root2, stray = (S.numbers(y[c]) for c in ("row", "root", "stray"))
            own, own2 = _tokens(x["own"]), _tokens(y["own"])
            # the distinct (token, text) of the members, by token
            size = np.array([len(v) for v in own2])
            flat = np.unique((np.concatenate(own2).astype(K.U64) << K.U64(32)) | np.repeat(np.arange(len(own2)), size).astype(K.U64))
            word, of = (flat >> K.U64(32)).astype(np.uint32), (flat & K.U64(0xFFFFFFFF)).astype(np.int64)
            for i, tokens_i in enumerate(own):
                lo, hi = np.searchsorted(word, tokens_i), np.searchsorted(word, tokens_i, side="right")
                times = hi - lo
                at = np.repeat(np.arange(len(tokens_i)), times)
                text = of[np.arange(len(at)) + np.repeat(lo - (np.cumsum(times) - times), times)]
                # two strays meet once, by their numbers
                ok = ((root2 != root[i]) & (~stray | (row2 > row[i])))[text]
                at, text = at[ok], text[ok]
                order = np.argsort(text, kind="stable")
                at, text = at[order], text[order]
                # texts that have ``needed`` of some run of ``least`` tokens
                n = max(0, len(at) - needed + 1)
                near = (text[needed - 1 :] == text[:n]) & (at[needed - 1 :] - at[:n] < least)
                for j in np.unique(text[:n][near]).tolist():
                    a, b = int(root[i]), int(root2[j])
                    if joined.root(a) == joined.root(b):
                        continue
                    for _, p, q in verified([(tokens_i, own2[j])], least, needed):
                        joined.join(a, b)
                        found.links.append((int(row[i]), int(row2[j])))
                        found.add(int(row[i]), p)
                        found.add(int(row2[j]), q)
        return found.table()

    return run


def near_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: its id, n_spans, spans (start and end in words, alternating, merged) and class_id."""
    least = words - shingle + 1
    # m of n shared in both: m / (2 n - m) >= percent / 100
    needed = -(-2 * least * percent // (100 + percent))
    rows = only(df, id=id_col, text=text_col)
    part = rows.where("id is not null and text is not null").select("id", F.xxhash64("text").alias("row"), "text")
    texts = settle(part.groupBy("row").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("copies"), F.first("text").alias("text")))
    keys = map_arrow(texts.select("row", "text"), _keys(shingle, least), "row long, key long")
    # a key of one text alone links nothing
    members = settle(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    slim = settle(keys.join(members, "key"))
    needed_texts = texts.select("row", "text").join(slim.select("row").distinct(), "row", "left_semi")
    sets = settle(map_arrow(needed_texts, _sets(shingle), "row long, size long, own binary"))
    banded = settle(slim.select("row", "key").join(S.centres(slim), "key"))
    pairs = banded.where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct()
    pairs = settle(pairs.join(sets.select(F.col("row").alias("b"), "size"), "b").select("a", "b", "size"))
    link = lambda t: t.where("a is not null").select("a", "b")
    stars = S.star(pairs, sets, _verify(least, needed), FOUND)
    roots = settle(components(link(stars)))
    at = S.placed(banded, roots)
    more = S.strays(at, sets, _verify_strays(least, needed), FOUND)
    classes = settle(components(link(stars).union(link(more)))).withColumnRenamed("node", "row")
    # a text of several ids is confirmed whole by its copies
    n_words = F.size(F.filter(F.split("text", "[\\t\\n\\x0B\\f\\r ]+", -1), lambda w: w != "")).cast("long")
    copies = settle(texts.where("copies").select("row", n_words.alias("n")).where(f"n >= {words}"))
    release(members, slim, sets, banded, pairs, roots, at)
    # a text that only its copies confirm is a class too
    alone = copies.select("row").join(classes.select("row"), "row", "left_anti").select("row", F.col("row").alias("root"))
    # tokens to words; a text has a few of these, one from each task that it was in
    edges = F.expr(f"transform(sequence(0, size(spans) div 2 - 1), i -> struct(spans[2 * i] as a, spans[2 * i + 1] + {shingle - 1} as b))")
    spans = stars.union(more).where("row is not null").select("row", F.explode(edges).alias("s"))
    spans = spans.union(copies.select("row", F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))))
    merged = F.expr("""aggregate(s, cast(array() as array<bigint>), (m, e) ->
        if(size(m) > 0 and e.a <= get(m, size(m) - 1), concat(slice(m, 1, size(m) - 1), array(greatest(get(m, size(m) - 1), e.b))), concat(m, array(e.a, e.b))))""")
    found = spans.groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("s")).select("row", merged.alias("spans"))
    least_id = classes.union(alone).join(texts.select("row", "id"), "row").groupBy("root").agg(F.min("id").alias("class"))
    by_text = settle(found.join(classes.union(alone), "row").join(least_id, "root").select("row", "spans", "class"))
    release(stars, more, texts, copies)
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.xxhash64("text")).alias("row")).join(by_text, "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<bigint>"))
    return out.select(F.col("id").alias(id_col), F.expr("size(coalesce(spans, array())) div 2").cast("long").alias("n_spans"), spans.alias("spans"), F.coalesce("class", "id").alias("class_id"))
