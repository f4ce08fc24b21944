"""Which texts have word sets with a Jaccard similarity over a threshold: exact, without a row for each candidate pair.

1. A set is its words' 64-bit hashes in one order for all, by how often a sample of documents holds a word, then by hash; the order
   decides what a join costs, not what it finds.  Texts of equal sets are one class.
2. Two linked classes differ in a bounded number of words.  Words are dealt to parts of 100 to 200 words of the smaller set, by hash, so
   some part has no more than its share of the differences.  If the sets share a word there, the first words of both parts, one more
   than the differences, hold it; parts that are all differences meet by a key of their own.  An entry (word, class, size, parity of
   the part's hashed words in 128 bits) is a row; entries of a word meet in tasks, where parities that differ in more bits than the share end
   it, as they differ in no more bits than the parts in words.  What is left joins components, at most as many edges of a task as classes.
3. So linked classes lie in one component of these edges.  A component's sets meet in cells of two parts of about ``TASK`` bytes, a
   cell in a task, where all intersections are counted; only what was asked for comes out: sums, or the pairs that are links.
   Only texts whose ids a bitmap of the components' ids may hold are dealt for that.

A group's comparisons are quadratic in its size, rows and memory aren't, but for the pairs that ``similar_pairs`` gives."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.llm.common import map_arrow, release, settle
from lodestone.llm.components import components

#: Entries of a word of which all pairs are compared at once; bytes of sets, entries, words of texts in a task or step.
FEW, TASK, ENTRIES, STEP = 1024, 8 << 20, 1 << 16, 1 << 20
#: Documents and words that the order of words is made of; elements of the matrices in a task.
SAMPLE, WORDS, CELL = 20_000, 200_000, 4 << 20
#: Against rounding of products with the threshold: bounds are less by this.
SLACK = 1e-6


def _hashes(text: Column) -> Column:
    return F.transform(T.word_set(text), lambda w: F.xxhash64(w))


def _order(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words that a sample has more than once, as ascending hashes, and their places by number of documents."""
    every = max(1, -(-rows.count() // SAMPLE))
    words = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode(_hashes(F.col("text"))).alias("word"))
    found = words.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(WORDS).toPandas()
    word = found["word"].to_numpy(np.int64)[::-1]
    by_hash = np.argsort(word)
    return word[by_hash], (by_hash + 1).astype(np.int32)


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes | None], np.ndarray]:
    """The texts of lists of hashes: text and hash of each element, ascending; digests; sizes."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    doc, h = np.repeat(np.arange(len(size)), size), column.flatten().to_numpy(zero_copy_only=False)
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    n = np.bincount(doc, minlength=len(size))
    edge = np.append(0, np.cumsum(n))
    keys = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return doc, h, keys, n


def _parts(n: np.ndarray) -> np.ndarray:
    """Into how many parts, a power of two, two sets are dealt of which the smaller has n words."""
    return np.left_shift(1, np.maximum(np.frexp(n // 100)[1] - 1, 0))


def _entries(least: float, n: np.ndarray, doc: np.ndarray, h: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each part (document, parity in two integers, number of entries) and the entries' words, from sets in ascending order of documents and hashes."""
    out = []
    share = (1 - least) / (1 + least)
    own, lowest = _parts(n), _parts(np.ceil(n * least - SLACK).astype(np.int64))
    level = own
    while True:
        use = np.flatnonzero((level >= lowest) & (n > 0))
        if not len(use):
            break
        k = level[use]
        # how many words may differ in a part, whatever the partner's size
        other = np.where(k == own[use], np.floor(n[use] / least + SLACK), np.minimum(n[use], 200 * k)).astype(np.int64)
        most = np.floor((n[use] + other) * share + SLACK).astype(np.int64) // k
        at = np.full(len(n), -1)
        at[use] = np.arange(len(use))
        inside = at[doc] >= 0
        of, word, place = at[doc[inside]], h[inside], rank[inside]
        first = np.cumsum(k) - k
        part = first[of] + (word & (k[of] - 1))
        by = np.argsort(part << 20 | place, kind="stable")
        part, word = part[by], word[by]
        size = np.bincount(part, minlength=k.sum())
        start = np.cumsum(size) - size
        some = np.flatnonzero(size)
        bit = word >> 32 & 127
        parity = np.zeros((2, len(size)), dtype=np.int64)
        one = np.left_shift(np.int64(1), bit & 63)
        for c in (0, 1):
            parity[c, some] = np.bitwise_xor.reduceat(np.where(bit >> 6 == c, one, 0), start[some])
        owner = np.repeat(np.arange(len(use)), k)
        taken = np.arange(len(word)) - start[part] <= most[owner[part]]
        salt = (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        short = np.flatnonzero(size <= most[owner])
        segment = np.concatenate([part[taken], short])
        key = np.concatenate([word[taken], -1 - (short - first[owner[short]])]) ^ salt[owner[segment]]
        by = np.argsort(segment, kind="stable")
        out.append((use[owner], *parity, np.bincount(segment, minlength=len(size)), key[by]))
        if (k == 1).all():
            break
        level = np.where(level > 1, level >> 1, 0)
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    of, x, y, count, key = (np.concatenate(c) for c in zip(*out, strict=True))
    by = np.argsort(of, kind="stable")
    start = np.cumsum(count) - count
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count[by]) - count[by], count[by]) + np.repeat(start[by], count[by])
    return of[by], x[by], y[by], count[by], key[at]


def _lists(offset: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(offset)).astype(np.int32)), values)


def _signed(least: float, word: np.ndarray, place: np.ndarray):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, h, keys, n = _sets(batch.column(1))
        rank = np.zeros(len(h), dtype=np.int64)
        if len(word):
            at = np.minimum(np.searchsorted(word, h), len(word) - 1)
            rank = np.where(word[at] == h, place[at], 0).astype(np.int64)
        of, x, y, count, key = _entries(least, n, doc, h, rank)
        parts = pa.StructArray.from_arrays([pa.array(x), pa.array(y), _lists(count, pa.array(key))], names=["x", "y", "words"])
        total = np.bincount(of, weights=count, minlength=len(n)).astype(np.int64)
        columns = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(total), _lists(np.bincount(of, minlength=len(n)), parts)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", "entries", "parts"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        turn = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // STEP
        edge = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield step(batch.slice(a, b - a))

    return run


def _own(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose digest is the class's."""
    _, h, keys, n = _sets(batch.column(0))
    edge = pa.array(np.append(0, np.cumsum(n) * 8).astype(np.int32))
    own = pa.Array.from_buffers(pa.binary(), len(n), [None, edge.buffers()[1], pa.py_buffer(np.ascontiguousarray(h).view(np.uint8))])
    same = pa.array([a == b for a, b in zip(keys, batch.column("key").to_pylist(), strict=True)], pa.bool_())
    names = ["row", "root", "parts", "part", "copies"]
    yield pa.RecordBatch.from_arrays([c.filter(same) for c in [*(batch.column(c) for c in names), own]], names=[*names, "own"])


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows of the matrix of how many elements each of x has in common with each of y, with their first row."""
    size = np.array([len(v) for v in y])
    of, token = np.repeat(np.arange(len(y)), size), np.concatenate(y)
    by = np.argsort(token, kind="stable")
    of, (token, start, df) = of[by], np.unique(token[by], return_index=True, return_counts=True)
    # tokens of many sets by a matrix product, the others by their lists
    most = min(4096, 4 * CELL // max(len(y), 1))
    many = np.flatnonzero(df >= max(16, len(y) // 64))
    many = many[np.argsort(-df[many], kind="stable")][:most]
    column = np.full(len(token), -1)
    column[many] = np.arange(len(many))
    right = np.zeros((len(many), len(y)), dtype=np.float32)
    for c, k in enumerate(many):
        right[c, of[start[k] : start[k] + df[k]]] = 1
    step = max(1, min(64, CELL // len(y)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        row, h = np.repeat(np.arange(len(part)), [len(v) for v in part]), np.concatenate(part)
        k = np.minimum(np.searchsorted(token, h), len(token) - 1)
        hit = token[k] == h
        row, k = row[hit], k[hit]
        dense = column[k] >= 0
        left = np.zeros((len(part), len(many)), dtype=np.float32)
        left[row[dense], column[k[dense]]] = 1
        both = np.rint(left @ right).astype(np.int64)
        row, k = row[~dense], k[~dense]
        # in turns, so that lists of frequent words that have no column don't add up
        turn = np.cumsum(df[k]) // CELL
        for t in np.unique(turn):
            r, s, d = row[turn == t], start[k[turn == t]], df[k[turn == t]]
            at = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d) + np.repeat(s, d)
            both += np.bincount(np.repeat(r, d) * len(y) + of[at], minlength=both.size).reshape(both.shape)
        yield lo, both


def _meet(least: float, pairs: bool):
    """Of each cell the links: pairs (a, b, elements in common), or (a, null, documents that a is linked with) of its rows and links that join components."""

    def cell(t: pa.Table, out: list[np.ndarray]) -> None:
        row, first = np.unique(t["row"].to_numpy(), return_index=True)  # a repeated id may bring a set twice
        t = t.take(pa.array(first))
        part, copies = t["part"].to_numpy(), t["copies"].to_numpy()
        own = [np.frombuffer(v.as_buffer(), np.int64) for v in t["own"]]
        n = np.array([len(v) for v in own])
        left, right = (np.flatnonzero(part == t[c][0].as_py()) for c in ("i", "j"))
        if not len(left) or not len(right):
            return
        same = left[0] == right[0]
        links, above, edges = np.zeros(len(row), dtype=np.int64), np.arange(len(row)), []
        for lo, both in _intersections([own[k] for k in left], [own[k] for k in right]):
            x = left[lo : lo + len(both)]
            like = both / (n[x][:, None] + n[right][None, :] - both) > least
            if same:
                like &= right[None, :] > x[:, None]
            if pairs:
                a, b = np.nonzero(like)
                out.append(np.stack([row[x[a]], row[right[b]], both[a, b], np.ones(len(a), dtype=np.int64)]))
                continue
            links[x] += like @ copies[right]
            links[right] += copies[x] @ like
            for k, v in zip(x, like, strict=True):
                hits = np.append(k, right[v])
                if len(hits) > 1:
                    top = above[hits]
                    while (above[top] != top).any():
                        top = above[top]
                    roots, one = np.unique(top, return_index=True)
                    above[hits] = above[roots] = roots[0]
                    edges += [(row[k], row[h]) for h in hits[one] if h != k] if len(roots) > 1 else []
        if not pairs:
            some = links > 0
            out.append(np.stack([row[some], row[some], links[some], np.zeros(some.sum(), dtype=np.int64)]))
            if edges:
                a, b = np.array(edges, dtype=np.int64).T
                out.append(np.stack([a, b, np.zeros_like(a), np.ones_like(a)]))

    def run(t: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((4, 0), dtype=np.int64)]
        t = t.sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending")])
        v = np.stack([t[c].to_numpy().astype(np.int64) for c in ("root", "i", "j")])
        edge = [0, *(np.flatnonzero((v[:, 1:] != v[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            cell(t.slice(a, b - a), out)
        a, b, links, pair = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b, mask=pair == 0), "links": pa.array(links)})

    return run


def _near(least: float):
    """Edges (a, b) that join the classes of each word whose parts may differ in few enough words, from a bucket's entries."""
    share = (1 - least) / (1 + least)

    def run(t: pa.Table) -> pa.Table:
        word, node, n, x, y = (t[c].to_numpy().astype(np.int64) for c in ("word", "node", "n", "x", "y"))
        by = np.lexsort((node, n, word))
        # copies have the same entries; words of one class join nothing
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = (word[by][1:] != word[by][:-1]) | (node[by][1:] != node[by][:-1])
        by = by[fresh]
        _, of, size = np.unique(word[by], return_inverse=True, return_counts=True)
        by, of = by[size[of] > 1], of[size[of] > 1]
        # bits are counted of numbers without a sign
        node, n, x, y = node[by], n[by], x[by].view(np.uint64), y[by].view(np.uint64)
        ids, code = np.unique(node, return_inverse=True)
        above = np.arange(len(ids))
        parts = _parts(n)

        def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Joins the classes of the pairs of entries that may be near; which these are."""
            nonlocal above
            less = np.minimum(n[a], n[b])
            most = np.floor((n[a] + n[b]) * share + SLACK).astype(np.int64) // np.where(n[a] == less, parts[a], parts[b])
            near = (np.bitwise_count(x[a] ^ x[b]) + np.bitwise_count(y[a] ^ y[b]) <= most) & (less >= np.maximum(n[a], n[b]) * least - SLACK)
            p, q = code[a[near]], code[b[near]]
            while len(p):
                p, q = above[p], above[q]
                apart = p != q
                p, q = np.minimum(p, q)[apart], np.maximum(p, q)[apart]
                np.minimum.at(above, q, p)
                while (above[above] != above).any():
                    above = above[above]
            return near

        place = of << 32
        end = np.searchsorted(place + n, place + np.floor(n / least + SLACK).astype(np.int64), "right")
        edge = np.append(0, np.cumsum(np.bincount(of, minlength=1)))
        long = np.diff(edge) > FEW
        partners = np.where(long[of], 0, end - np.arange(len(of)) - 1) if len(of) else np.zeros(0, dtype=np.int64)
        turn = np.cumsum(partners) // CELL
        for k in np.unique(turn):
            a = np.flatnonzero((turn == k) & (partners > 0))
            m = partners[a]
            join(np.repeat(a, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a + 1, m))
        # long lists: those near to the middle are joined by it, only the others meet all
        for k in np.flatnonzero(long):
            every = np.arange(edge[k], edge[k + 1])
            middle = join(np.full(len(every), every[len(every) // 2]), every)
            for one in every[~middle]:
                lo = np.searchsorted(n[edge[k] : edge[k + 1]], np.ceil(n[one] * least - SLACK)) + edge[k]
                other = np.arange(lo, end[one])
                join(np.full(len(other), one), other)
        low = np.flatnonzero(above != np.arange(len(above)))
        return pa.table({"a": pa.array(ids[above[low]]), "b": pa.array(ids[low])})

    return run


def _edges(made: DataFrame, least: float) -> DataFrame:
    """(a, b) of classes' hashes so that linked classes are in one component."""
    buckets = max(1, -(-int(made.agg(F.sum("entries")).first()[0] or 0) // ENTRIES))
    parts = made.select(F.xxhash64("key").alias("node"), F.col("n").cast("int").alias("n"), F.explode("parts").alias("p"))
    entries = parts.select("node", "n", "p.x", "p.y", F.explode("p.words").alias("word"))
    return entries.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(_near(least), "a long, b long")


def _held(rows: DataFrame, at: DataFrame) -> DataFrame:
    """The rows whose ids a bitmap of those of ``at`` has: all of these, and some sixteenth of the others."""
    bits = 1 << max(10, (16 * at.count()).bit_length())
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    found = at.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("nth")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("held")).toPandas()
    bitmap = np.zeros(bits >> 6, dtype=np.int64)
    bitmap[found["nth"].to_numpy(np.int64)] = found["held"].to_numpy(np.int64)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = batch.column(2).to_numpy(zero_copy_only=False)
        yield batch.select([0, 1]).filter(pa.array((bitmap[p >> 6] >> (p & 63) & 1).astype(bool)))

    return map_arrow(rows.select("id", "text", place.alias("place")), run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def _links(docs: DataFrame, least: float, id_col: str, text_col: str, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, n, key), classes (key, row, id, n, copies) and what the cells give of classes' rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = map_arrow(rows.select("id", _hashes(F.col("text")).alias("h")), _signed(least, *_order(rows)), f"id {kind}, n long, key binary, entries long, parts array<struct<x: long, y: long, words: array<long>>>")
    made = settle(made.withColumn("row", F.monotonically_increasing_id()))
    classes = settle(made.where("n > 0 and id is not null").groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies")))
    roots = settle(components(_edges(made.where("n > 0 and id is not null"), least)))
    own = classes.withColumn("node", F.xxhash64("key"))
    parts = roots.join(own, "node").groupBy("root").agg(F.ceil(F.sum("n") * 8 / TASK).cast("int").alias("parts"))
    at = roots.join(own, "node").select("id", "key", "row", "root", "n", "copies").join(parts, "root")
    at = settle(at.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")))
    buckets = max(1, -(-int(at.agg(F.sum(F.col("n") * 8 * F.col("parts"))).first()[0] or 0) // TASK))
    texts = _held(rows, at).join(at.hint("merge"), "id").select(_hashes(F.col("text")).alias("h"), "key", "row", "root", "parts", "part", "copies")
    own = map_arrow(texts, _own, "row long, root long, parts int, part int, copies long, own binary")
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    cells = cells.select(F.pmod(F.xxhash64("root", "i", "j"), F.lit(buckets)).alias("bucket"), "root", "i", "j", "part", "row", "copies", "own")
    found = settle(cells.groupBy("bucket").applyInArrow(_meet(least, pairs), "a long, b long, links long"))
    release(roots, at)
    return made, classes, found


def similar_pairs(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, similarity) of texts whose word sets have a Jaccard similarity over ``least``; equal sets meet as one, their other
    texts with the least id."""
    made, classes, found = _links(docs, least, id_col, text_col, True)
    own = classes.select("row", "id", "n")
    both = found.join(own.toDF("a", "x", "n"), "a").join(own.toDF("b", "y", "m"), "b")
    alike = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("links") / (F.col("n") + F.col("m") - F.col("links"))).alias("similarity"))
    copies = made.select("id", "key").join(classes.select("key", F.col("id").alias("a")), "key").where("a < id")
    return alike.unionByName(copies.select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def similar_classes(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, class_id (the least id reachable by links) and n_links: how many other documents have word sets with a
    Jaccard similarity over ``least``, those of the same set among them.  Documents without words or id have none."""
    made, classes, found = _links(docs, least, id_col, text_col, False)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "row")
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "row")
    whole = classes.join(links, "row", "left").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    whole = settle(whole.select("key", "id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    top = whole.groupBy("root").agg(F.min("id").alias("class_id"))
    of = whole.join(top, "root").select("key", "class_id", "n_links")
    # a document without id isn't in its set's class
    out = made.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(of, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
