"""Operator 8: SentencePiece encoding by a relational lattice, and decoding.

All steps run on the arrays of one slab (a few megabytes of documents), so that nothing
is shuffled and a lost executor costs the slabs it had.

1. Texts are cut into words (a run of the blank mark and what follows up to the next; no
   piece of such a model reaches past one); each distinct word of a slab is encoded once.
2. Words of one length form a block.  Their substrings up to the longest piece are equi-joined
   to the piece table, one character at a time: (state, character) is the key, and
   states without a partner drop out.  What remains are the lattice's edges, by word.
3. A fold over each word's edges, all words of the block at once, takes the path that the
   model means.  A model of merges (BPE) defines it by merge order, not by the best sum of
   scores: each step joins the two neighbouring segments whose edge has the highest score,
   the leftmost of equals.  (A Viterbi fold over the sum of scores, as for unigram models,
   gives other ids than the library here, so only such models are taken.)  Characters
   without a piece become their bytes' pieces.
4. The words' ids are put in the order of each document.

Words of more than ``longest`` characters are rare and differ in length: each is folded
alone, by a queue of its joins instead of a search over all places.

Null and empty text: no ids.  Rows are told apart by their place, so null and repeated
ids are no matter, nor are other columns, whatever their names.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import map_arrow, only

MARK = "▁"
LONGEST = 48
#: Larger slabs have fewer distinct words in all.
SLAB = 2 << 20
#: Cells of one block's edges at most.
CELLS = 4_000_000
NEVER = np.iinfo(np.int32).max


@cache
def _load(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def _model(path: str) -> tuple[bytes, sentencepiece.SentencePieceProcessor]:
    with open(path, "rb") as f:
        proto = f.read()
    sp = _load(proto)
    probe = "　 xé́  ½\n"
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    # merges have whole scores, falling with the id
    scores = [sp.get_score(i) for i in range(len(pieces))]
    if not all(s <= 0 and s == int(s) for s in scores) or any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a BPE model whose pieces stay within words is needed")
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("a model without normalisation, with a blank put before the text, is needed")
    return proto, sp


class PieceTable:
    """The pieces that text can become, as sorted (state, character) keys; as large as the
    model, whatever the corpus."""

    def __init__(self, sp: sentencepiece.SentencePieceProcessor) -> None:
        states: dict[tuple[int, int], int] = {}
        ends = []
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            state = 0
            for c in sp.id_to_piece(i):
                state = states.setdefault((state, ord(c)), len(states) + 1)
            ends.append((state, i, -int(sp.get_score(i))))
        keys = np.array([(a << 21) | c for a, c in states], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(states.values()), dtype=np.int32)[order]
        self.ids = np.full(len(states) + 1, -1, dtype=np.int32)
        self.costs = np.full(len(states) + 1, NEVER, dtype=np.int32)
        for state, i, cost in ends:
            self.ids[state], self.costs[state] = i, cost
        self.longest = max(len(sp.id_to_piece(i)) for _, i, _ in ends)
        self.first_byte = next((i for i in range(sp.get_piece_size()) if sp.is_byte(i)), -1)
        self.unknown = sp.unk_id()

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The state after each character, -1 where no piece goes on so."""
        key = (state.astype(np.int64) << 21) | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)


@cache
def _table(proto: bytes) -> PieceTable:
    return PieceTable(_load(proto))


def lattice(words: np.ndarray, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """words (one a row, all of one length) to costs and ids of the edges, by word, start
    and length; cost NEVER and id -1 where a substring is no piece."""
    n, size = words.shape
    longest = min(table.longest, size)
    costs = np.full((n, size, longest + 1), NEVER, dtype=np.int32)
    ids = np.full((n, size, longest + 1), -1, dtype=np.int32)
    word, start = (x.reshape(-1) for x in np.indices((n, size)))
    state = np.zeros(len(word), dtype=np.int32)
    for length in range(1, longest + 1):
        fits = start + length <= size
        word, start, state = word[fits], start[fits], state[fits]
        state = table.step(state, words[word, start + length - 1])
        alive = state >= 0
        word, start, state = word[alive], start[alive], state[alive]
        if not len(word):
            break
        costs[word, start, length] = table.costs[state]
        ids[word, start, length] = table.ids[state]
    return costs, ids


def fold(costs: np.ndarray) -> np.ndarray:
    """Each word's segments after all joins: where the one from each start ends, 0 for
    places that start none."""
    n, size, longest = costs.shape[0], costs.shape[1], costs.shape[2] - 1
    stop = np.tile(np.arange(1, size + 1), (n, 1))
    before = np.tile(np.arange(-1, size), (n, 1))
    offer = np.full((n, size), NEVER, dtype=np.int32)
    if size > 1 and longest > 1:
        offer[:, :-1] = costs[:, :-1, 2]

    def cost(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        return np.where(length <= longest, costs[word, start, np.minimum(length, longest)], NEVER)

    word = np.arange(n)
    while len(word):
        start = offer[word].argmin(axis=1)  # the leftmost of equals
        on = offer[word, start] < NEVER
        word, start = word[on], start[on]
        if not len(word):
            break
        middle = stop[word, start]
        end = stop[word, middle]
        stop[word, start], stop[word, middle] = end, 0
        offer[word, middle] = offer[word, start] = NEVER
        before[word, np.minimum(end, size)] = start
        more = end < size
        w, s = word[more], start[more]
        offer[w, s] = cost(w, s, stop[w, end[more]])
        more = start > 0
        w, s = word[more], before[word[more], start[more]]
        offer[w, s] = cost(w, s, end[more])
    return stop


def fold_long(costs: np.ndarray) -> np.ndarray:
    """As ``fold``, of one long word, with the possible joins in a queue."""
    size, longest = costs.shape[1], costs.shape[2] - 1
    stop, before = list(range(1, size + 1)), list(range(-1, size))
    queue: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        end = stop[stop[start]] if stop[start] < size else 0
        if 0 < end - start <= longest and costs[0, start, end - start] < NEVER:
            heapq.heappush(queue, (int(costs[0, start, end - start]), start, end))

    for start in range(size):
        offer(start)
    while queue:
        _, start, end = heapq.heappop(queue)
        middle = stop[start]
        # joins that were offered before a neighbour changed
        if not middle or middle == size or stop[middle] != end:
            continue
        stop[start], stop[middle], before[end] = end, 0, start
        offer(start)
        if start:
            offer(before[start])
    return np.array([stop])


def _block(words: np.ndarray, table: PieceTable, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words of one length, one after the other, and how many each has."""
    costs, ids = lattice(words, table)
    stop = fold(costs) if words.shape[1] <= longest else fold_long(costs)
    word, start = np.nonzero(stop)
    found = ids[word, start, stop[word, start] - start]
    times = np.ones(len(found), dtype=np.int64)
    bare = np.flatnonzero(found < 0)
    if len(bare) and table.first_byte >= 0:
        chars = words[word[bare], start[bare]]
        times[bare] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        data = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
    out = np.repeat(found, times)
    if len(bare):
        out[out < 0] = data.astype(np.int32) + table.first_byte if table.first_byte >= 0 else table.unknown
    return out, np.bincount(word, times, minlength=len(words)).astype(np.int64)


def _spread(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of flat that begin at first, one after the other."""
    stop = np.cumsum(size)
    return flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(first - (stop - size), size)]


def word_spans(s: K.CodeSlab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slab's characters with a mark before each document and for each blank; start,
    end and document of each word."""
    codes = np.concatenate((s.data[:1], s.data[:-1]))
    codes[codes == 32] = ord(MARK)
    codes[s.start] = ord(MARK)  # where the separator before the document stands
    mark = codes == ord(MARK)
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    begins[s.start] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(codes))
    doc = np.searchsorted(s.start, start, side="right") - 1
    keep = (s.end > s.start)[doc]
    return codes, start[keep], end[keep], doc[keep]


def slab_ids(s: K.CodeSlab, proto: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the slab's documents, one after the other, and how many each has."""
    table = _table(proto)
    codes, start, end, doc = word_spans(s)
    _, first, word = np.unique(K.span_hash(K.prefix_hash(K.mix(codes.astype(K.U64) + K.U64(1))), start, end), return_index=True, return_inverse=True)
    at, size = start[first], (end - start)[first]
    parts: list[np.ndarray] = []
    begin, count, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), 0

    def add(rows: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        nonlocal total
        begin[rows], count[rows] = total + np.cumsum(n) - n, n
        parts.append(ids)
        total += len(ids)

    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, CELLS // (length * (min(table.longest, length) + 1))) if length <= longest else 1
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            add(some, *_block(codes[at[some][:, None] + np.arange(length)], table, longest))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return _spread(flat, begin[word], count[word]), np.bincount(doc, count[word], minlength=s.hi - s.lo).astype(np.int64)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, checked: bool = False) -> DataFrame:
    """Per row: its id, the piece ids of its text and their number n_pieces; ``checked``: also
    the SHA-256 of what the ids decode to, and whether that is the text."""
    proto, _ = _model(model_path)
    rows = only(df, id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = _piece_bytes(proto) if checked else None
        for s in K.code_slabs(batch.column(1), limit=SLAB):
            ids, n = slab_ids(s, proto, longest)
            offsets = np.concatenate(([0], np.cumsum(n)))
            out = [batch.column(0).slice(s.lo, s.hi - s.lo), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(n)]
            if checked:
                texts = batch.column(1).slice(s.lo, s.hi - s.lo).to_pylist()
                back = list(_texts(pa.array(ids, pa.int32()), offsets, pieces))
                out += [pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([(t or "").encode() == b for t, b in zip(texts, back, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "n_pieces", "decoded_sha256", "same"][: len(out)])

    more = ", decoded_sha256 string, same boolean" if checked else ""
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, n_pieces long{more}").withColumnRenamed("id", id_col)


@cache
def _piece_bytes(proto: bytes) -> pa.Array:
    """What each id becomes in a text, before the text's own blank is taken off."""
    sp = _load(proto)
    return pa.array([bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())], pa.binary())


def _texts(ids: pa.Array, offsets: np.ndarray, pieces: pa.Array) -> Iterator[bytes]:
    """The bytes of each text: its ids' pieces lie one after the other once they are taken."""
    taken = pieces.take(ids)
    _, edges, data = taken.buffers()
    edges = np.frombuffer(edges, np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    whole = memoryview(data) if data is not None else memoryview(b"")
    cut = edges[offsets].tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield bytes(whole[a + (a < b and whole[a : a + 1] == b" ") : b])


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and the text of its piece ids (null: null); bytes that aren't UTF-8
    become marks, ids that the model lacks are an error."""
    proto, _ = _model(model_path)
    rows = only(df, id=id_col, ids=ids_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        texts = [None if null else b.decode("utf-8", "replace") for b, null in zip(_texts(lists.flatten().cast(pa.int32()), offsets, _piece_bytes(proto)), lists.is_null().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
