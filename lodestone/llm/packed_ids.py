"""Operator 11: token ids in files of fixed-width bits, with block offsets.

1. Rows are dealt by ranges of the id and sorted by it.  Each task encodes its texts and packs the ids, the end
   id behind each document's, into shards of about ``SHARD_IDS`` ids.  A shard becomes one file of Spark's own
   writer, so it is committed with its task, whatever store the folder lies in.
2. The files are read back.  A shard's start is the number of ids in the shards before it: a running sum over
   one row a shard.

A tokenizer that drops white space encodes each run of other characters alone, so the library encodes each distinct one
once while a worker remembers it (``MEMO``), and texts of any length go through in pieces cut at blanks.
Any other tokenizer encodes whole texts.  Whether it drops white space is tried out, not assumed.

The file, little-endian: ``HEADER`` (mark, bits an id, ids a block, partition, place in it, documents, ids, blocks);
for each block its byte offset, and the end of the last; for each document the number of ids up to its end; for each
document the length of its id as text, -1 for null; those texts, and zeros up to eight bytes; the blocks; one line feed.
A block holds its ids one behind the other, ``bits`` each, from the lowest bit up, in 64-bit words.

Null text counts as empty: a document of the end id alone.  Rows without id come first; rows of one id follow each
other in the order of a hash of their text.  Other columns don't matter, whatever their names.  An empty
table gives no file and an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import only, settle

MARK = b"PACKEDID"
HEADER = struct.Struct("<8sIIQQQQQ")
BLOCK_IDS, SHARD_IDS = 1 << 16, 4 << 20
#: Words that a worker remembers at most, and their bytes; a piece of text that is encoded at once.
MEMO, MEMO_BYTES, PIECE = 1_000_000, 48 << 20, 1 << 20
BLANKS = b" \t\n\r\v\f"


# --- bits


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """The ids, ``bits`` each; 64 of them fill ``bits`` words of 64 bits, the last ones with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, dtype=np.uint64)
    lanes[: len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.reshape(groups, 64).T)
    words = np.zeros((bits, groups), dtype=np.uint64)
    for j in range(64):
        at, shift = divmod(j * bits, 64)
        words[at] |= lanes[j] << np.uint64(shift)
        if shift + bits > 64:
            words[at + 1] |= lanes[j] >> np.uint64(64 - shift)
    return words.T.astype("<u8").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int) -> np.ndarray:
    """All ids of whole groups of 64, the zeros at the end included."""
    words = np.ascontiguousarray(np.frombuffer(data, dtype="<u8").reshape(-1, bits).T)
    lanes, mask = np.empty((64, words.shape[1]), dtype=np.uint32), np.uint64((1 << bits) - 1)
    for j in range(64):
        at, shift = divmod(j * bits, 64)
        value = words[at] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[at + 1] << np.uint64(64 - shift))
        lanes[j] = value & mask
    return lanes.T.reshape(-1)


class Shard:
    """A file of packed ids: bytes, a memory map, or anything else with a buffer."""

    def __init__(self, data: bytes | memoryview) -> None:
        self.data = memoryview(data)
        mark, self.bits, self.block_ids, self.part, self.place, docs, self.n_ids, blocks = HEADER.unpack_from(self.data)
        if mark != MARK:
            raise ValueError("not a file of packed ids")
        at = HEADER.size
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        self.ends = np.frombuffer(self.data, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self._sizes = np.frombuffer(self.data, "<i4", docs, at).astype(np.int64)
        self._names_at = at + 4 * docs

    def names(self) -> list[str | None]:
        """The documents' ids as text."""
        end = np.cumsum(np.maximum(self._sizes, 0))
        raw = bytes(self.data[self._names_at : self._names_at + int(end[-1] if len(end) else 0)])
        return [None if n < 0 else raw[e - n : e].decode() for e, n in zip(end.tolist(), self._sizes.tolist(), strict=True)]

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids lo..hi-1 of the shard; only the blocks they lie in are read."""
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        parts = [unpack_bits(self.data[self.offsets[b] : self.offsets[b + 1]], self.bits)[: self.block_ids] for b in range(first, last + 1)]
        return np.concatenate(parts)[lo - first * self.block_ids : hi - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def shard_bytes(ids: np.ndarray, sizes: list[int], names: list[str | None], bits: int, part: int, place: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A file but for its last byte, the line feed of the writer."""
    blocks = [pack_bits(ids[a : a + block_ids], bits) for a in range(0, len(ids), block_ids)]
    raw = [None if x is None else x.encode() for x in names]
    text = b"".join(x for x in raw if x)
    lengths = np.array([-1 if x is None else len(x) for x in raw], dtype="<i4").tobytes()
    start = HEADER.size + 8 * (len(blocks) + 1) + 8 * len(sizes) + len(lengths) + len(text)
    fill = -start % 8
    offsets = np.cumsum([start + fill, *map(len, blocks)]).astype("<u8").tobytes()
    head = HEADER.pack(MARK, bits, block_ids, part, place, len(sizes), len(ids), len(blocks))
    return b"".join([head, offsets, np.cumsum(sizes).astype("<u8").tobytes(), lengths, text, bytes(fill), *blocks])


# --- encoding


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def drops_blanks(tokenizer) -> bool:
    """Whether ids of texts joined by a blank are the texts' ids, one behind the other."""
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    added = list(tokenizer.get_added_tokens_decoder().values())
    probes = ["a", "Ab", "9", "!", "'s", "don't", "é", "́", "漢字", ".,;", " ", "İ", *[t.content for t in added]]
    return not any(t.lstrip or t.rstrip or t.single_word for t in added) and all(
        ids(x + blank + y) == ids(x) + ids(y) for blank in [*BLANKS.decode(), "  ", "\r\n", " \t"] for x in ["", *probes] for y in ["", *probes]
    )


def _letters(word: str) -> int:
    """Into how many parts the splitter cuts letters, or letters and one mark behind them; 0 for other words."""
    return 1 if word.isalpha() else 2 if word[-1] in ".,;:!?" and word[:-1].isalpha() else 0


class Words:
    """The ids of runs of characters without blanks; those met before are remembered."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        #: Which ids end a part, by the suffix of the vocabulary; none without one.
        self.ends = np.zeros(max(tokenizer.get_vocab(True).values()) + 1, dtype=bool)
        for token, i in tokenizer.get_vocab(False).items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        #: Special strings are told by their case, so only other texts may be put into lower case beforehand.
        self.marks = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.lowers = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bytes = self.used = 0
        self.flat, self.end = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))

    def _together(self, words: list[list[str]], parts: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``_each``, for chunks of words of which the number of parts is known, a chunk as one text."""
        for chunk, n, e in zip(words, parts, self.tokenizer.encode_batch_fast([" ".join(c) for c in words], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at, last = np.flatnonzero(self.ends[ids]), np.cumsum(n) - 1
            # else a word has other parts than it seems to
            yield (np.diff(at[last], prepend=-1), ids) if len(at) == last[-1] + 1 and at[-1] == len(ids) - 1 else self._each(chunk)

    def _learn(self, new: list[bytes]) -> None:
        text = [w.decode() for w in new]
        parts = list(map(_letters, text)) if self.ends.any() else [0] * len(text)
        plain, odd = [i for i, n in enumerate(parts) if n], [i for i, n in enumerate(parts) if not n]
        cuts = [plain[a : a + 256] for a in range(0, len(plain), 256)]
        found = list(self._together([[text[i] for i in c] for c in cuts], [[parts[i] for i in c] for c in cuts])) if cuts else []
        if odd:
            found.append(self._each([text[i] for i in odd]))
        sizes, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(len(ids), len(self.flat)), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.end = np.concatenate((self.end, self.used + np.cumsum(sizes)))
        self.used += len(ids)
        self.index.update(zip((new[i] for i in plain + odd), range(len(self.index), len(self.index) + len(new)), strict=True))
        self.bytes += sum(map(len, new))

    def split(self, text: bytes) -> list[bytes]:
        if self.lowers:
            low = text.lower()
            text = text if any(m in low for m in self.marks) else low
        return text.split()

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its number of ids, and all ids."""
        if len(self.index) > MEMO or self.bytes > MEMO_BYTES:
            self.clear()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(at < 0)):
            missed = [words[i] for i in missing.tolist()]
            self._learn(list(set(missed)))
            at[missing] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(missed))
        begin = self.end[at]
        size = self.end[at + 1] - begin
        before = np.cumsum(size) - size
        return size, self.flat[np.repeat(begin - before, size) + np.arange(int(size.sum()))]


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut at blanks into pieces of not much over PIECE bytes; a longer run stays whole."""
    at = 0
    while len(text) - at > PIECE:
        ends = [x for b in BLANKS if (x := text.find(b, at + PIECE)) >= 0]
        cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


@cache
def _words(spec: str) -> Words:
    return Words(_tokenizer(spec))


def encoded(texts: list[bytes], spec: str, by_words: bool) -> Iterator[np.ndarray]:
    """The ids of each text."""
    if not by_words:
        for t in texts:
            yield np.array(_tokenizer_of(spec).encode(t.decode(), add_special_tokens=False).ids, dtype=np.uint32)
        return
    words, at = _words(spec), 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            yield np.concatenate([words.ids(words.split(piece))[1] for piece in _pieces(texts[at])])
            at += 1
            continue
        upto, total = at, 0
        while upto < len(texts) and total + len(texts[upto]) <= PIECE:
            total += len(texts[upto])
            upto += 1
        cut = [words.split(t) for t in texts[at:upto]]
        size, ids = words.ids([w for c in cut for w in c])
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *map(len, cut)])].tolist()
        yield from (ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        at = upto


_tokenizer_of = cache(_tokenizer)


def _shards(spec: str, by_words: bool, end_id: int, bits: int, shard_ids: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[str | None] = []
        sizes: list[int] = []
        total, end = 0, np.array([end_id], np.uint32)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard_bytes(np.concatenate(held), sizes, names, bits, part, place, block_ids)], pa.binary())], names=["data"])

        for batch in batches:
            data, offsets = K.utf8_column(batch.column(1))
            raw, cut = data.tobytes() if len(data) else b"", offsets.tolist()
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 512):
                texts = [raw[a:b] for a, b in zip(cut[lo : lo + 512], cut[lo + 1 : lo + 513], strict=False)]
                for name, found in zip(ids[lo : lo + 512], encoded(texts, spec, by_words), strict=True):
                    held += [found, end]
                    names.append(name)
                    sizes.append(len(found) + 1)
                    total += len(found) + 1
                    if total >= shard_ids:
                        yield out()
                        held, names, sizes, total, place = [], [], [], 0, place + 1
        if names:
            yield out()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each with ``end_id`` behind it, as shards into ``folder``.

    ``tokenizer_path``: a file of the tokenizers library, read on the driver and sent to the tasks.  Special
    strings inside texts are handled as the library does by default; there is no truncation or padding."""
    if block_ids % 64:
        raise ValueError("a block holds a multiple of 64 ids")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    tokenizer = _tokenizer(spec)
    most = max(end_id, *tokenizer.get_vocab(with_added_tokens=True).values())
    rows = only(docs, id=id_col, text=text_col)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # beside the id a hash of the text and a number, so that a frequent id is dealt to several tasks
    keyed = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(parts, "id", "h", "row").sortWithinPartitions("id", "h", "row").select(F.col("id").cast("string"), "text")
    shards = dealt.mapInArrow(_shards(spec, drops_blanks(tokenizer), end_id, max(1, most.bit_length()), shard_ids, block_ids), "data binary")
    # the text writer puts down the bytes as they are, and a line feed; one row a file
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark, before = docs.sparkSession, docs.sparkSession.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        shards.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    finally:
        spark.conf.set(clean, before)


# --- reading


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            s = Shard(content.as_buffer())
            ids, ends = s.ids().astype("<u4"), s.ends
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, s.part)), pa.array(np.full(n, s.place)), pa.array(np.arange(n)), pa.array(s.names(), pa.string()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                names=["part", "place", "row", "id", "before", "n_tokens", "ids_crc32"],
            )


def documents(spark: SparkSession, folder: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """For each document in the files: its id, ``start`` (ids of all documents before it), n_tokens, ids_crc32 (of its
    ids as little-endian unsigned 32-bit integers), and its shard (part, place) and row in it."""
    found = settle(_files(spark, folder).mapInArrow(_summary, "part long, place long, row long, id string, before long, n_tokens long, ids_crc32 long"))
    # one row a shard: a running sum in one task is small
    shards = found.groupBy("part", "place").agg(F.sum("n_tokens").alias("n"))
    first = F.sum("n").over(Window.orderBy("part", "place")) - F.col("n")
    out = found.join(shards.select("part", "place", first.alias("first")), ["part", "place"])
    return out.select(F.col("id").cast(id_type).alias(id_col), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part", "place", "row")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            s = Shard(content.as_buffer())
            names = s.names()
            for i in range(len(names)):
                yield pa.RecordBatch.from_arrays([pa.array([names[i]], pa.string()), pa.array([s.document(i).astype(np.int64)], pa.list_(pa.int64()))], names=["id", "ids"])


def token_ids(spark: SparkSession, folder: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """For each document in the files its id and its token ids."""
    return _files(spark, folder).mapInArrow(_ids, "id string, ids array<long>").select(F.col("id").cast(id_type).alias(id_col), "ids")
