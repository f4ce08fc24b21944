"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on a *slab*: about a megabyte of UTF-8 from consecutive
documents of one Arrow batch, laid out in one byte array with one separator
byte between documents, so that NumPy touches each byte a handful of times and
no Python loop runs per word.  Slabs bound memory; a longer document gets a
slab of its own, never a cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def byte_codes() -> np.ndarray:
    """A fixed random 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = (n >> 18) + 1 << 18
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base & _MASK, dtype=U64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[key] = p
    return _powers["up"], _powers["down"]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial of codes[i:j], shifted by i."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def window_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of k consecutive codes."""
    _, down = powers(len(prefix))
    n = max(0, len(prefix) - k)
    return mix((prefix[k:] - prefix[:n]) * down[:n])


@dataclass
class Slab:
    """Bytes of documents lo..hi-1 of a batch; document i lies at start[i]..end[i]."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, pos, side="right") - 1


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)), offsets


def slabs(column: pa.Array, separator: int, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    data, offsets = utf8_column(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        size = offsets[lo + 1 : hi + 1] - offsets[lo:hi]
        end = np.cumsum(size + 1) - 1
        start = end - size
        out = np.full(int(end[-1]) + 1, separator, dtype=np.uint8)
        for i in range(hi - lo):
            out[start[i] : end[i]] = data[offsets[lo + i] : offsets[lo + i + 1]]
        yield Slab(lo, hi, out, start, end)
        lo = hi


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def byte_table(values: str) -> np.ndarray:
    """A lookup of which byte values are in a latin-1 string."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(values.encode("latin-1"), dtype=np.uint8)] = True
    return table


@cache
def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words(slab: Slab, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """Start, end, document and 64-bit hash of each word, a maximal run of the given byte values."""
    data = lower_ascii()[slab.data] if lower else slab.data
    start, end = runs(is_word[data])
    prefix = prefix_hash(byte_codes()[data])
    return start, end, slab.doc_of(start), span_hash(prefix, start, end)


def shingles(doc: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each run of ``size`` words of a document; a shorter
    document's whole sequence is one shingle."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    prefix = prefix_hash(word)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(first, n))
    full = np.zeros(n, dtype=bool)
    if n >= size:
        full[: n - size + 1] = doc[: n - size + 1] == doc[size - 1 :]
    begin = np.flatnonzero(full)
    short = first[length < size]
    begin, stop = np.concatenate((begin, short)), np.concatenate((begin + size, short + length[length < size]))
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], stop[order]
    return doc[begin], span_hash(prefix, begin, stop)


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, value), ordered by both."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    category = unicodedata.category
    for cp in range(0x110000):
        kind = category(chr(cp))
        if kind[0] == "L":
            table[cp] = LETTER
        elif kind[0] == "N":
            table[cp] = NUMBER
        elif kind in ("Zs", "Zl", "Zp"):
            table[cp] = SPACE
    table[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return table


@cache
def lower_chars() -> np.ndarray:
    """The lower-case form of each code point that has one of one character."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp in np.flatnonzero(char_classes() == LETTER):
        low = chr(cp).lower()
        if len(low) == 1:
            table[cp] = ord(low)
    return table


@dataclass
class CodeSlab:
    """Code points of documents lo..hi-1, with one separator between documents."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    doc_of = Slab.doc_of


def code_slabs(column: pa.Array, separator: int = 10, limit: int = SLAB_BYTES) -> Iterator[CodeSlab]:
    for s in slabs(column, 0x0A, limit):
        lead = (s.data & 0xC0) != 0x80
        count = np.concatenate(([0], np.cumsum(lead)))
        data = np.frombuffer(s.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        start, end = count[s.start], count[s.end]
        if separator != 10:
            data = data.copy()
            data[end] = separator
        yield CodeSlab(s.lo, s.hi, data, start, end)
