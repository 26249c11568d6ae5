"""Vectorised word splitting and hashing over Arrow text columns.

Every operator of this package that walks the words of whole texts shares these
helpers. They work on the UTF-8 bytes of an Arrow column, so one batch costs a
handful of numpy passes and no Python object per word. The word classes used by
the package separate words at ASCII characters only, and therefore a byte mask
and a character mask agree.

Hashes are 64-bit. A word hash is a polynomial over a fixed table of random byte
values; sequence hashes are polynomials over word hashes. Callers that decide
something irreversible by hash use two independent seeds (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_CHUNK_BYTES = 1 << 20


def _mask_of(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of the white-space class ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = _mask_of(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of letters, digits and non-ASCII characters, after lower-casing A-Z.
ALNUM_WORDS = _mask_of(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = ascii_lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Poly:
    """Byte polynomial of one seed, with powers that grow on demand."""

    def __init__(self, seed: int):
        self.base = _BASES[seed]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = np.random.default_rng(20240 + seed).integers(0, 1 << 63, 256, dtype=U64) | U64(1)
        self.up = _powers(self.base, 1 << 16)
        self.down = _powers(self.inverse, 1 << 16)

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            size = 1 << int(n + 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        total = np.empty(n + 1, dtype=U64)
        total[0] = 0
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(U64))


_POLY: dict[int, _Poly] = {}


def _poly(seed: int) -> _Poly:
    if seed not in _POLY:
        _POLY[seed] = _Poly(seed)
    return _POLY[seed]


@dataclass
class Words:
    """Words of consecutive documents of one chunk.

    data: the chunk's bytes (lower-cased if asked for). doc_at: byte offset of
    each document, one more than there are documents. start, end: byte offsets of
    words. first: index of each document's first word, one more than documents.
    """

    data: np.ndarray
    doc_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.doc_at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return _poly(seed).hashes(self.data, self.start, self.end)

    def doc_of(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts())

    def left(self) -> np.ndarray:
        """For each word, how many words of its document start there or later."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.start))

    def text_of(self, i: int) -> bytes:
        return self.data[self.doc_at[i] : self.doc_at[i + 1]].tobytes()


def split(data: np.ndarray, doc_at: np.ndarray, word_bytes: np.ndarray) -> Words:
    inside = word_bytes[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[doc_at] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, doc_at, start, end, np.searchsorted(start, doc_at))


def text_chunks(column: pa.Array, most: int = _CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, document offsets) of at most about ``most`` bytes.

    A document is never divided: one longer than ``most`` is a chunk of its own.
    Null texts have no bytes.
    """
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words_of(column: pa.Array, word_bytes: np.ndarray, lower: bool = False, most: int = _CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, at in text_chunks(column, most):
        yield row, end, split(LOWER[data] if lower else data, at, word_bytes)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word, regardless of document ends."""
    out = np.zeros(max(len(h) - n + 1, 0), dtype=U64)
    for k, c in enumerate(_powers(_MULTIPLIER, n + 1)[1:]):
        out += h[k : k + len(out)] * c
    return mix(out + U64(n))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """As ngram_hashes, by prefix sums: the cost does not depend on n."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=U64)
    poly = _poly(1)
    if len(poly.up) < len(h) + 1:
        grown = 1 << int(len(h) + 1).bit_length()
        poly.up, poly.down = _powers(poly.base, grown), _powers(poly.inverse, grown)
    total = np.empty(len(h) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(h * poly.up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * poly.down[:size] + U64(n))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [s, s + n)."""
    lengths = np.asarray(lengths, dtype=np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, dtype=np.int64)[keep], lengths[keep]
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    out = np.ones(int(lengths.sum()), dtype=np.int64)
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
