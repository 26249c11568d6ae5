"""Whole texts to token ids with a tokenizer file, one encoding of each distinct piece of text.

A byte-pair tokenizer first splits a text into pieces and then encodes each piece on
its own, and the same pieces come again and again. Encoder cuts many texts at once
where the tokenizer's pattern does, in vector steps over their UTF-16 units, lets Arrow
find the distinct pieces, encodes every new one once with the tokenizer's model, and
looks up the rest. A text whose characters the split might treat otherwise, or that
holds one of the tokenizer's added tokens, is encoded by the tokenizer itself. The
memory of pieces is bounded; when it is full, the half that was used most stays.
"""

from __future__ import annotations

import re
from itertools import chain, islice
from operator import attrgetter

import numpy as np
import pyarrow as pa

from panelwright.llm.textwords import ragged

#: Letters and numbers among the usual characters below. Fixed values.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼½¾"

#: Outside of these characters, libraries may differ on case, white space and classes;
#: and letters whose small form is outside of the letters above.
_FAR_CASE = "".join(c for c in map(chr, range(0x80, 0x250)) if any(ord(x) > 0x24F for x in c.lower()))
_UNUSUAL = re.compile(f"[^\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027\u20ac]|[{_FAR_CASE}]")
#: About 100 MB of them.
MOST_PIECES = 250_000

#: Classes of UTF-16 units. All that is not usual is far, and so is the mark after each text.
_SPACE, _LETTER, _NUMBER, _OTHER, _FAR = range(5)
_END = "\x1c"


def _unit_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, small form) of each UTF-16 unit."""
    kinds, small = np.full(1 << 16, _FAR, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for c in map(chr, chain(range(0x250), range(0x2010, 0x2028), [0x20AC])):
        if not _UNUSUAL.match(c):
            kinds[ord(c)] = _SPACE if c.isspace() else _LETTER if re.match(f"[{_L}]", c) else _NUMBER if re.match(f"[{_N}]", c) else _OTHER
            small[ord(c)] = ord(c.lower())
    return kinds, small


_KINDS, _SMALL = _unit_tables()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the rest are numbered from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


#: The mark between pieces stands for itself; no piece holds it.
_LETTERS = byte_letters() | {ord(_END): _END}


class _Pieces(dict):
    """Piece to number; a new piece gets the next one."""

    def __missing__(self, piece: bytes) -> int:
        number = self[piece] = len(self)
        return number


class Encoder:
    """Token ids of texts by a tokenizer file of the ``tokenizers`` library, as its encode() gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.number = _Pieces()  # of pieces as UTF-16 bytes
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.at = np.zeros(1 << 14, dtype=np.int64)  # start of each piece's ids in the pool
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.uses = np.zeros(1 << 14, dtype=np.int64)
        self.known = self.used = 0

    def _forget(self) -> None:
        """Keep the half of the pieces that was used most; uses of long ago count less."""
        kept = np.sort(np.argsort(-self.uses[: self.known], kind="stable")[: MOST_PIECES // 2])
        pieces = list(self.number)
        self.number = _Pieces((pieces[i], k) for k, i in enumerate(kept.tolist()))
        count = self.count[kept]
        ids = self.pool[ragged(self.at[kept], count)]
        self.known, self.used = len(kept), len(ids)
        self.pool = np.append(ids, np.zeros(1 << 16, dtype=np.int32))
        self.count[: self.known] = count
        self.at[: self.known] = np.cumsum(count) - count
        self.uses[: self.known] = self.uses[kept] >> 1
        self.uses[self.known :] = 0

    def rest(self) -> None:
        """At a task's end: the worker stays and serves other steps, so it gives back what it can."""
        if len(self.number) > MOST_PIECES // 2:
            self._forget()
        pa.default_memory_pool().release_unused()

    def _learn(self) -> None:
        """Encode the pieces that were numbered since the last call."""
        fresh = list(islice(self.number, self.known, None))
        if not fresh:
            return
        letters = _END.encode("utf-16-le").join(fresh).decode("utf-16-le").encode().decode("latin-1").translate(_LETTERS).split(_END)
        tokenize, number = self.model.tokenize, attrgetter("id")
        encoded = [list(map(number, tokenize(piece))) for piece in letters]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), np.int32, int(lengths.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(fresh) > len(self.at):
            self.at, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count, self.uses))
        self.pool[self.used : self.used + len(ids)] = ids
        span = slice(self.known, self.known + len(fresh))
        self.count[span] = lengths
        self.at[span] = self.used + np.cumsum(lengths) - lengths
        self.known += len(fresh)
        self.used += len(ids)

    def _begins(self, units: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each unit, as the pattern of the tokenizer file has it.

        Words: letters | 's 't 're 've 'm 'll 'd | one number | others; white space is
        dropped. Bytes: the same with runs of numbers, a plain space before any of them
        but the contractions taken along, and white space in pieces of its own.
        """
        begins = np.ones(len(units), dtype=bool)
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
        if self.lower:
            begins |= kinds == _NUMBER
        else:
            last = np.flatnonzero(begins[1:] & (kinds[:-1] == _SPACE) & (kinds[1:] != _FAR))
            begins[last] = True
            begins[last + 1] = units[last] != ord(" ")
        at = np.flatnonzero(units == ord("'"))
        at = at[begins[at]]
        first, second = units[at + 1], units[at + 2]
        short = np.isin(first, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            long |= (first == ord(a)) & (second == ord(b))
        begins[at[short | long] + 1] = False
        begins[at[short] + 2] = True
        begins[at[long] + 3] = True
        return begins

    def _split(self, units: np.ndarray, kinds: np.ndarray, n: int) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(pieces of all n texts as UTF-16 bytes, how many there are up to each text's end)."""
        if self.lower:
            units = _SMALL[units]
        begins = self._begins(units, kinds)
        kept = kinds != _FAR
        ends = np.flatnonzero(~kept)[:n]
        if self.lower:
            kept &= kinds != _SPACE
        ends = np.searchsorted(np.flatnonzero(begins & kept), ends)
        units = units[kept]
        offsets = 2 * np.append(np.flatnonzero(begins[kept]), len(units))
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(units)]).dictionary_encode(), ends

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null."""
        if len(self.number) > MOST_PIECES:
            self._forget()
        out = [np.zeros(0, dtype=np.int32)] * len(texts)
        places = [i for i, text in enumerate(texts) if text]
        if not places:
            return out
        held = [texts[i] for i in places]
        units, kinds = _units(held)
        if np.count_nonzero(kinds == _FAR) > len(held) + 2 or any(token in text for token in self.added for text in held):
            near = []
            for i, text in zip(places, held, strict=True):
                if _UNUSUAL.search(text) or any(token in text for token in self.added):
                    out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
                else:
                    near.append(i)
            places = near
            units, kinds = _units([texts[i] for i in places])
        pieces, ends = self._split(units, kinds, len(places))
        numbers = np.fromiter(map(self.number.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(pieces.dictionary))
        self._learn()
        which = pieces.indices.to_numpy()
        self.uses[numbers] += np.bincount(which, minlength=len(numbers))
        which = numbers[which]
        count = self.count[which]
        ids = self.pool[ragged(self.at[which], count)]
        ends = np.append(0, np.cumsum(count))[ends]
        for i, a, b in zip(places, np.append(0, ends)[:-1], ends, strict=True):
            out[i] = ids[a:b]
        return out


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-16 units, their classes) of texts, each with a mark after it, and two more at the end."""
    units = np.frombuffer("".join([*chain.from_iterable((text, _END) for text in texts), _END, _END]).encode("utf-16-le"), "<u2")
    return units, _KINDS[units]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_slices(texts: list[str | None], most_chars: int = 1 << 20):
    """Ranges of rows whose texts hold at most about most_chars characters."""
    begin = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > begin and held + size > most_chars:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)
