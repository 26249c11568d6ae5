"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of a block of benchmark items has a state for every class of word
sequences that end at the same places of the items. Streaming a document's words
through it gives, at each word, the longest suffix read that occurs in some item.
A suffix of ``n`` words or more closes a hit; so does a suffix that is a whole item
of fewer words. The states know the items they occur in.

Before the automaton walks, a table lookup on hashes of neighbouring words skips the
stretches in which no item has that neighbourhood; a longest match of two words or
more needs each of its neighbourhoods in an item, so nothing is missed. Words are
compared by their bytes in the walk.

Items are broadcast, and their size is checked: a pass over the documents takes items of
at most about ``PASS_WORDS`` words, and larger benchmarks take several passes with what
was found so far written in between. A worker process builds the automata of a pass
once, for all of its tasks: one for each block of ``BLOCK_WORDS`` words, which takes
about 90 MB while it is built and then is frozen into arrays of 5 to 10 MB.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import sheltered, unsheltered, written
from panelwright.llm.substring import cut_words
from panelwright.llm.textwords import ALNUM_WORDS, _poly, mix, text_chunks, words_of

U64 = np.uint64
BLOCK_WORDS = 100_000
PASS_WORDS = 2_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE_BITS = 20


def item_words(text: str | None) -> list[bytes]:
    """Words of an item: A-Z lower-cased, then letters, digits and non-ASCII characters."""
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each state."""

    def __init__(self, items: list[tuple[int, list[bytes]]], n: int):
        self.n = n
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(key, [self.words.setdefault(w, len(self.words)) for w in words]) for key, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: for a state of n words or more: the one on its link path whose class has n words
        of_n = [0] * len(self.next)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in order:
            up = self.link[s]
            if self.length[s] >= n:
                of_n[s] = s if self.length[up] < n else of_n[up]
        #: items that hold the n words of such a class; whole items of fewer words, with their lengths
        self.items: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for key, seq in coded:
            state = 0
            for c in seq:
                state = self.next[state][c]
                if of_n[state]:
                    self.items.setdefault(of_n[state], set()).add(key)
            if len(seq) < n:
                whole.setdefault(state, []).append((key, len(seq)))
        self.short: dict[int, list[tuple[int, int]]] = {}
        for s in order:
            if s in whole or self.link[s] in self.short:
                self.short[s] = self.short.get(self.link[s], []) + whole.get(s, [])
        self.shortest = min((min(n, len(seq)) for _, seq in coded), default=0)
        names = list(self.words)
        self.neighbours = [(names[a], names[b]) for a, s in self.next[0].items() for b in self.next[s]]
        self._freeze(of_n)

    def _freeze(self, of_n: list[int]) -> None:
        """Transitions as ascending keys (state, word) with their targets; states as arrays."""
        count = np.fromiter(map(len, self.next), np.int64, len(self.next))
        total = int(count.sum())
        word = np.fromiter((c for step in self.next for c in step), np.uint64, total)
        target = np.fromiter((s for step in self.next for s in step.values()), np.int32, total)
        keys = np.repeat(np.arange(len(count), dtype=U64), count) << U64(32) | word
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], target[order]
        self.link, self.length, self.of_n = (np.array(x, dtype=np.int32) for x in (self.link, self.length, of_n))
        self.next = []

    def step(self, state: int, c: int) -> int:
        """The state after a word, or -1."""
        key = state << 32 | c
        at = int(np.searchsorted(self.keys, U64(key)))
        return int(self.targets[at]) if at < len(self.keys) and int(self.keys[at]) == key else -1

    def _extend(self, last: int, c: int) -> int:
        """The state of the sequence of ``last`` followed by c, new or there already."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, c, known)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.next[at][c]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._clone(at, c, known)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, at: int, c: int, known: int) -> int:
        copy = self._state(self.length[at] + 1)
        self.next[copy] = dict(self.next[known])
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at >= 0 and self.next[at].get(c) == known:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def walk(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first, last) of the hits, as word places, and the items hit."""
        spans, found = [], set()
        state = matched = 0
        n = self.n
        for i, word in enumerate(words):
            c = self.words.get(word)
            if c is None:
                state = matched = 0
                continue
            after = self.step(state, c)
            while after < 0 and state:
                state = int(self.link[state])
                matched = int(self.length[state])
                after = self.step(state, c)
            if after >= 0:
                state = after
                matched += 1
            if matched >= n:
                spans.append((i - n + 1, i))
                found |= self.items[int(self.of_n[state])]
            for key, length in self.short.get(state, ()):
                if length <= matched:
                    spans.append((i - length + 1, i))
                    found.add(key)
        return spans, found


class _Matcher:
    """An automaton with its table of neighbourhoods."""

    def __init__(self, items: list[tuple[int, list[bytes]]], n: int):
        self.automaton = Automaton(items, n)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.single = self.automaton.shortest == 1
        pairs = self.automaton.neighbours
        if self.single:
            self.table[self._slots(self._hash(list(self.automaton.words)))] = True
        elif pairs:
            left, right = self._hash([a for a, _ in pairs]), self._hash([b for _, b in pairs])
            self.table[self._slots(self._pair(left, right))] = True
        self.automaton.neighbours = []

    @staticmethod
    def _hash(names: list[bytes]) -> np.ndarray:
        at = np.r_[0, np.cumsum([len(x) for x in names])]
        data = np.frombuffer(b"".join(names), dtype=np.uint8)
        return _poly(0).hashes(data, at[:-1], at[1:])

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * U64(0x9E3779B97F4A7C15) + b)

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - _TABLE_BITS)).astype(np.int64)

    def stretches(self, words, h: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges, each in one document, outside of which nothing can be hit. h: the words' hashes."""
        least = self.automaton.shortest
        if not len(h) or not least:
            return []
        if self.single:
            ok = self.table[self._slots(h)]
        else:
            ok = np.zeros(len(h), dtype=bool)
            ok[:-1] = self.table[self._slots(self._pair(h[:-1], h[1:]))]
            ends = words.first[1:] - 1
            ok[ends[ends >= 0]] &= words.counts()[ends >= 0] == 0
        edge = np.flatnonzero(np.diff(np.r_[False, ok, False]))
        begin, end = edge[::2], edge[1::2] + (0 if self.single else 1)
        long = end - begin >= least
        out = []
        for a, b in zip(begin[long], end[long], strict=True):
            if self.single:  # such a range can cross documents
                inner = words.first[(words.first > a) & (words.first < b)]
                marks = [a, *dict.fromkeys(inner.tolist()), b]
                out += list(zip(marks[:-1], marks[1:], strict=True))
            else:
                out.append((int(a), int(b)))
        return out


_MATCHERS: dict[str, list[_Matcher]] = {}


def matchers(name: str, items: list[tuple[int, list[bytes]]], n: int) -> list[_Matcher]:
    """The worker's matchers of a pass, one for each block of its items. Those of other passes are dropped."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        blocks: list[list] = [[]]
        held = 0
        for key, words in items:
            if held + len(words) > BLOCK_WORDS and blocks[-1]:
                blocks.append([])
                held = 0
            blocks[-1].append((key, words))
            held += len(words)
        _MATCHERS[name] = [_Matcher(block, n) for block in blocks]
    return _MATCHERS[name]


def _matches(shared, n: int, cut: bool, min_words: int, min_percent: int, schema: pa.Schema, last: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = matchers(*shared.value, n)
        for batch in batches:
            for row, end, words in words_of(batch.column("text"), ALNUM_WORDS, lower=True):
                total = len(words.start)
                hit = np.zeros(total + 1, dtype=np.int64)
                found: list[set[int]] = [set(x) for x in batch.column("items").slice(row, end - row).to_pylist()]
                for i, spans in enumerate(batch.column("spans").slice(row, end - row).to_pylist()):
                    for a, b in spans:
                        hit[words.first[i] + a] += 1
                        hit[words.first[i] + b + 1] -= 1
                h = words.hashes(0)
                for matcher, (a, b) in ((m, x) for m in blocks for x in m.stretches(words, h)):
                    data = words.data[words.start[a] : words.end[b - 1]].tobytes()
                    shift = words.start[a]
                    tokens = [data[s - shift : e - shift] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
                    spans, items = matcher.automaton.walk(tokens)
                    if spans:
                        found[int(np.searchsorted(words.first, a, side="right")) - 1] |= items
                        for x, y in spans:
                            hit[a + x] += 1
                            hit[a + y + 1] -= 1
                inside = np.cumsum(hit)[:total] > 0
                doc = words.doc_of()
                counts = words.counts().astype(np.int64)
                n_hit = np.bincount(doc[inside], minlength=words.n_docs).astype(np.int64)
                merged = _spans(inside, words)
                out = {c: batch.column(c).slice(row, end - row) for c in batch.schema.names}
                out |= {"n_words": pa.array(counts), "n_hit": pa.array(n_hit), "items": pa.array([sorted(x) for x in found], pa.list_(pa.int64())), "spans": pa.array(merged, pa.list_(pa.list_(pa.int64())))}
                if cut and last:
                    gone = _over_limit(merged, words, n_hit, counts, min_words, min_percent)
                    if gone.any():  # the words' places in the text as it was, not lower-cased
                        written_as = next(text_chunks(batch.column("text").slice(row, end - row), most=1 << 62))[2]
                        out["text"] = cut_words(replace(words, data=written_as), ~gone).cast(pa.string())
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)

    return rows


def _spans(inside: np.ndarray, words) -> list[list[list[int]]]:
    """For each document, the (first, last) places of its stretches of hit words."""
    out: list[list[list[int]]] = [[] for _ in range(words.n_docs)]
    if inside.any():
        doc = words.doc_of()
        new = inside & np.r_[True, ~inside[:-1] | (doc[1:] != doc[:-1])]
        stop = inside & np.r_[~inside[1:] | (doc[1:] != doc[:-1]), True]
        for a, b in zip(np.flatnonzero(new).tolist(), np.flatnonzero(stop).tolist(), strict=True):
            i = int(doc[a])
            out[i].append([a - int(words.first[i]), b - int(words.first[i])])
    return out


def _over_limit(spans, words, n_hit, counts, min_words: int, min_percent: int) -> np.ndarray:
    """Words of spans of min_words or more, and all hit words of documents covered by min_percent or more."""
    gone = np.zeros(len(words.start), dtype=bool)
    for i, own in enumerate(spans):
        covered = n_hit[i] > 0 and 100 * n_hit[i] >= min_percent * counts[i]
        for a, b in own:
            if covered or b - a + 1 >= min_words:
                gone[words.first[i] + a : words.first[i] + b + 1] = True
    return gone


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items of each pass, of at most about PASS_WORDS words. The items of one pass are on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-int(chars) // (4 * PASS_WORDS)))
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k)
        yield [(r.item_id, item_words(r.text)) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, min_percent: int = 5, cut: bool = False, min_words: int = 13) -> DataFrame:
    """Mark what documents share with benchmark items.

    docs needs ``text`` and keeps all its columns, but for any of the names added:
    n_words, n_hit (words inside an occurrence of an item's ``n``-word window, or of a
    whole item of fewer words), items (item_ids with such occurrences), spans (first
    and last word of each hit stretch) and contaminated (n_hit > 0 and at least
    ``min_percent`` of n_words). With ``cut``, text loses the spans of ``min_words`` or
    more words, and all spans of contaminated documents.

    Null texts and texts without words have no hits. Null items are ignored; items of
    one id count as one item. Rows of documents are judged one by one, whatever they
    repeat. Empty tables of documents or items are no error.
    """
    added = ["n_words", "n_hit", "items", "spans", "contaminated"]
    frame, names = sheltered(docs, ["text"], added)
    frame = frame.withColumns({"text": F.col("text").cast("string"), "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<bigint>"), "spans": F.array().cast("array<array<bigint>>")})
    passes = _passes(benchmark)
    items = next(passes)
    while items is not None:
        following = next(passes, None)
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))
        kind = _arrow_schema(frame)
        frame = frame.mapInArrow(_matches(shared, n, cut, min_words, min_percent, kind, following is None), frame.schema)
        if following is not None:
            frame = written(frame, "decontaminated")
        items = following
    return unsheltered(frame.withColumn("contaminated", F.expr(f"n_hit > 0 AND 100 * n_hit >= {int(min_percent)} * n_words")), names, added)


def _arrow_schema(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)
