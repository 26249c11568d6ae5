"""Substring dedup by level-wise doubling.

A passage is a window of ``window`` consecutive words. A window is repeated if the
same words also start in a document of smaller ``doc_id``; its words go.

Level 0 looks at short windows, of about a quarter of the length. Not every one is
needed: of the short windows inside a full one, the one of least hash (the leftmost of
equals) is its anchor, and equal full windows have equal anchors at equal places. Only
anchors are compared, about one word position in nineteen. Anchors that occur in one
document alone end there; the rest go on.

Every further level doubles the length. An anchor that is alive is extended to that
length to the right and to the left; every full window around it holds one of the two
extensions at least, so an anchor of which both occur in one document alone ends there.
The loop ends when nothing is alive, or at the full length.

At the full length an anchor is first compared together with all that full windows
around it can hold. Where that context also occurs in an earlier document, all these
windows are repeated and are settled at once, however often the passage occurs. Of equal
contexts only the earliest document goes on, and only if its anchor has more than one
context. For those the full windows themselves are compared. Longer levels could not
change what is removed, so none survive beyond the full length.

A document is one row with the arrays of its anchors. All comparisons are aggregations by
hash with map-side combining. Documents are then told what they hold alone, or keep as
the first: a passage is a row for the one document that it is told to, never a row for
each of its copies, however many documents share it. Keys that decide are pairs of
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for fill_null and filter of arrays
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import release, written
from panelwright.llm.textwords import SPACE_WORDS, Words, ragged, window_hashes, words_of

U64 = np.uint64


#: Ids that are sent to all executors at most: 16 MB of them.
MOST_BROADCAST = 1_000_000


def doubling(window: int) -> list[int]:
    """Lengths of the levels: halves of the window, down to 16 words or fewer and twice at least, in ascending order."""
    lengths = [window]
    while lengths[0] > 1 and (lengths[0] > 16 or len(lengths) < 3):
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


class _Windows:
    """Anchors and full windows of the documents of one chunk."""

    def __init__(self, words: Words, window: int):
        self.words, self.window, self.lengths = words, window, doubling(window)
        self.size = self.lengths[0]
        self.h = words.hashes(0)
        self.left = words.left()
        self.index = np.arange(len(self.h)) - np.repeat(words.first[:-1], words.counts())
        self.short = window_hashes(self.h, self.size)
        self.full = np.flatnonzero(self.left >= window)
        bits = U64(max(1, int(len(self.h)).bit_length()))
        low = (U64(1) << bits) - U64(1)
        key = (self.short & ~low) | np.arange(len(self.short), dtype=U64)
        covered, span = 1, window - self.size + 1
        while covered < span and len(key):
            step = min(covered, span - covered)
            key = np.minimum(key[:-step], key[step:])
            covered += step
        #: for each full window, the place of its anchor
        self.anchor_of = (key[self.full] & low).astype(np.int64) if len(self.full) else np.zeros(0, np.int64)
        self.anchors = self.anchor_of[np.r_[True, self.anchor_of[1:] != self.anchor_of[:-1]]] if len(self.full) else self.anchor_of

    def around(self, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor, the hash of the words from ``before`` its start to ``after`` its start, and whether those are in its document."""
        wide = window_hashes(self.h, before + after)
        fits = (self.index[self.anchors] >= before) & (self.left[self.anchors] >= after)
        out = np.zeros(len(self.anchors), dtype=U64)
        out[fits] = wide[self.anchors[fits] - before]
        return out, fits

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor, all words that full windows around it can hold."""
        return self.around(self.window - self.size, self.window)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _fields(window: int) -> list[str]:
    """Arrays of a document's anchors: the hashes, the extensions of each level between, the contexts."""
    return ["anchors", *[f"{side}_{n}" for n in doubling(window)[1:-1] for side in ("right", "left")], "contexts"]


def _ragged_lists(values: np.ndarray, fits: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64), mask=~fits))


def _anchor_rows(window: int):
    """One row a document; words that do not fit in the document have a null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in words_of(batch.column("text"), SPACE_WORDS):
                w = _Windows(words, window)
                found = [(w.short[w.anchors], np.ones(len(w.anchors), bool))]
                for n in w.lengths[1:-1]:
                    found += [w.around(0, n), w.around(n - w.size, w.size)]
                found.append(w.contexts())
                at = np.searchsorted(words.doc_of()[w.anchors], np.arange(words.n_docs + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), *[_ragged_lists(x, fits, at) for x, fits in found]], names=["doc_id", *_fields(window)])

    return rows


def _surviving(tested: list[str], kept: list[str]):
    """Rows with alone, the hashes that no other document has: without the anchors of which all tested columns are alone or null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = _lists(batch.column("alone"), 0, batch.num_rows)
            lists = {c: [x.values for x in batch.column(c)] for c in {*tested, *kept}}
            masks = []
            for i, own in enumerate(alone):
                alive = np.zeros(len(lists["anchors"][i]), dtype=bool)
                for c in tested:
                    values = lists[c][i]
                    alive |= values.is_valid().to_numpy(zero_copy_only=False) & ~np.isin(values.fill_null(0).to_numpy(zero_copy_only=False), own)
                masks.append(alive)
            size = np.array([np.count_nonzero(m) for m in masks], dtype=np.int64)
            full = np.flatnonzero(size)
            at = pa.array(np.r_[0, np.cumsum(size[full])].astype(np.int32))
            columns = [pa.ListArray.from_arrays(at, pa.concat_arrays([pa.array([], pa.int64()), *[lists[c][i].filter(pa.array(masks[i])) for i in full]])) for c in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(full)), *columns], names=["doc_id", *kept])

    return rows


def _lists(column: pa.Array, row: int, end: int) -> list[np.ndarray]:
    """The values of each row of a list column; none where it is null."""
    empty = np.zeros(0, dtype=np.int64)
    return [np.asarray(x.values) if x.is_valid else empty for x in column.slice(row, end - row)]


def _in_lists(values: np.ndarray, doc: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether each value is in the list of its document. doc is ascending."""
    out = np.zeros(len(values), dtype=bool)
    edges = np.searchsorted(doc, np.arange(len(lists) + 1))
    for i, items in enumerate(lists):
        if len(items) and edges[i] < edges[i + 1]:
            out[edges[i] : edges[i + 1]] = np.isin(values[edges[i] : edges[i + 1]], items)
    return out


def _window_rows(window: int):
    schema = pa.schema([("anchor", pa.int64()), ("passage", pa.int64()), ("doc_id", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for row, end, words in words_of(batch.column("text"), SPACE_WORDS):
                w = _Windows(words, window)
                doc = words.doc_of()
                anchor = w.short[w.anchor_of].view(np.int64) if len(w.full) else np.zeros(0, np.int64)
                at = doc[w.full]
                keep = _in_lists(anchor, at, _lists(batch.column("anchors"), row, end))
                full = w.full[keep]
                passage = window_hashes(w.h, window)[full].view(np.int64) if len(full) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(passage), pa.array(ids[row:end][at[keep]])], schema=schema)

    return rows


def _strings(parts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    at = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes()))


def joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    start, length = words.start[keep], (words.end - words.start)[keep] + 1
    data = np.append(words.data, np.uint8(32))
    out = data[ragged(start, length)]
    ends = np.cumsum(length)
    out[ends - 1] = 32
    doc = words.doc_of()[keep]
    size = np.bincount(doc, weights=length, minlength=words.n_docs).astype(np.int64)
    last = np.cumsum(size)[size > 0] - 1
    return _strings(np.delete(out, last), np.maximum(size - 1, 0))


def cut_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The texts as they are, without the words that are not kept and the white space before each."""
    gone = np.flatnonzero(~keep)
    alive = np.ones(len(words.data) + 1, dtype=bool)
    if len(gone):
        before = np.r_[0, words.end[:-1]][gone]
        begin = np.maximum(before, words.doc_at[words.doc_of()[gone]])
        alive[ragged(begin, words.end[gone] - begin)] = False
    alive = alive[:-1]
    size = np.add.reduceat(np.append(alive, False).astype(np.int64), words.doc_at[:-1]) * (np.diff(words.doc_at) > 0) if words.n_docs else np.zeros(0, np.int64)
    return _strings(words.data[alive], size)


def _removal(window: int, layout: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in words_of(batch.column("text"), SPACE_WORDS):
                n = len(words.start)
                doc = words.doc_of()
                gone = np.zeros(n + 1, dtype=np.int64)
                settled, anchors, own = (_lists(batch.column(c), row, end) for c in ("contexts", "anchors", "own"))
                if any(map(len, settled)) or any(map(len, anchors)):
                    w = _Windows(words, window)
                    context, fits = w.contexts()
                    hit = _in_lists(context.view(np.int64), doc[w.anchors], settled) & fits
                    at = w.anchors[hit]
                    np.add.at(gone, at - (window - w.size), 1)
                    np.add.at(gone, at + window, -1)
                    if len(w.full):
                        at = doc[w.full]
                        full = window_hashes(w.h, window)[w.full].view(np.int64)
                        again = _in_lists(w.short[w.anchor_of].view(np.int64), at, anchors) & ~_in_lists(full, at, own)
                        np.add.at(gone, w.full[again], 1)
                        np.add.at(gone, w.full[again] + window, -1)
                keep = np.cumsum(gone)[:n] <= 0
                counts = words.counts()
                removed = np.bincount(doc[~keep], minlength=words.n_docs)
                kept = cut_words(words, keep) if layout else joined_words(words, keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("rest").slice(row, end - row), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), kept.cast(pa.string())],
                    names=["doc_id", "rest", "n_words", "n_removed", "kept"],
                )

    return rows


def _told(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs joined with what some of them are told. Where those are few enough for their ids to be broadcast, only their texts are shuffled."""
    ids = written(lists.select("doc_id"), "told")
    if ids.count() > MOST_BROADCAST:
        return docs.join(lists, "doc_id", how)
    ids = F.broadcast(ids)
    told = docs.join(ids, "doc_id", "left_semi").join(lists, "doc_id")
    if how == "inner":
        return told
    rest = docs.join(ids, "doc_id", "left_anti")
    return told.unionByName(rest.select("*", *[F.lit(None).cast(lists.schema[c].dataType).alias(c) for c in lists.columns if c != "doc_id"]))


def _alive(docs: DataFrame, window: int) -> DataFrame:
    """The anchors that outlive the levels below the full length, with their contexts: one row a document that has some."""
    fields = _fields(window)
    array = lambda names: "doc_id long, " + ", ".join(f"{c} array<long>" for c in names)
    alive = written(docs.mapInArrow(_anchor_rows(window), array(fields)).where("size(anchors) > 0"), "anchors")
    for n in doubling(window)[:-1]:
        tested = ["anchors"] if f"right_{n}" not in fields else [f"right_{n}", f"left_{n}"]
        held = alive.select("doc_id", F.explode(F.arrays_zip(*tested)).alias("x"))
        held = held.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"x.{c}").alias("words")) for i, c in enumerate(tested)])).alias("x")) if len(tested) > 1 else held.select("doc_id", F.struct(F.lit(0).alias("side"), F.col(f"x.{tested[0]}").alias("words")).alias("x"))
        alone = held.select("doc_id", "x.*").where("words IS NOT NULL").groupBy("side", "words").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("z")).where("doc_id = z")
        alone = alone.groupBy("doc_id").agg(F.collect_set("words").alias("alone"))
        fields = [c for c in fields if c == "anchors" or c not in tested]
        alive = written(alive.join(alone, "doc_id", "left").mapInArrow(_surviving(tested, fields), array(fields)), "anchors")
        release(docs)
        if alive.isEmpty():
            break
    return alive.select("doc_id", "anchors", "contexts")


def repeated_passages(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, contexts, anchors, own): what documents repeat from earlier ones.

    contexts: hashes of the anchors' contexts that are repeated. anchors: hashes of the
    anchors whose full windows are repeated, but for those with their hashes in own.
    """
    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    alive = _alive(named, window)
    every = alive.select("doc_id", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("contexts").alias("context"))).alias("x")).select("doc_id", "x.*")

    first = written(every.where("context IS NOT NULL").groupBy("anchor", "context").agg(F.min("doc_id").alias("first")), "first")
    held = alive.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.expr("filter(contexts, x -> x IS NOT NULL)")))).alias("held"))
    keeps = first.groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("context").alias("keeps"))
    settled = held.join(keeps, "doc_id", "left").select("doc_id", F.array_except("held", F.coalesce("keeps", F.array().cast("array<bigint>"))).alias("contexts"))

    going_on = first.select("anchor", F.col("first").alias("doc_id")).unionByName(every.where("context IS NULL").select("anchor", "doc_id"))
    various = written(going_on.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor"), "various")
    opened = written(going_on.join(various, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "opened")
    full = _told(named, opened, "inner").mapInArrow(_window_rows(window), "anchor long, passage long, doc_id long")
    own = full.groupBy("anchor", "passage").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("passage").alias("own"))
    out = written(settled.where("size(contexts) > 0").join(opened.join(own, "doc_id", "left"), "doc_id", "full_outer"), "passages")
    release(docs)
    return out


def substring_dedup(docs: DataFrame, window: int = 50, layout: bool = False) -> DataFrame:
    """Remove passages of ``window`` words that an earlier document holds.

    docs needs ``doc_id`` and ``text``; every other column is returned unchanged, but
    for any of the names added. Adds n_words, n_removed and kept: the kept words joined by one space, or with
    ``layout`` the text as it was without the removed words.

    A null text has no words; kept is then empty. An empty table gives an empty
    one. Rows of null doc_id neither remove nor lose anything. Rows of equal doc_id
    do not remove from one another. Texts shorter than the window are kept whole.
    ``window`` must be 2 at least.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "kept")]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none")).alias("rest"))
    lists = repeated_passages(packed, window)
    rest = packed.schema["rest"].dataType.simpleString()
    out = _told(packed, lists, "left").mapInArrow(_removal(window, layout), f"doc_id long, rest {rest}, n_words long, n_removed long, kept string")
    return out.select("doc_id", *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)], "n_words", "n_removed", "kept")
