"""Quality rules with cross-document line frequency.

Each document gets base counts from its own text. Its lines are normalised (A-Z
lower-cased, white space to single spaces) and hashed; for each host, a line's number
of distinct documents is counted, with partial counts before the shuffle. Lines above
the limit are boilerplate: they are removed, and a document of which too little is left
is rejected as depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import written
from panelwright.llm.textwords import LOWER, SPACE_WORDS, U64, mix, ngram_hashes, split, text_chunks, _poly

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_REPEAT = 5


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[at[1:]] - total[at[:-1]]


def _repeated_words(words, h: np.ndarray) -> np.ndarray:
    """Per document: words inside 5-word windows that its text holds twice or more."""
    g = ngram_hashes(h, _REPEAT)
    ok = np.flatnonzero(words.left()[: len(g)] >= _REPEAT)
    doc = words.doc_of()
    out = np.zeros(words.n_docs, dtype=np.int64)
    if not len(ok):
        return out
    key = mix(g[ok] ^ (doc[ok].astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    twice = np.r_[False, s[1:] == s[:-1]]
    twice[:-1] |= twice[1:]
    at = ok[order[twice]]
    cover = np.zeros(len(h) + _REPEAT, dtype=np.int64)
    for k in range(_REPEAT):
        cover[at + k] = 1
    return np.bincount(doc[cover[: len(h)] > 0], minlength=words.n_docs)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, doc_at in text_chunks(batch.column("text")):
            words = split(data, doc_at, SPACE_WORDS)
            counts = words.counts().astype(np.int64)
            leading = (data & 0xC0) != 0x80
            total = np.r_[0, np.cumsum(leading, dtype=np.int64)]
            chars = _sums(total[words.end] - total[words.start], words.first)
            symbols = _sums(_SYMBOLS[data], doc_at)
            repeated = _repeated_words(words, words.hashes(0)).astype(np.int64)
            # lines: from each document's start or a \n to the next \n or the document's end
            breaks = np.flatnonzero(data == 10)
            line_start = np.sort(np.concatenate([doc_at[:-1], breaks + 1]), kind="stable")
            # an empty document at the chunk's end or between others has one empty line of its own
            owner = np.sort(np.concatenate([np.arange(words.n_docs), np.searchsorted(doc_at, breaks, side="right") - 1]), kind="stable")
            line_end = np.r_[line_start[1:], len(data)] if len(line_start) else line_start
            has_break = np.r_[owner[1:] == owner[:-1], False] if len(owner) else np.zeros(0, bool)
            line_end = np.where(has_break, line_end - 1, line_end)
            raw = _poly(0).hashes(data, line_start, line_end)
            first = np.searchsorted(words.start, line_start)
            after = np.searchsorted(words.start, line_end)
            n = after - first
            lower = _poly(0).hashes(LOWER[data], words.start, words.end)
            place = np.arange(len(lower)) - np.repeat(first, n) if len(lower) else np.zeros(0, np.int64)
            poly = _poly(1)
            if len(lower) and place.max() >= len(poly.up):
                poly.hashes(np.zeros(int(place.max()) + 1, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))
            sums = np.r_[U64(0), np.cumsum(lower * poly.up[place], dtype=U64)]
            normal = mix((sums[after] - sums[first]) + n.astype(U64))
            full = n > 0
            order = np.lexsort((np.arange(len(raw)), raw, owner))
            same = np.zeros(len(raw), dtype=bool)
            o = order[full[order]]
            same[o[1:]] = (raw[o[1:]] == raw[o[:-1]]) & (owner[o[1:]] == owner[o[:-1]])
            dup = np.bincount(owner[same], minlength=words.n_docs).astype(np.int64)
            at = np.searchsorted(owner, np.arange(words.n_docs + 1)).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(normal.view(np.int64), mask=~full), pa.array(n.astype(np.int64))], names=["line", "words"])
            lines = pa.ListArray.from_arrays(pa.array(at), struct)
            named = {"n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated}
            keep = [batch.column(c).slice(row, end - row) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*keep, *[pa.array(x.astype(np.int64)) for x in named.values()], lines], names=[*batch.schema.names, *named, "lines"])


def line_quality(docs: DataFrame, host: str = "source", min_docs: int = 10, host_percent: float = 1.0, most_docs: int = 1000, depleted_percent: int = 80, texts: bool = False) -> DataFrame:
    """Base counts, boilerplate words and a verdict for every document.

    A line (of a host) is boilerplate if more than ``min_docs`` documents hold it, and
    more than ``host_percent`` per cent of the host's documents or more than ``most_docs``
    of them. Returns doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words (words in
    boilerplate lines), base_failed (fewer than 10 words, or over 20 % of them in
    repeated 5-word windows) and kept: false if base_failed or if more than
    ``depleted_percent`` per cent of the words are in boilerplate lines. With ``texts``
    also text, without its boilerplate lines.

    A null text has no words and fails. Null hosts form one host. A null doc_id counts
    as one document of its host; rows of equal doc_id count as one document for a line,
    and each gets its own result. An empty table gives an empty one.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("")).alias("host")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name, F.col("text").cast("string").alias("text"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    base = rows.mapInArrow(_base, f"doc_id long, host string, text string, {counts}, lines array<struct<line: long, words: long>>")
    base = base if texts else base.drop("text")
    known = written(base.withColumn("row", F.monotonically_increasing_id()), "lines")

    lines = known.select("row", "doc_id", "host", F.explode("lines").alias("x")).select("row", F.coalesce("doc_id", F.lit(-1)).alias("doc"), "host", "x.line", "x.words").where("line IS NOT NULL")
    often = lines.groupBy("host", "line").agg(F.countDistinct("doc").alias("docs")).where(F.col("docs") > min_docs)
    sizes = known.groupBy("host").agg(F.countDistinct(F.coalesce("doc_id", F.lit(-1))).alias("all_docs"))
    limit = often.join(sizes, "host").where((F.col("docs") * 100 > F.col("all_docs") * host_percent) | (F.col("docs") > most_docs)).select("host", "line")
    boilerplate = written(limit, "boilerplate")
    gone = lines.join(boilerplate, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("n_line_words"), F.collect_set("line").alias("gone"))
    out = known.join(gone, "row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    out = out.withColumn("kept", F.expr(f"NOT base_failed AND 100 * n_line_words <= {int(depleted_percent)} * n_words"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept"]
    if not texts:
        return out.select(*columns)
    left = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> lines[i].line IS NULL OR NOT array_contains(gone, lines[i].line)), '\\n')")
    return out.select(*columns, F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))
