"""Quality classifier: logistic regression on hashed word n-grams, learned by
follow-the-regularised-leader (FTRL-proximal) updates.

Features are n-grams of one and two words, and n-grams of one to three word shapes (the
case pattern, symbols, a trailing mark, the length and whether the word repeats the
one before), hashed into ``2**bits`` weights. A feature's value is its share of the
document's n-grams of that family, so a score does not grow with the length. Scoring is
a sparse dot product: weights are looked up at every n-gram and summed by document.

The sample that is learned from is bounded by ``most_rows`` and gathered in one task;
the model, ``2**bits`` numbers, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import extended, sheltered, unsheltered
from panelwright.llm.textwords import SPACE_WORDS, U64, mix, words_of
from panelwright.llm.training import is_held_out, labelled_sample

BITS = 18
_FAMILIES = (("word", 1), ("word", 2), ("shape", 1), ("shape", 2), ("shape", 3))
#: Values are shares times this, so that a feature of every n-gram has it as value.
_SCALE = 8.0

_KIND = np.zeros(256, dtype=np.int64)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[128:] = 1
_KIND[list(b"#*$%&|<>@=+^~\\_{}[]/")] = 8
_KIND[list(b"!?")] = 16
_KIND[list(b".,;:'\"()-")] = 32


def _shapes(words, h: np.ndarray) -> np.ndarray:
    """A small code of how each word is written and whether it is the one before again."""
    data = words.data
    n = words.end - words.start
    if not len(n):
        return np.zeros(0, dtype=U64)
    totals = []
    for bit in (1, 2, 4, 8, 16):
        count = np.r_[0, np.cumsum((_KIND[data] & bit) > 0, dtype=np.int64)]
        totals.append(count[words.end] - count[words.start])
    lower, upper, digit, symbol, mark = totals
    case = np.where(upper == 0, np.where(lower > 0, 1, 0), np.where(lower == 0, np.where(upper > 1, 3, 2), 2))
    length = np.digitize(n, [2, 4, 8, 13, 25])
    last = _KIND[data[words.end - 1]]
    again = np.r_[False, h[1:] == h[:-1]]
    again[words.first[:-1][words.counts() > 0]] = False
    code = case + 4 * np.minimum(symbol, 3) + 16 * np.minimum(mark, 3) + 64 * (digit > 0) + 128 * again + 256 * length + 2048 * (last == 32)
    return mix(code.astype(U64) + U64(1))


def _features(words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: (slot, document) of every n-gram, documents ascending."""
    h = words.hashes(0)
    streams = {"word": h, "shape": _shapes(words, h)}
    left, doc = words.left(), words.doc_of()
    for k, (name, n) in enumerate(_FAMILIES):
        s = streams[name]
        size = max(len(s) - n + 1, 0)
        total = np.full(size, k + 1, dtype=U64)
        for i in range(n):
            total = mix(total * U64(0x9E3779B97F4A7C15) + s[i : i + size])
        ok = left[:size] >= n
        yield (total[ok] >> U64(64 - bits)).astype(np.int64), doc[:size][ok]


def learn(rows: list[tuple[pa.Array, np.ndarray]], bits: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> np.ndarray:
    """Weights, the intercept last, from (text column, labels) pairs."""
    size = 1 << bits
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    for column, y in rows:
        for row, end, words in words_of(column, SPACE_WORDS):
            slots, values, owners = [], [], []
            for slot, doc in _features(words, bits):
                share = np.bincount(doc, minlength=words.n_docs)
                slots.append(slot)
                owners.append(doc)
                values.append(_SCALE / share[doc])
            slot, owner, value = np.concatenate(slots), np.concatenate(owners), np.concatenate(values)
            key, inverse = np.unique(owner.astype(np.int64) << bits | slot, return_inverse=True)
            value = np.bincount(inverse, weights=value)
            at = np.searchsorted(key >> bits, np.arange(words.n_docs + 1))
            for i in range(words.n_docs):
                a, b = at[i], at[i + 1]
                examples.append((np.append(key[a:b] & (size - 1), size).astype(np.int32), np.append(value[a:b], 1.0).astype(np.float32), int(y[row + i])))
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            slot, value, y = examples[k]
            zs, ns = z[slot], n[slot]
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            z[slot] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[slot] = ns + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def score_words(words, weights: np.ndarray, bits: int) -> np.ndarray:
    total = np.full(words.n_docs, weights[-1])
    for slot, doc in _features(words, bits):
        share = np.bincount(doc, minlength=words.n_docs)
        total += _SCALE * np.bincount(doc, weights=weights[slot], minlength=words.n_docs) / np.maximum(share, 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 8000, bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """Learn weights from at most ``most_rows`` labelled documents that are not held out.

    Null labels are left out, and rows that repeat an id are learned from once. Without
    any labelled row all weights are 0, and every score is one half.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks() if held else None
        rows = [(table.column("text").chunk(0), table.column("y").to_numpy())] if table is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([learn(rows, bits, epochs).astype("<f8").tobytes()], pa.binary())], names=["weights"])

    sample = labelled_sample(docs, labels, label, most_rows).repartition(1)  # not coalesce: that would read all documents in this task
    found = sample.mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(found[0].weights, "<f8") if found else np.zeros((1 << bits) + 1)


def classify_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7, bits: int = BITS) -> DataFrame:
    """Add held_out, score and predicted (1 if score >= threshold) to every row.

    docs needs ``doc_id`` and ``text``; all other columns stay, but for any of the names
    added. A null, empty or wordless text has the score of the intercept alone. Rows are
    scored one by one, whatever they repeat. An empty table gives an empty one.
    """
    added = ["held_out", "score", "predicted"]
    frame, names = sheltered(docs, ["doc_id", "text"], added)
    frame = frame.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, end, words in words_of(batch.column("text"), SPACE_WORDS):
                scores[row:end] = score_words(words, w, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    out = frame.mapInArrow(rows, extended(frame, "score double"))
    out = out.withColumn("held_out", is_held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unsheltered(out, names, added)
