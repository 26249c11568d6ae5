"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: compatibility decomposition (styled, circled and full-width
letters, ligatures), marks and invisible characters gone, case, look-alike letters of other
scripts, digits and signs that stand for letters; all that is no letter becomes a space. Lexicon entries are the beginnings of words. A hit inside an exception
phrase does not count. The weights of the hits are summed and put in relation to the
number of words; a logistic curve over both gives the score.

The lexicon is learned from labelled rows: for every word beginning, the labelled
documents of either kind that hold it are counted in Spark, and entries are those that
toxic documents hold too often for chance (an exact binomial test, with the rate of
false discoveries among all candidates held at 1 %). The weight is the log odds.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import extended, sheltered, unsheltered, written
from panelwright.llm.training import is_held_out, labelled_sample

#: Letters of other scripts that look like Latin ones, each followed by its Latin letter. Fixed values.
LOOK_ALIKE = "аaеeоoрpсcуyхxіiѕsјjһhԁdԛqԝwкkмmтtнhвbгrάaαaοoεeιiνvρpυuκkτtχxıi"
#: Digits and signs that stand for letters. Fixed values.
STANDS_FOR = "0o1i3e4a5s7t8b9g@a$s"
#: Phrases in which a word of the lexicon is harmless. Fixed values.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash bag", "pathetic fallacy", "sore loser", "worthless stock")

_SPACE = 32
_GONE = 0
#: No letter comes after it, but for planes without any. Fixed value.
_LAST_LETTER = 0x33FFF


def fold_table() -> np.ndarray:
    """Code point to folded code point, for every code point. Texts are decomposed before, so it need not know composed or styled letters."""
    table = np.full(0x110000, _SPACE, dtype=np.uint32)
    for c in range(_LAST_LETTER + 1):
        kind = unicodedata.category(chr(c))
        lower = chr(c).lower()
        if kind in ("Mn", "Me", "Cf"):
            table[c] = _GONE  # marks, joiners and other invisible characters
        elif kind == "Mc":
            table[c] = c
        elif kind[0] == "L":
            table[c] = ord(lower) if len(lower) == 1 else c
    table[0xE0001:0xE01F0] = _GONE  # tags and variation selectors
    for pairs in (LOOK_ALIKE, STANDS_FOR):
        for a, b in zip(pairs[::2], pairs[1::2], strict=True):
            table[ord(a)] = ord(b)
            if a.upper() != a and len(a.upper()) == 1:
                table[ord(a.upper())] = ord(b)
    return table


_TABLE: list[np.ndarray] = []


def fold(text: str) -> tuple[str, int]:
    """(folded text with a space at either end, number of words)."""
    if not _TABLE:
        _TABLE.append(fold_table())
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.full(len(codes) + 2, _SPACE, dtype=np.uint32)
    out[1:-1] = _TABLE[0][codes]
    out = out[out != _GONE]
    n = int(np.count_nonzero((out[1:] != _SPACE) & (out[:-1] == _SPACE)))
    return out.tobytes().decode("utf-32-le", "surrogatepass"), n


@dataclass
class Model:
    """Lexicon of word beginnings with weights, exception phrases, and the logistic curve."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.0)  # intercept, log of the weight, log of the weight a thousand words

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for stem, weight in self.lexicon.items():
            out.add_word(f" {stem}", (len(stem) + 1, weight))
        for phrase in self.exceptions:
            folded = fold(phrase)[0]
            out.add_word(folded, (len(folded), None))
        if len(out):
            out.make_automaton()
        return out

    def evidence(self, text: str | None, automaton) -> tuple[float, int]:
        """(weight of the hits outside of exception phrases, number of words)."""
        folded, n = fold(text or "")
        hits, spared = [], []
        if len(automaton):
            for end, (length, weight) in automaton.iter(folded):
                (spared if weight is None else hits).append((end - length + 1, end, weight))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
        longest: dict[int, float] = {}
        for a, _, weight in hits:  # of entries that begin at one place, the last is the longest
            longest[a] = weight
        return sum(longest.values()), n

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = features(weight, words)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -35, 35)))


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log of the weight, and of the weight in relation to the length."""
    return np.stack([np.log1p(weight), np.log1p(1000 * weight / np.maximum(words, 1))], axis=1)


def _tail(a: int, n: int, p: float) -> float:
    """Log of the probability of a or more of n."""
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) for k in range(a, n + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def not_by_chance(p: float):
    """Column (of a and n): whether _tail(a, n, p) can be below log(0.01), which every entry is. It keeps every such entry, and few others.

    The tail of a out of n is at least exp(-n d) / sqrt(8 a (1 - a / n)), with d the
    divergence of a / n from p.
    """
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    b = n - a
    bits = a * F.log(a / (n * p)) + F.when(b > 0, b * F.log(b / (n * (1 - p)))).otherwise(0.0)
    least = -bits - F.when(b > 0, 0.5 * F.log(8 * a * b / n)).otherwise(0.0)
    return (a > n * p) & (least <= math.log(0.01))


def _beginnings(longest: int):
    """Beginnings of a document's words, with its label and its kin: near copies mostly share the word pair of least hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems, labels, kin = [], [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = fold(text)[0].split()
                own = {w[:k] for w in set(words) for k in range(3, min(len(w), longest) + 1)}
                stems += own
                labels += [y] * len(own)
                pairs = {f"{a} {b}" for a, b in zip(words, [*words[1:], ""], strict=True)}
                kin += [min((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in pairs), default=0)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(labels, pa.int32()), pa.array(kin, pa.int64())], names=["stem", "y", "kin"])

    return rows


def choose_entries(counts: dict[str, tuple[int, int]], tests: int, toxic: int, clean: int) -> dict[str, float]:
    """Weights of the significant beginnings, of which about one in a hundred is so by chance (Benjamini and Hochberg's rule over all ``tests``). Of nested ones the most significant is taken, in its longest form that is about as frequent."""
    base = toxic / (toxic + clean)
    tails = sorted((_tail(a, n, base), -len(stem), stem) for stem, (a, n) in counts.items())
    limit = max((t for i, (t, _, _) in enumerate(tails, 1) if t <= math.log(0.01 * i / max(tests, 1))), default=-math.inf)
    longer: dict[str, list[str]] = {}
    for stem in counts:
        for k in range(3, len(stem)):
            if stem[:k] in counts:
                longer.setdefault(stem[:k], []).append(stem)
    lexicon: dict[str, float] = {}
    taken: set[str] = set()
    for tail, _, stem in tails:
        if tail > limit:
            break
        if stem in taken or any(stem[:k] in lexicon for k in range(3, len(stem))):
            continue  # a longer or a shorter form of it is there
        stem = max([stem, *(x for x in longer.get(stem, ()) if counts[x][0] >= 0.95 * counts[stem][0])], key=lambda x: (len(x), x))
        a, n = counts[stem]
        lexicon[stem] = math.log((a + 0.5) / (toxic + 1)) - math.log((n - a + 0.5) / (clean + 1))
        taken |= {stem[:k] for k in range(3, len(stem) + 1)}
    return lexicon


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 12000, longest: int = 12, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn lexicon and curve from at most ``most_rows`` labelled documents that are not held out.

    Entries have from 3 to ``longest`` letters: shorter words are never entries, and words
    that agree in their first ``longest`` letters are one. More than 70 % of the documents
    that hold an entry are toxic, more than of all learned rows, and so many that it is not
    by chance. An entry so needs several toxic rows, which bounds the lexicon by the
    learned texts; nothing else does. ``exceptions`` is the caller's list of phrases.

    Labels that are null and rows without a label are not learned from; rows that repeat
    an id are learned from once. Of equally significant entries the
    longer comes first, then the one earlier in the alphabet. Without labelled rows of
    both kinds the lexicon is empty and every score is that of no hit.
    """
    sample = written(labelled_sample(docs, labels, label, most_rows).select("text", "y"), "sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(exceptions=exceptions)
    counted = sample.mapInArrow(_beginnings(longest), "stem string, y int, kin long").groupBy("stem", "kin").agg(F.max("y").alias("y"))
    tested = written(counted.groupBy("stem").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where("a >= 3"), "beginnings")
    base = toxic / (toxic + clean)
    tests = tested.count()
    plausible = tested.where((F.col("a") > 0.7 * F.col("n")) & not_by_chance(base))
    lexicon = choose_entries({r.stem: (r.a, r.n) for r in plausible.collect()}, tests, toxic, clean)
    model = Model(lexicon, exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = sample.mapInArrow(_evidence_rows(shared, "y"), "y int, weight double, words long").orderBy("y", "weight", "words").collect()
    model.curve = _fit_curve(np.array([r.weight for r in seen]), np.array([r.words for r in seen]), np.array([r.y for r in seen]))
    return model


def _fit_curve(weight: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Regularised logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(y)), features(weight, words)])
    w = np.zeros(3)
    penalty = np.diag([1e-3, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _evidence_rows(shared, *keep: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.automaton()
        for batch in batches:
            found = [model.evidence(t, automaton) for t in batch.column("text").to_pylist()]
            names = keep or batch.schema.names
            columns = [batch.column(c) for c in names] + [pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "weight", "words"])

    return rows


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add held_out, weight, words, score and predicted (1 if score >= threshold) to every row.

    docs needs ``doc_id`` and ``text``; all other columns stay, but for any of the names
    added. A null or empty text has no hit and no word, and the score of that. Rows are
    scored one by one, whatever they repeat. An empty table gives an empty one.
    """
    added = ["held_out", "weight", "words", "score", "predicted"]
    frame, names = sheltered(docs, ["doc_id", "text"], added)
    frame = frame.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = frame.mapInArrow(_evidence_rows(shared), extended(frame, "weight double, words long"))
    a, b, c = (F.lit(x) for x in model.curve)
    line = a + b * F.log1p("weight") + c * F.log1p(1000 * F.col("weight") / F.greatest("words", F.lit(1)))
    out = out.withColumn("score", 1 / (1 + F.exp(-line))).withColumn("held_out", is_held_out(F.col("doc_id")))
    return unsheltered(out.withColumn("predicted", (F.col("score") >= threshold).cast("int")), names, added)
