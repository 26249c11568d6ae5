"""Main text of HTML pages by a linear-chain conditional random field.

A page is the sequence of its leaf blocks. Each block has features of its ancestors
(tags, class and id words) and of its text (length, links, marks); two labels, main
text or not, depend on the features and on the label of the block before. Weights are
learned on labelled pages by gradient steps on the log-likelihood, with expectations by
the forward-backward recursion; pages are decoded by the Viterbi recursion.

Learning is over a fixed number of made-up labelled pages of many layouts, or over pages
that the caller passes. The model is a table of a few thousand weights, broadcast to
the tasks. Extraction is one pass over the pages without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.htmlblocks import Block, blocks_of, labelled_pages
from panelwright.llm.shared import extended, sheltered, unsheltered

_MOST_PATHS = 200_000


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    """Features of the ancestors."""
    out = {f"in={tag}" for tag, _ in path}
    for tag, names in path:
        for name in names.split():
            out.add(f"name={name}")
        if names:
            out.add(f"named {tag}")
    if path:
        out.add(f"tag={path[-1][0]}")
        out |= {f"last name={name}" for name in path[-1][1].split()}
    if len(path) > 1:
        out.add(f"parent={path[-2][0]}")
    out.add("bias")
    return sorted(out)


def text_features(block: Block) -> list[str]:
    """Features of the text."""
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    share = block.linked / n
    out = [f"words={min(words.bit_length(), 7)}", f"links={0 if not block.linked else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]
    if text[-1] in ".!?":
        out.append("ends a sentence")
    if "©" in text:
        out.append("copyright")
    if text.count(",") + text.count(".") >= 3:
        out.append("sentences")
    return out


@dataclass
class Model:
    """Weights of features for the label main text (against the other), and of label pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    _paths: dict = field(default_factory=dict, repr=False)

    def emissions(self, blocks: list[Block]) -> list[float]:
        get, paths = self.weights.get, self._paths
        out = []
        for b in blocks:
            score = paths.get(b.path)
            if score is None:
                if len(paths) > _MOST_PATHS:
                    paths.clear()
                score = paths[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            out.append(score + sum(get(f, 0.0) for f in text_features(b)))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels."""
        scores = self.emissions(blocks)
        if not scores:
            return []
        (p00, p01), (p10, p11) = self.pairs
        a, b = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            stay, come = a + p00, b + p10
            leave, keep = a + p01, b + p11
            back.append((stay < come, leave < keep))
            a, b = max(stay, come), max(leave, keep) + s
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        return "\n".join(b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


def _log_sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def marginals(scores: list[float], pairs: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """(probability of label 1 at each place, expected counts of label pairs)."""
    n = len(scores)
    forward = [(0.0, scores[0])]
    for s in scores[1:]:
        a, b = forward[-1]
        forward.append((_log_sum(a + pairs[0][0], b + pairs[1][0]), s + _log_sum(a + pairs[0][1], b + pairs[1][1])))
    backward = [(0.0, 0.0)] * n
    for t in range(n - 2, -1, -1):
        a, b = backward[t + 1]
        s = scores[t + 1]
        backward[t] = (_log_sum(pairs[0][0] + a, pairs[0][1] + s + b), _log_sum(pairs[1][0] + a, pairs[1][1] + s + b))
    total = _log_sum(*forward[-1])
    ones = [math.exp(f[1] + b[1] - total) for f, b in zip(forward, backward, strict=True)]
    counts = [[0.0, 0.0], [0.0, 0.0]]
    for t in range(1, n):
        for i in (0, 1):
            for j in (0, 1):
                counts[i][j] += math.exp(forward[t - 1][i] + pairs[i][j] + (scores[t] if j else 0.0) + backward[t][j] - total)
    return ones, counts


def train(pages: list[tuple[str, list[int]]], epochs: int = 6, rate: float = 0.3, penalty: float = 1e-4) -> Model:
    """Learn from (html, label of each leaf block). A page whose labels do not match its blocks is an error."""
    data = []
    for page, labels in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        if blocks:
            data.append(([path_features(b.path) + text_features(b) for b in blocks], labels))
    model = Model()
    weights, squares = model.weights, {}
    pair_squares = [[1e-6] * 2, [1e-6] * 2]
    for _ in range(epochs):
        for features, labels in data:
            scores = [sum(weights.get(f, 0.0) for f in fs) for fs in features]
            ones, counts = marginals(scores, model.pairs)
            gradient: dict[str, float] = {}
            for fs, y, p in zip(features, labels, ones, strict=True):
                for f in fs:
                    gradient[f] = gradient.get(f, 0.0) + y - p
            for f, g in gradient.items():
                w = weights.get(f, 0.0)
                g -= penalty * w
                squares[f] = squares.get(f, 1e-6) + g * g
                weights[f] = w + rate * g / math.sqrt(squares[f])
            for a, b in zip(labels[:-1], labels[1:], strict=True):
                counts[a][b] -= 1
            for i in (0, 1):
                for j in (0, 1):
                    g = -counts[i][j] - penalty * model.pairs[i][j]
                    pair_squares[i][j] += g * g
                    model.pairs[i][j] += rate * g / math.sqrt(pair_squares[i][j])
    return model


@lru_cache(maxsize=2)
def standard_model(pages: int = 800) -> Model:
    """Learned on ``pages`` made-up labelled pages."""
    return train(labelled_pages(pages))


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Add text, the main text of ``html``, and n_chars, its code points. Other columns stay, but for any of these names and html.

    Blocks are joined in page order by one line feed; a page without main text, an empty
    or a null html has an empty text. Of equally likely labels a block gets "not main".
    Repeated rows are extracted alike. An empty table gives an empty one.
    """
    model = model or standard_model()
    frame, names = sheltered(pages, ["html"], ["text", "n_chars"])
    frame = frame.withColumn("html", F.col("html").cast("string"))
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.pairs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            column = batch.column("html")
            kept = [i for i, c in enumerate(batch.schema.names) if c != "html"]
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [own.main_text(x) for x in column.slice(a, 500).to_pylist()]
                columns = [part.column(i) for i in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in kept), "text", "n_chars"])

    out = frame.mapInArrow(rows, extended(frame.drop("html"), "text string, n_chars long"))
    names = {c: x for c, x in names.items() if x != "html"}
    return unsheltered(out, names, ["text", "n_chars"])
