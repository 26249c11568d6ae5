"""URL filter: a trie over reversed host labels, then path segments.

Allow and block entries share one trie. An entry fits the urls of its host and of all
subdomains whose path starts with the entry's path. Walking a url down the trie visits
every entry that fits it, so the deepest one met is the longest match and decides.

The entries are broadcast after their number and their characters were checked against
``MOST_ENTRIES`` and ``MOST_CHARS``; the trie of so many takes about 130 MB, and a worker
process builds it once for all of its tasks. A larger list is joined instead: each url is
expanded into its host suffixes and the beginnings of its path that end with a segment,
labels times segments of them, then into the lengths of entries known there, and matched
by equality.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import extended, sheltered, unsheltered

MOST_ENTRIES = 100_000
MOST_CHARS = 16_000_000
_SEGMENT = re.compile(r"[^/]*/")


class Trie:
    """Nodes are dicts; "path" of a host node starts its paths; None holds the entries that end within a segment: their sorted remainders, for each the place of its longest proper beginning among them (or -1), and (rule, verdict)."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.root: dict = {}
        ends: dict[int, tuple[dict, dict]] = {}
        for host, path, verdict in entries:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            segments = _SEGMENT.findall(path)
            node = node.setdefault("path", {})
            for segment in segments:
                node = node.setdefault(segment, {})
            rest = path[sum(map(len, segments)) :]
            at_node = ends.setdefault(id(node), (node, {}))[1]
            at_node[rest] = max(at_node.get(rest, ()), (verdict == "block", host + path, verdict))
        for node, found in ends.values():
            rests = sorted(found)
            up, chain = [], []
            for i, rest in enumerate(rests):
                while chain and not rest.startswith(rests[chain[-1]]):
                    chain.pop()
                up.append(chain[-1] if chain else -1)
                chain.append(i)
            node[None] = (rests, up, [found[r][1:] for r in rests])

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest entry: the most host labels, then the longest path. Block wins over an equal allow."""
        best: tuple = ()
        node = self.root
        depth = 0
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            depth += 1
            below = node.get("path")
            at = 0
            while below is not None:
                step = _SEGMENT.match(path, at)
                if None in below:
                    rests, up, found = below[None]
                    # All entries that begin the segment are the last one not above it, or beginnings of that one.
                    i = bisect_right(rests, path[at : step.end() - 1] if step else path[at:]) - 1
                    while i >= 0 and not path.startswith(rests[i], at):
                        i = up[i]
                    if i >= 0:
                        best = found[i]  # hosts come by rising depth and paths by rising length
                if step is None:
                    break
                below = below.get(step.group())
                at = step.end()
        return best or (None, None)


_TRIES: dict[str, Trie] = {}


def trie_of(name: str, entries: list[tuple[str, str, str]]) -> Trie:
    """The worker's trie of these entries. Others are dropped."""
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie(entries)
    return _TRIES[name]


def _walk(shared, default: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(*shared.value)
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule, verdict = pa.array([x for x, _ in found], pa.string()), pa.array([y or default for _, y in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return rows


def split_url(url) -> tuple:
    """(host, path) columns: host up to /, ? or #, with A-Z lower-cased; both empty where there is no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge the ``url`` of every row; all other columns stay, but for any named host, path, rule or verdict.

    rules: (host, path, verdict), verdict allow or block; rows with a null are ignored.
    Adds host, path, rule (host and path of the deciding entry, or null) and verdict
    (``default`` where no entry fits). A null url, or one without ://, has empty host
    and path. Equal entries that disagree block. Repeated urls are judged alike. Empty
    tables are no error. The work for a url grows with its labels times its segments.
    """
    added = ["host", "path", "rule", "verdict"]
    frame, names = sheltered(pages, ["url"], added)
    host, path = split_url(F.col("url").cast("string"))
    frame = frame.withColumns({"host": host, "path": path})
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("chars")).first()
    if size.n <= MOST_ENTRIES and size.chars <= MOST_CHARS:
        shared = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in rules.collect()]))
        judged = frame.mapInArrow(_walk(shared, default), extended(frame, "rule string, verdict string"))
    else:
        judged = _by_join(frame, rules, default)
    return unsheltered(judged, names, added)


def _by_join(frame: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by equi-joins of the parts of each distinct url."""
    urls = frame.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    entries = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    known = entries.groupBy("rule_host", F.regexp_extract("rule_path", "(?s)^(?:.*/)?", 0).alias("folder")).agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    # Lengths of the beginnings of the path that end with a slash, and 0.
    segments = F.split("path", "/")
    cuts = F.aggregate(F.slice(segments, F.lit(1), F.size(segments) - 1), F.array(F.lit(0)), lambda had, s: F.concat(had, F.array(F.element_at(had, -1) + F.length(s) + 1)))
    wide = urls.withColumn("rule_host", F.explode(suffixes)).join(entries.select("rule_host").distinct(), "rule_host", "left_semi")
    wide = wide.withColumn("cut", F.explode(cuts)).withColumn("folder", F.substring("path", F.lit(1), F.col("cut"))).join(known, ["rule_host", "folder"])
    wide = wide.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path")).withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    hits = wide.select("host", "path", "rule_host", "rule_path").join(entries, ["rule_host", "rule_path"])
    rank = F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"), F.col("rule_verdict") == "block", F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = frame.join(best, ["host", "path"], "left")
    return out.select(*frame.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
