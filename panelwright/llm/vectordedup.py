"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors become one class with a count. Each further step works on classes.
2. Centroids of a bounded sample (``most_sample`` classes of least hash) by spherical
   k-means, one for ``shard_rows`` classes and 4,096 at most. A class is at home at the
   nearest centroid, and is a target of every shard whose border lies within the reach of
   a near-duplicate: turned by the limit's angle in a random direction, it would cross the
   border only beyond ``reach`` standard deviations. Shards therefore overlap.
3. A shard's targets are dealt to blocks of bounded size by hash, its home classes
   likewise. Each block of targets gets a graph; the adjacency lists that a class has in
   all shards are united.
4. Each block of home classes searches each block of targets of its shard in the united
   graph: greedily from medoids, and from its own place where it is in the block, then
   through all neighbours in a wider range than the limit. A pair is counted where the class that asks is at home, so once. Every pair
   found is verified by its cosine in doubles; only verified ones count.
5. A task sends counts and one edge for a class that is linked (to the least class that
   links within the task reach), never pairs. Components come from those edges.
6. Audit: up to ``most_audit`` classes of ids divisible by 100 are compared with all
   classes without the graph. If less than ``least_recall`` of their links were found,
   the search is repeated with a wider reach and beam, and last with a scan of every
   target block in place of the graph.

Cases. A vector that is null, empty, all zero, or holds null or non-finite entries links
with nothing, as do vectors of different lengths. Every row counts: rows that repeat an id
or a vector are rows of their own, and link if their vectors do. Rows without an id take
part; component_id is the least id of a component's rows that have one (null if none has),
and ``kept`` compares it with vec_id, null equal to null. An empty table gives no rows.
Columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import flatgraph
from panelwright.llm.minhash import components
from panelwright.llm.shared import written

_MOST_CENTROIDS = 4096
_BLOCK_BYTES = 64 << 20
_SEARCH = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Doubles, a row a vector, each scaled by a power of two so that no product overflows or vanishes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """(cid, v, mult, least): distinct vectors that can link, with their rows and the least id."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    found = rows.groupBy("v").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    return written(found.select(F.monotonically_increasing_id().alias("cid"), "v", "mult", "least"), "classes")


def centroids(found: DataFrame, k: int, most_sample: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids of a sample: the classes of least hash."""
    sample = found.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(most_sample).select("v").toArrow()
    x = _units(_matrix(sample.column("v")))
    c = x[np.random.default_rng(3).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], c)
    return c


def _deal(c: np.ndarray, limit: float, reach: float):
    """Rows (cid, v, mult, shard, home): a class at home and in each shard that it may be asked for in."""
    most = math.tan(math.acos(limit)) * min(reach / math.sqrt(c.shape[1]), 1.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                near = _units(_matrix(part.column("v"))) @ c.T
                home = np.argmax(near, axis=1)
                here = np.arange(len(home))
                apart = np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 1e-12))
                row, shard = np.nonzero(near[here, home][:, None] - near <= most * apart)
                yield pa.RecordBatch.from_pydict({n: part.column(n).take(pa.array(row)) for n in ("cid", "v", "mult")} | {"shard": pa.array(shard), "home": pa.array(shard == home[row])})

    return rows


def _graph_of(table: pa.Table) -> pa.Table:
    """(cid, near): the adjacency lists of one block of targets."""
    cid = table.column("cid").to_numpy()
    adjacency = flatgraph.build(_units(_matrix(table.column("v"))).astype(np.float32))
    some = adjacency >= 0
    at = np.r_[0, np.cumsum(some.sum(axis=1))].astype(np.int32)
    return pa.table({"cid": cid, "near": pa.ListArray.from_arrays(at, pa.array(cid[adjacency[some]]))})


def _local(cid: np.ndarray, near: pa.Array) -> np.ndarray:
    """The united lists of ids as places of this block; cid ascends."""
    flat, at = near.flatten().to_numpy(), np.repeat(np.arange(len(near)), near.value_lengths().to_numpy())
    place = np.minimum(np.searchsorted(cid, flat), len(cid) - 1)
    inside = (cid[place] == flat) & (place != at)
    place, at = place[inside], at[inside]
    count = np.bincount(at, minlength=len(cid))
    out = np.full((len(cid), max(int(count.max()), 1)), -1)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)] = place
    return out


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the groups of each pair of places made one, named by the least label."""
    pairs = np.unique(np.c_[label[a], label[b]][label[a] != label[b]], axis=0)
    if not len(pairs):
        return label
    names, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(-1, 2)
    least = np.arange(len(names))
    while True:
        before = least.copy()
        low = np.minimum(least[place[:, 0]], least[place[:, 1]])
        np.minimum.at(least, place[:, 0], low)
        np.minimum.at(least, place[:, 1], low)
        least = least[least]
        if (least == before).all():
            break
    at = np.minimum(np.searchsorted(names, label), len(names) - 1)
    return np.where(names[at] == label, names[least[at]], label)


def _search(limit: float, slack: float, width: int, scan: bool):
    """(node, links, root): verified links of the block's home classes, and what they make one."""
    least = math.cos(min(math.acos(limit) + slack, math.pi)) if not scan else -2.0

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        targets, queries = table.filter(pa.array(~asks)).sort_by("cid"), table.filter(pa.array(asks)).sort_by("cid")
        if not len(targets) or not len(queries):
            return _SEARCH.empty_table()
        cid, own = targets.column("cid").to_numpy(), queries.column("cid").to_numpy()
        mult = targets.column("mult").to_numpy()
        tv, qv = _matrix(targets.column("v")), _matrix(queries.column("v"))
        tn, qn = np.linalg.norm(tv, axis=1), np.linalg.norm(qv, axis=1)
        tx, qx = (tv / tn[:, None]).astype(np.float32), (qv / qn[:, None]).astype(np.float32)
        adjacency = _local(cid, targets.column("near").combine_chunks())
        start, edges = flatgraph.medoids(tx), flatgraph.both_ways(adjacency)
        everyone = np.unique(np.r_[cid, own])
        label, t_at, q_at = np.arange(len(everyone)), np.searchsorted(everyone, cid), np.searchsorted(everyone, own)
        links = np.zeros(len(own), dtype=np.int64)
        here = np.minimum(np.searchsorted(cid, own), len(cid) - 1)
        here = np.where(cid[here] == own, here, -1)
        for a in range(0, len(own), 256):
            if scan:
                q, t = np.nonzero(qx[a : a + 256] @ tx.T >= limit - 1e-3)
            else:
                q, t = flatgraph.range_search(tx, adjacency, edges, start, qx[a : a + 256], least, width, here[a : a + 256])
            q = q + a
            other = own[q] != cid[t]
            q, t = q[other], t[other]
            for b in range(0, len(q), 100_000):  # bounded copies of vectors
                i, j = q[b : b + 100_000], t[b : b + 100_000]
                linked = np.einsum("ij,ij->i", qv[i], tv[j]) / (qn[i] * tn[j]) >= limit
                np.add.at(links, i[linked], mult[j[linked]])
                label = _joined(label, q_at[i[linked]], t_at[j[linked]])
        count = np.zeros(len(everyone), dtype=np.int64)
        count[q_at] = links
        told = (count > 0) | (label != np.arange(len(everyone)))
        return pa.table({"node": everyone[told], "links": count[told], "root": everyone[label[told]]}, schema=_SEARCH)

    return run


def _searched(found: DataFrame, n: int, d: int, limit: float, shard_rows: int, most_sample: int, reach: float, width: int, scan: bool) -> DataFrame:
    """Rows (node, links, root) of all shards."""
    k = max(1, min(_MOST_CENTROIDS, -(-n // shard_rows)))
    c = centroids(found, k, max(k, min(most_sample, _BLOCK_BYTES // (8 * d))))
    most = max(64, min(8 * shard_rows, _BLOCK_BYTES // (8 * d)))
    dealt = written(found.select("cid", "v", "mult").mapInArrow(_deal(c, limit, reach), "cid long, v array<double>, mult long, shard long, home boolean"), "dealt")
    blocks = dealt.groupBy("shard").agg(F.ceil(F.count("*") / most).alias("t_blocks"), F.ceil(F.count_if("home") / most).alias("q_blocks"))
    dealt = dealt.join(blocks, "shard")
    target = F.pmod(F.xxhash64("cid", F.lit(1)), "t_blocks")
    placed = dealt.select("cid", "v", "mult", "shard", "home", "t_blocks", "q_blocks", target.alias("t"))
    near = placed.select("shard", "t", "cid", "v").groupBy("shard", "t").applyInArrow(_graph_of, "cid long, near array<long>")
    near = written(near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    targets = placed.join(near, "cid").where("q_blocks > 0").select("shard", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)).alias("q"), "cid", "v", "mult", "near", F.lit(False).alias("asks"))
    asking = dealt.where("home").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_blocks") - 1)).alias("t"), F.pmod(F.xxhash64("cid", F.lit(2)), "q_blocks").alias("q"), "cid", "v", "mult", F.lit(None).cast("array<long>").alias("near"), F.lit(True).alias("asks"))
    slack = math.radians(8)
    return written(targets.unionByName(asking).groupBy("shard", "t", "q").applyInArrow(_search(limit, slack, width, scan), "node long, links long, root long"), "found")


def _exact_counts(ids: np.ndarray, q: np.ndarray, limit: float):
    """Rows (cid, links): links of the audited classes q to each batch's classes."""
    norm = np.linalg.norm(q, axis=1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                v = _matrix(part.column("v"))
                linked = q @ v.T / (norm[:, None] * np.linalg.norm(v, axis=1)) >= limit
                linked &= ids[:, None] != part.column("cid").to_numpy()
                links += linked @ part.column("mult").to_numpy()
        yield pa.RecordBatch.from_pydict({"cid": pa.array(ids), "links": pa.array(links)})

    return rows


def audited_recall(found: DataFrame, links: DataFrame, limit: float, most_audit: int, every: int = 100) -> float:
    """The share of the links of a bounded sample of classes that ``links`` (cid, links) has, by comparison with all classes."""
    sample = found.where((F.col("least") % every == 0)).select("cid", "v").orderBy(F.xxhash64("least"), "cid").limit(most_audit).toArrow()
    if not len(sample):
        return 1.0
    ids = sample.column("cid").to_numpy()
    exact = found.select("cid", "v", "mult").mapInArrow(_exact_counts(ids, _matrix(sample.column("v")), limit), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("exact"))
    total = exact.join(links, "cid", "left").agg(F.sum("exact").alias("exact"), F.sum(F.least("exact", F.coalesce("links", F.lit(0)))).alias("got")).first()
    return total.got / total.exact if total.exact else 1.0


def _linked_classes(found: DataFrame, d: int, limit: float, shard_rows: int, most_sample: int, most_audit: int, least_recall: float) -> tuple[DataFrame, float]:
    """((cid, links, root) of the linked classes of one length, audited recall)."""
    n = found.count()
    for reach, width, scan in ((1.5, 24, False), (2.5, 48, False), (math.sqrt(d), 24, True)):
        told = _searched(found, n, d, limit, shard_rows, most_sample, reach, width, scan)
        links = told.groupBy(F.col("node").alias("cid")).agg(F.sum("links").alias("links"))
        recall = audited_recall(found, links, limit, most_audit)
        if recall >= least_recall or scan:
            break
    roots = components(told.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return links.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left"), recall


def link_vectors(vectors: DataFrame, limit: float = 0.9, shard_rows: int = 2048, most_sample: int = 20_000, most_audit: int = 1000, least_recall: float = 0.99) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding), the least recall that an audit found)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    found = classes(vectors.select("vec_id", "embedding"))
    parts, recall = [], 1.0
    for r in found.groupBy(F.size("v").alias("d")).count().where("count > 1").collect():
        linked, least = _linked_classes(found.where(F.size("v") == r.d), r.d, limit, shard_rows, most_sample, most_audit, least_recall)
        parts, recall = [*parts, linked], min(recall, least)
    linked = parts[0] if parts else vectors.sparkSession.createDataFrame([], "cid long, links long, root long")
    for more in parts[1:]:
        linked = linked.unionByName(more)
    of = found.join(linked, "cid", "left").select("cid", "v", "mult", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    of = written(of, "linked")
    named = of.groupBy("root").agg(F.min("least").alias("component"))
    of = of.join(named, "root").select("v", "mult", "links", "component")
    out = rows.join(of, "v", "left").select(
        "vec_id",
        F.coalesce(F.col("mult") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("mult").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall
