"""Links of near vectors against all pairs, and edge cases."""

import numpy as np
import pytest

from panelwright.llm import flatgraph, vectordedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, limit=0.9):
    """{place: (n_links, component)} of all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= limit:
                    links[i] += 1
                    links[j] += 1
                    old, new = root[i], root[j]
                    root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((-1 if i is None else i), n, least.get(r, -1), i == least.get(r)) for (i, _), n, r in zip(rows, links, root, strict=True))


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in df.collect())


def groups(seed, n, d=16):
    """Unit vectors with copies, and groups of near copies, one of them a third of all."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0] + rng.normal(size=(n // 3, d)) * 0.12
    for k in range(n // 3, n - 3, 9):
        x[k + 1 : k + 3] = x[k] + rng.normal(size=(2, d)) * 0.15
        x[k + 3] = x[k]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(v) for v in np.float32(r)]) for i, r in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize(("seed", "n", "shard"), [(1, 300, 40), (2, 300, 1000)])
def test_links_against_all_pairs(spark, seed, n, shard):
    rows = groups(seed, n)
    got, recall = vectordedup.link_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), shard_rows=shard, least_recall=1.0)
    assert recall == 1.0
    want = plain(rows)
    have = found(got)
    assert [r[0] for r in have] == [r[0] for r in want] and all(h[1] <= w[1] for h, w in zip(have, want, strict=True))
    assert sum(r[1] for r in have) >= 0.995 * sum(r[1] for r in want)
    assert sum(h == w for h, w in zip(have, want, strict=True)) >= 0.97 * n


def test_a_scan_of_blocks_finds_every_link(spark):
    rows = groups(3, 200)
    frame = vectordedup.classes(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    told = vectordedup._searched(frame, 200, 16, 0.9, 30, 20_000, 4.0, 24, True)
    exact = sum(r[1] for r in plain(rows))
    own = {r.cid: r.mult for r in frame.collect()}
    assert sum(r.links * own[r.node] for r in told.collect()) + sum(m * (m - 1) for m in own.values()) == exact


def test_an_audit_below_its_limit_widens_the_search(spark, monkeypatch):
    rows = groups(4, 120)
    frame, tried = spark.createDataFrame([(i * 100, v, 0) for i, v in rows], SCHEMA), []
    real = vectordedup._searched
    monkeypatch.setattr(vectordedup, "_searched", lambda *a: tried.append(a[-1]) or (real(*a) if a[-1] else real(*a).where("node < 0")))
    got, recall = vectordedup.link_vectors(frame, shard_rows=30)
    assert tried == [False, False, True] and recall == 1.0
    assert found(got) == plain([(i * 100, v) for i, v in rows])


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.1]), (4, None), (5, []), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [0.0, 0.0]), (9, [-0.0, 0.0]), (10, [1.0]), (11, [3e38, 1e37]), (12, [1e-45, 0.0]), (13, [-1.0, 0.0]), (None, [0.0, 1.0]), (14, [0.9, 0.43588989])]
    got, _ = vectordedup.link_vectors(spark.createDataFrame([(i, v, 0) for i, v in odd], SCHEMA).selectExpr("*", "1 AS v", "2 AS cid", "3 AS kept"))
    assert found(got) == plain(odd)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert vectordedup.link_vectors(spark.createDataFrame([], SCHEMA))[0].collect() == []


def test_graph_search_against_all_pairs():
    x = np.array([v for _, v in groups(5, 600, 24)], dtype=np.float32)
    graph = flatgraph.build(x)
    assert (graph >= 0).sum(axis=1).max() < 40 and (graph != np.arange(600)[:, None]).all()
    edges, start = flatgraph.both_ways(graph), flatgraph.medoids(x)
    q, t = flatgraph.range_search(x, graph, edges, start, x, 0.8, 24)
    again, _ = flatgraph.range_search(x, graph, edges, start, x, 0.8, 24, np.arange(600))
    assert len(again) >= len(q)
    known = set(zip(q.tolist(), t.tolist(), strict=True))
    exact = set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.9)), strict=True))
    assert len(known & exact) >= 0.999 * len(exact)


def test_pruning_keeps_the_nearest_and_spreads():
    x = np.array([[1, 0], [0.99, 0.141], [0.98, 0.199], [0.6, -0.8]], dtype=np.float32)
    kept = flatgraph.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1]]), 3)
    assert kept.tolist() == [[1, 3, -1]]
