"""Whitening against integers and a decomposition without Spark, and its edge cases."""

import math

import numpy as np
import pytest

from panelwright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(n, {place: (deviation, whitened)}, explained) with Python integers."""
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(xs[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    v = np.array([[sum(x[i] * x[j] * n for x in fit) - s[i] * s[j] for j in range(d)] for i in range(d)], dtype=object)
    e, w = np.linalg.eigh((v / n**2).astype(float))
    e, w = e[::-1], w[:, ::-1]
    centred = [[n * x[i] - s[i] for i in range(d)] for x in xs]
    return n, [sum(z * z for z in c) for c in centred], (np.array(centred, dtype=float) / n) @ w / np.sqrt(e), e / e.sum()


def test_whitening_against_plain_integers(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 9)) * np.array([8, 5, 3, 2, 1, 1, 0.7, 0.5, 0.3])
    rows = [(i, [float(x) for x in base[i % 80]]) for i in range(90)]  # ten copies
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5), components=6)
    n, deviation, white, explained = plain(rows)
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert n == 80 and len(found) == 90 * 6 and got.count() == 90 * 6
    for k in range(6):
        sign = math.copysign(1, found[0, k + 1].whitened * white[0, k])
        for i in range(90):
            r = found[i, k + 1]
            assert (r.n, r.deviation) == (80, deviation[i]) and r.identity_error < 1e-9
            assert r.whitened == pytest.approx(sign * white[i, k], rel=1e-9, abs=1e-9) and r.explained == pytest.approx(explained[k], rel=1e-9)


@pytest.mark.parametrize("largest", [60, 1 << 30, 1 << 61])
def test_cross_products_and_sums_are_exact(largest):
    rng = np.random.default_rng(largest % 97)
    y = rng.integers(-largest, largest, size=(9000, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.cross_products(y).tolist() == want
    assert whitening.column_sums(y).tolist() == [sum(map(int, y[:, i])) for i in range(3)]


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(np.float32(s * 10.0**p)), 1.0 * i]) for i, (s, p) in enumerate([(1, 15), (-3, 16), (7, 14), (2, 3)])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r.component for r in got} <= {1, 2} and all(r.deviation is None for r in got if r.vec_id == 1)


def test_whitening_edges(spark):
    odd = [(1, [0.5, 1.0]), (2, [0.5, -1.0]), (2, [0.5, -1.0]), (None, [2.0, 0.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (10, [3.0e38, 0.0]), (11, [-0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in odd], SCHEMA).selectExpr("*", "1 AS x", "2 AS n", "3 AS whitened")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got if r.component == 1) == [(False, 1), (False, 2), (False, 2), (False, 11), (True, 0)]
    assert {r.n for r in got} == {4} and got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], SCHEMA)).collect() == []
