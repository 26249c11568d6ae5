"""Distributions of the DF-GLS and Zivot-Andrews statistics where a unit root is there.

Quantiles of random walks, simulated by ``break_statistics`` and ``gls_statistics`` with the
seeds and sizes that stand with the tables. P-values are read between them along straight
lines in the quantiles of the normal distribution, and carried on beyond the outermost. The
published critical values are points of the tables of Zivot and Andrews (1992) and of
Elliott, Rothenberg and Stock (1996), which are taken as they are; simulated quantiles
between and beyond them are moved along by as much as the published ones differ.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

#: Probabilities of the tables, and those of the published values.
PROBABILITIES = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 0.999)
PUBLISHED_P = (0.01, 0.05, 0.10)
#: Published critical values by kind of break, and of DF-GLS with a constant for long series. Fixed values.
ZA_PUBLISHED = {"c": (-5.34, -4.80, -4.58), "t": (-4.93, -4.42, -4.11), "ct": (-5.57, -5.08, -4.82)}
GLS_PUBLISHED = (-2.58, -1.95, -1.62)
#: break_statistics(1000, 60000, 11) at the probabilities. Fixed values.
ZA_SIMULATED = {
    "c": (-5.833, -5.481, -5.297, -5.027, -4.795, -4.539, -4.244, -4.036, -3.862, -3.701, -3.545, -3.38, -3.182, -2.907, -2.664, -2.174, -1.509),
    "t": (-5.463, -5.078, -4.895, -4.626, -4.393, -4.119, -3.8, -3.578, -3.394, -3.226, -3.065, -2.894, -2.705, -2.451, -2.26, -1.934, -1.611),
    "ct": (-6.161, -5.759, -5.582, -5.32, -5.095, -4.841, -4.543, -4.33, -4.155, -3.996, -3.84, -3.679, -3.494, -3.238, -3.036, -2.662, -2.18),
}
#: Least squares of the quantiles of gls_statistics(n, ..., 100 + n), n of 50, 100, 200, 400 (400,000 walks) and 1000 (200,000), on 1, 1 / n and 1 / n^2. Fixed values.
GLS_SURFACE = (
    (-3.256, -25.24, 153.0), (-2.798, -19.42, 83.0), (-2.563, -19.44, 135.0), (-2.224, -20.75, 227.0), (-1.94, -21.79, 265.0), (-1.619, -22.95, 282.0),
    (-1.236, -26.09, 347.0), (-0.965, -29.32, 409.0), (-0.732, -32.81, 470.0), (-0.502, -37.15, 542.0), (-0.241, -43.13, 642.0), (0.054, -46.6, 647.0),
    (0.404, -48.81, 611.0), (0.887, -49.64, 497.0), (1.284, -50.1, 410.0), (2.02, -49.81, 218.0), (2.833, -44.99, -212.0),
)


def normal_quantiles(p: tuple[float, ...] = PROBABILITIES) -> list[float]:
    return [NormalDist().inv_cdf(x) for x in p]


def _moved(simulated: list[float], published: tuple[float, ...]) -> list[float]:
    """By how much each simulated quantile moves, so that those of the published probabilities become the published ones."""
    apart = [v - simulated[PROBABILITIES.index(p)] for v, p in zip(published, PUBLISHED_P, strict=True)]
    return [round(float(x), 6) for x in np.interp(normal_quantiles(), normal_quantiles(PUBLISHED_P), apart)]


def za_quantiles(kind: str) -> list[float]:
    """Quantiles of the Zivot-Andrews statistic at PROBABILITIES."""
    return [round(q + m, 6) for q, m in zip(ZA_SIMULATED[kind], _moved(ZA_SIMULATED[kind], ZA_PUBLISHED[kind]), strict=True)]


def gls_terms() -> list[tuple[float, float, float]]:
    """Of each quantile of the DF-GLS statistic with a constant, the terms on 1, 1 / n and 1 / n^2."""
    moves = _moved([a for a, _, _ in GLS_SURFACE], GLS_PUBLISHED)
    return [(round(a + m, 6), b, c) for (a, b, c), m in zip(GLS_SURFACE, moves, strict=True)]


def gls_quantiles(n) -> list:
    """These quantiles for n values; n may be a number or an expression."""
    return [a + b / n + c / (n * n) for a, b, c in gls_terms()]


def _least_t(x: np.ndarray, y: np.ndarray, columns: list[np.ndarray], df: int) -> np.ndarray:
    """The least t statistic of x over places; a column is a matrix with a row a time and a unit vector a place, those of a place at right angles."""
    xx, xy, yy = (x * x).sum(1)[:, None], (x * y).sum(1)[:, None], (y * y).sum(1)[:, None]
    for c in columns:
        cx, cy = x @ c, y @ c
        xx, xy, yy = xx - cx * cx, xy - cx * cy, yy - cy * cy
    return (xy / xx / np.sqrt((yy - xy * xy / xx) / df / xx)).min(axis=1)


def break_statistics(n: int, walks: int, seed: int, trim: float = 0.15) -> dict[str, np.ndarray]:
    """Zivot-Andrews statistics without lags of ``walks`` random walks of n values, by kind of break."""
    rng, m = np.random.default_rng(seed), n - 1
    time = np.arange(1, n, dtype=float)
    base = np.linalg.qr(np.column_stack([np.ones(m), time]))[0]
    places = np.arange(int(n * trim), int(n * (1 - trim)))
    free = lambda v: v - base @ (base.T @ v)
    unit = lambda v: v / np.sqrt((v * v).sum(axis=0))
    step, slope = unit(free((time[:, None] > places).astype(float))), unit(free(np.maximum(time[:, None] - places, 0.0)))
    beside = unit(slope - step * (step * slope).sum(axis=0))
    out: dict[str, list[np.ndarray]] = {"c": [], "t": [], "ct": []}
    for _ in range(0, walks, 2000):
        d = rng.normal(size=(2000, m))
        x = np.cumsum(d, axis=1) - d
        x, y = (v - (v @ base) @ base.T for v in (x, d))
        for kind, columns in (("c", [step]), ("t", [slope]), ("ct", [step, beside])):
            out[kind].append(_least_t(x, y, columns, m - 3 - len(columns)))
    return {k: np.concatenate(v)[:walks] for k, v in out.items()}


def gls_statistics(n: int, walks: int, seed: int) -> np.ndarray:
    """DF-GLS statistics with a constant, without lags, of ``walks`` random walks of n values."""
    rng, a = np.random.default_rng(seed), 1 - 7.0 / n
    out = []
    for _ in range(0, walks, 5000):
        x = np.cumsum(rng.normal(size=(5000, n)), axis=1)
        beta = (x[:, 0] + (1 - a) * (x[:, 1:] - a * x[:, :-1]).sum(axis=1)) / (1 + (n - 1) * (1 - a) ** 2)
        u = x - beta[:, None]
        level, d = u[:, :-1], np.diff(u, axis=1)
        b = (level * d).sum(1) / (level * level).sum(1)
        rss = ((d - b[:, None] * level) ** 2).sum(1)
        out.append(b / np.sqrt(rss / (n - 2) / (level * level).sum(1)))
    return np.concatenate(out)[:walks]
