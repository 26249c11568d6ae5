"""The stationarity tests of one series with NumPy, to compare the Spark expressions with."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

#: Response surface of the Dickey-Fuller test with a constant: small p, large p, and their limits. Fixed values.
_SMALL_P = (2.1659, 1.4412, 0.038269)
_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
_STAR, _LOWEST, _HIGHEST = -1.61, -18.83, 2.74
#: Critical values by regression and the p-values they belong to. Fixed values.
_KPSS_P = (0.10, 0.05, 0.025, 0.01)
_KPSS = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
_DFGLS_P = (0.01, 0.05, 0.10)
_DFGLS = {"c": (-2.58, -1.95, -1.62), "ct": (-3.48, -2.89, -2.57)}
_ZA_P = (0.01, 0.05, 0.10)
_ZA = {"c": (-5.34, -4.80, -4.58), "t": (-4.93, -4.42, -4.11), "ct": (-5.57, -5.08, -4.82)}

def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, standard errors, residual sum of squares)."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    residual = y - x @ beta
    rss = float(residual @ residual)
    spread = rss / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * spread, 0)), rss


def mackinnon_p(t: float) -> float:
    """p-value of a Dickey-Fuller statistic with a constant."""
    if t > _HIGHEST:
        return 1.0
    if t < _LOWEST:
        return 0.0
    surface = _SMALL_P if t <= _STAR else _LARGE_P
    z = sum(c * t**k for k, c in enumerate(surface))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _lagged(x: np.ndarray, lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(level before, differences before), and the differences, from the start-th difference on."""
    d = np.diff(x)
    columns = [x[start : len(d)], *[d[start - k : len(d) - k] for k in range(1, lags + 1)]]
    return np.column_stack(columns), d[start:]


def adf(x: np.ndarray, autolag: str | None = "AIC") -> tuple[float, float]:
    """(statistic, p-value) with a constant. Lags are chosen on a common sample, then the regression runs on all it can."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(x) == 0:
        raise ValueError("too few or constant values")
    best = most
    if autolag:
        scores = []
        for lags in range(most + 1):
            z, y = _lagged(x, lags, most)
            z = np.column_stack([np.ones(len(y)), z])
            rss = _ols(z, y)[2]
            weight = 2.0 if autolag == "AIC" else math.log(len(y))
            scores.append(len(y) * math.log(max(rss, 1e-300) / len(y)) + weight * z.shape[1])
        best = int(np.argmin(scores))
    z, y = _lagged(x, best, best)
    beta, error, _ = _ols(np.column_stack([np.ones(len(y)), z]), y)
    stat = float(beta[1] / error[1])
    return stat, mackinnon_p(stat)


def _long_run(e: np.ndarray, lags: int) -> float:
    """Variance with Bartlett weights."""
    n = len(e)
    total = float(e @ e)
    for k in range(1, lags + 1):
        total += 2 * (1 - k / (lags + 1)) * float(e[k:] @ e[:-k])
    return total / n


def kpss(x: np.ndarray, regression: str = "c", nlags: str | int = "auto") -> tuple[float, float]:
    """(statistic, p-value from 0.01 to 0.10)."""
    n = len(x)
    if regression == "c":
        e = x - x.mean()
    elif regression == "ct":
        z = np.column_stack([np.ones(n), np.arange(1, n + 1)])
        e = x - z @ _ols(z, x)[0]
    else:
        raise ValueError("regression must be c or ct")
    if nlags == "auto":
        most = int(n ** (2 / 9))
        s0, s1 = float(e @ e) / n, 0.0
        for k in range(1, most + 1):
            product = float(e[k:] @ e[:-k]) / (n / 2)
            s0 += product
            s1 += k * product
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    elif nlags == "legacy":
        lags = min(math.ceil(12 * (n / 100) ** 0.25), n - 1)
    else:
        lags = int(nlags)
    stat = float((np.cumsum(e) ** 2).sum()) / (n**2 * _long_run(e, lags))
    return stat, float(np.interp(stat, _KPSS[regression], _KPSS_P))


def tail_p(stat: float, critical: tuple[float, ...], p: tuple[float, ...]) -> float:
    """A p-value through critical values: straight lines between normal quantiles, the outer ones carried on, from 0.0001 to 0.9999."""
    z = [NormalDist().inv_cdf(x) for x in p]
    k = min(max(int(np.searchsorted(critical, stat)) - 1, 0), len(critical) - 2)
    slope = (z[k + 1] - z[k]) / (critical[k + 1] - critical[k])
    return min(max(NormalDist().cdf(z[k] + slope * (stat - critical[k])), 1e-4), 1 - 1e-4)


def phillips_perron(x: np.ndarray) -> tuple[float, float]:
    """(Z-tau, p-value) with a constant."""
    y, z = x[1:], np.column_stack([np.ones(len(x) - 1), x[:-1]])
    beta, error, rss = _ols(z, y)
    n = len(y)
    e = y - z @ beta
    short, long = rss / n, _long_run(e, math.ceil(12 * (n / 100) ** 0.25))
    spread = rss / (n - 2)
    t = (beta[1] - 1) / error[1]
    stat = float(math.sqrt(short / long) * t - 0.5 * (long - short) / math.sqrt(long) * n * error[1] / math.sqrt(spread))
    return stat, mackinnon_p(stat)


def df_gls(x: np.ndarray, trend: str = "c") -> tuple[float, float]:
    """(statistic, p-value) after quasi-differencing; lags by AIC."""
    n = len(x)
    a = 1 - (7.0 if trend == "c" else 13.5) / n
    z = np.ones((n, 1)) if trend == "c" else np.column_stack([np.ones(n), np.arange(1, n + 1)])
    quasi = lambda v: np.concatenate([v[:1], v[1:] - a * v[:-1]])
    beta = _ols(quasi(z), quasi(x))[0]
    u = x - z @ beta
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    scores = []
    for lags in range(most + 1):
        w, y = _lagged(u, lags, most)
        scores.append(len(y) * math.log(max(_ols(w, y)[2], 1e-300) / len(y)) + 2 * (lags + 1))
    w, y = _lagged(u, int(np.argmin(scores)), int(np.argmin(scores)))
    b, error, _ = _ols(w, y)
    stat = float(b[0] / error[0])
    return stat, tail_p(stat, _DFGLS[trend], _DFGLS_P)


def _least_t(y: np.ndarray, x: np.ndarray, base: np.ndarray, extra: list[np.ndarray]) -> tuple[float, int]:
    """(least, its place) of the t statistics of x in the regressions of y on x, base and the columns at one place of ``extra``; -1 where none has one.

    What base explains is taken out of all columns once, so each place costs a few products.
    """
    q = np.linalg.qr(base)[0]
    places, whole_x = extra[0].shape[1], float(x @ x)
    y, x = (np.repeat((v - q @ (q.T @ v))[:, None], places, axis=1) for v in (y, x))
    done: list[np.ndarray] = []
    for whole in extra:
        column = whole - q @ (q.T @ whole)
        for other in done:
            column = column - other * (other * column).sum(axis=0)
        size = np.sqrt((column**2).sum(axis=0))
        done.append(column / np.where(size > 1e-9 * np.sqrt((whole**2).sum(axis=0)), size, np.nan))
    for column in done:
        y, x = (v - column * (column * v).sum(axis=0) for v in (y, x))
    xx = (x**2).sum(axis=0)
    xx = np.where(xx > 1e-18 * whole_x, xx, np.nan)
    beta = (x * y).sum(axis=0) / xx
    rss = ((y - x * beta) ** 2).sum(axis=0)
    t = beta / np.sqrt(rss / (len(y) - base.shape[1] - len(extra) - 1) / xx)
    t = np.where(np.isfinite(t), t, np.inf)
    if not places or np.isinf(t.min()):
        return math.inf, -1
    return float(t.min()), int(np.argmin(t))


def zivot_andrews(x: np.ndarray, trend: str = "c", trim: float = 0.15) -> tuple[float, float, int]:
    """(least statistic over all break places, p-value, break place). The lags are those of least AIC with a trend and no break."""
    n = len(x)
    most = min(int(12 * (n / 100) ** 0.25), n // 4)
    scores = []
    for lags in range(most + 1):
        w, y = _lagged(x, lags, most)
        z = np.column_stack([np.ones(len(y)), np.arange(len(y)), w])
        scores.append(len(y) * math.log(max(_ols(z, y)[2], 1e-300) / len(y)) + 2 * z.shape[1])
    lags = int(np.argmin(scores))
    w, y = _lagged(x, lags, lags)
    time = np.arange(lags + 1, n)
    breaks = np.arange(max(int(n * trim), lags + 2), int(n * (1 - trim)))
    steps = [(time[:, None] > breaks).astype(float)] if trend in ("c", "ct") else []
    slopes = [np.maximum(time[:, None] - breaks, 0).astype(float)] if trend in ("t", "ct") else []
    best, place = _least_t(y, w[:, 0], np.column_stack([np.ones(len(y)), time, w[:, 1:]]), steps + slopes)
    place = -1 if place < 0 else int(breaks[place])
    if place < 0:
        raise ValueError("too few values")
    return best, tail_p(best, _ZA[trend], _ZA_P), place


def quiet(test, *arguments):
    try:
        found = test(*arguments)
        return found if all(math.isfinite(v) for v in found) else None
    except (ValueError, ZeroDivisionError, IndexError, FloatingPointError, np.linalg.LinAlgError):
        return None
