"""Seasonal adjustment of every series: STL, and the contract of an external program.

STL is the procedure of Cleveland, Cleveland, McRae and Terpenning (1990): an inner loop
of seasonal and trend smoothing by LOESS, an outer loop of robustness weights. Series
are dealt to tasks by an exchange on the series.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "series string, sasdate date, value double, seasonal double, adjusted double"


def loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray | None = None, degree: int = 1) -> np.ndarray:
    """Local regression of y at 0..n-1, evaluated at the whole places ``at``. Each costs its span, not the length of y. Where all weights are zero, the span counts alike."""
    n = len(y)
    rho = np.ones(n) if weights is None else weights
    q = min(span, n)
    # The nearest q places, of which the farthest has no weight.
    near = np.clip(at.astype(int) - (q - 1) // 2, 0, n - q)[:, None] + np.arange(q)
    x = near - at[:, None]
    distance = np.abs(x)
    reach = distance.max(axis=1) + (max(span - n, 0) // 2)
    u = distance / np.maximum(reach, 1e-12)[:, None]
    w = np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0) * rho[near]
    w[w.sum(axis=1) <= 1e-12] = 1.0
    w /= w.sum(axis=1, keepdims=True)
    values = y[near]
    mean_y = (w * values).sum(axis=1)
    if degree == 0:
        return mean_y
    mean_x = (w * x).sum(axis=1)
    x = x - mean_x[:, None]
    spread = (w * x**2).sum(axis=1)
    slope = (w * x * values).sum(axis=1)
    steep = spread > 1e-9 * max(n - 1, 1) ** 2
    return mean_y - np.where(steep, slope / np.where(steep, spread, 1.0), 0.0) * mean_x


def _moving_average(y: np.ndarray, n: int) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(y)]
    return (total[n:] - total[:-n]) / n


def _odd(n: float) -> int:
    n = int(np.ceil(n))
    return n + 1 - n % 2


def stl(y: np.ndarray, period: int = 12, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) of y. It needs two periods."""
    n = len(y)
    if n < 2 * period:
        raise ValueError("fewer than two periods")
    trend_span = _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_span = _odd(period + 1)
    trend, season, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for outer in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            rest = y - trend
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                own = rest[k::period]
                places = np.arange(-1, len(own) + 1, dtype=float)
                cycle[k :: period][: len(places)] = loess(own, seasonal, places, rho[k::period])
            low = _moving_average(_moving_average(_moving_average(cycle, period), period), 3)
            season = cycle[period : n + period] - loess(low, low_span, np.arange(n, dtype=float))
            trend = loess(y - season, trend_span, np.arange(n, dtype=float), rho)
        if not robust or outer == 14:
            break
        size = np.abs(y - season - trend)
        limit = 6 * np.median(size)
        rho = np.ones(n) if limit <= 1e-9 * np.ptp(y) else np.clip(1 - (size / limit) ** 2, 0, None) ** 2
    return season, trend


def deseasonalise(panel: DataFrame, period: int = 12, robust: bool = True) -> DataFrame:
    """Rows with a value, with the seasonal part and the value without it. A series of fewer than two periods is left as it is."""

    def adjust(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.dropna(subset=["value"]).sort_values("sasdate")[["series", "sasdate", "value"]].copy()
        y = out["value"].to_numpy(dtype=float)
        part = stl(y, period, robust=robust)[0] if len(y) >= 2 * period else np.zeros(len(y))
        out["seasonal"], out["adjusted"] = part, y - part
        return out

    return panel.groupBy("series").applyInPandas(adjust, RESULT)


def external_adjustment(panel: DataFrame, program: str = "x13as", timeout: float = 120) -> DataFrame:
    """(series, sasdate, value, seasonal, adjusted) by a program of the X-13ARIMA-SEATS kind, run once for each monthly series on the executors.

    Without the program this is an EnvironmentError. It is called with the name of a
    specification (x11 of the series, table d11 saved) in a folder of its own, and its
    table of adjusted values is read: two heading lines, then YYYYMM and the value. A
    series that it gives no table for, such as one with a gap, has NULLs.
    """
    if shutil.which(program) is None:
        raise EnvironmentError(f"{program} is not on the path")

    def adjust(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.dropna(subset=["value"]).sort_values("sasdate")[["series", "sasdate", "value"]].copy()
        out["adjusted"] = np.nan
        if len(out):
            with tempfile.TemporaryDirectory() as folder:
                first = out["sasdate"].iloc[0]
                data = " ".join(f"{v:.10g}" for v in out["value"])
                spec = f"series{{ start={first.year}.{first.month} period=12 data=({data}) }}\nx11{{ save=(d11) }}\n"
                Path(folder, "s.spc").write_text(spec)
                subprocess.run([shutil.which(program) or program, "s"], cwd=folder, timeout=timeout, capture_output=True, check=False)
                table = Path(folder, "s.d11")
                rows = [line.split() for line in table.read_text().splitlines()[2:]] if table.exists() else []
                found = {int(r[0]): float(r[1]) for r in rows if len(r) >= 2}
                out["adjusted"] = [found.get(d.year * 100 + d.month, np.nan) for d in out["sasdate"]]
        out["seasonal"] = out["value"] - out["adjusted"]
        return out[["series", "sasdate", "value", "seasonal", "adjusted"]]

    out = panel.groupBy("series").applyInPandas(adjust, "series string, sasdate date, value double, seasonal double, adjusted double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("seasonal", "adjusted")})
