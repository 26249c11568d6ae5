"""Stationarity transformations: window expressions over one partitioning by series.

All lags are by row, not by calendar distance: rows of NULL stay in place before a lag.
Panels of a monthly grid have twelve rows a year, and one partitioning by series serves
all their windows. For series of many rows, such as days, ``chunk_days`` cuts them into
chunks of time with the rows before (see chunks), so that one series is many tasks.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.operators.chunks import in_chunk_order, in_chunks
from panelwright.schema import by_series, clean, in_order

MODES = ("robust", "legacy")


def _difference(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x, 1).over(w)


def _second_difference(x: Column, w: WindowSpec) -> Column:
    one, two = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
    return (x - one) - (one - two)


def _transformed(w: WindowSpec) -> dict[int, Column]:
    """The value by each code, over the columns value and growth.

    1 level, 2 difference, 3 second difference, 4 log, 5 difference of logs, 6 second
    difference of logs, 7 difference of the growth rate. Logs of what is not positive
    are NULL.
    """
    v = F.col("value")
    log = F.ln(F.when(v > 0, v))
    return {1: v, 2: _difference(v, w), 3: _second_difference(v, w), 4: log, 5: _difference(log, w), 6: _second_difference(log, w), 7: _difference(F.col("growth"), w)}


def _apply(panel: DataFrame, code: int | None, mode: str, chunk_days: int | None) -> DataFrame:
    """Transform by one code, or by the column tcode. For code 7, the robust mode carries the last value over gaps first."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w, known = in_order(), F.col("value")
    if chunk_days:
        panel = in_chunks(panel, 2, chunk_days, ("tcode",) if code is None else ())
        w, known = in_chunk_order(), F.coalesce("value", "seed")
    by_code = _transformed(w)
    y = by_code[code or 1] if code else F.when(F.col("tcode") == 1, by_code[1])
    for k in range(2, 8) if not code else ():
        y = y.when(F.col("tcode") == k, by_code[k])
    filled = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if mode == "robust" else F.col("value")
    growth = F.try_divide("filled", F.lag("filled", 1).over(w)) - 1
    out = panel.withColumn("filled", filled).withColumn("growth", growth).withColumn("value", clean(y))
    return (out.where("own") if chunk_days else out).select("series", "sasdate", "value")


def apply_codes(panel: DataFrame, codes: DataFrame, mode: str = "robust", chunk_days: int | None = None) -> DataFrame:
    """Transform every series by its code in ``codes`` (series, tcode).

    A series without a code is a KeyError, a code outside of 1 to 7 a ValueError.
    """
    names = panel.select("series").distinct()
    without = [r.series for r in names.join(codes, "series", "left_anti").orderBy("series").limit(20).collect()]
    if without:
        raise KeyError(f"no transformation code for {', '.join(map(str, without))}")
    odd = codes.join(names, "series", "left_semi").where("tcode IS NULL OR tcode NOT BETWEEN 1 AND 7").limit(5).collect()
    if odd:
        raise ValueError(f"unknown transformation codes: {[tuple(r) for r in odd]}")
    return transform_by_codes(panel, codes, mode, chunk_days)


def transform_by_codes(panel: DataFrame, codes: DataFrame, mode: str = "robust", chunk_days: int | None = None) -> DataFrame:
    """apply_codes without its checks: a lazy plan of one exchange. ``codes`` is one row a series and small beside the panel."""
    return _apply(panel.join(codes.select("series", "tcode"), "series"), None, mode, chunk_days)


def apply_code(panel: DataFrame, code: int, mode: str = "robust", chunk_days: int | None = None) -> DataFrame:
    """Transform all series by one code."""
    if code not in range(1, 8):
        raise ValueError("code must be from 1 to 7")
    return _apply(panel, code, mode, chunk_days)


def extra_transform(panel: DataFrame, kinds: dict[str, str] | str, drop_first: bool = False, chunk_days: int | None = None) -> DataFrame:
    """Difference (``diff``) or difference to 12 rows before (``yoy``) of the named series, or of all.

    A name that the panel does not have is a warning. With drop_first the panel's first date
    goes if a named series is missing there afterwards.
    """
    lags = {"diff": 1, "yoy": 12}
    chosen = {"": kinds} if isinstance(kinds, str) else kinds
    chosen = {name: kind.strip().lower() for name, kind in chosen.items()}
    unknown = {k for k in chosen.values() if k not in lags}
    if unknown:
        raise ValueError(f"unknown transformation {', '.join(sorted(unknown))}")
    v = F.col("value")
    y = v
    rows, w = (in_chunks(panel, max(lags.values()), chunk_days), in_chunk_order()) if chunk_days else (panel, in_order())
    for name, kind in chosen.items():
        change = v - F.lag(v, lags[kind]).over(w)
        y = change if isinstance(kinds, str) else F.when(F.col("series") == name, change).otherwise(y)
    out = rows.withColumn("value", y)
    out = (out.where("own") if chunk_days else out).select("series", "sasdate", "value")
    if isinstance(kinds, dict):
        known = {r.series for r in panel.where(F.col("series").isin(list(kinds))).select("series").distinct().collect()}
        for name in sorted(set(kinds) - known):
            warnings.warn(f"no series {name} in the panel", stacklevel=2)
    if drop_first:
        first = out.groupBy("sasdate").agg(F.count_if(F.col("value").isNull() & (F.lit(isinstance(kinds, str)) | F.col("series").isin(list(chosen)))).alias("n")).orderBy("sasdate").first()
        if first is not None and first.n:
            out = out.where(F.col("sasdate") > first.sasdate)
    return out


def standard_deviation(value: Column, ddof: int, over=None) -> Column:
    """Standard deviation with ``ddof``; NULL where there are not more values than that."""
    n, variance = F.count(value), F.var_pop(value)
    if over is not None:
        n, variance = n.over(over), variance.over(over)
    return F.sqrt(F.when(n > ddof, variance * n / (n - ddof)))


def standardise(panel: DataFrame, ddof: int = 0) -> DataFrame:
    """z-scores of every series; NULL for a series without spread."""
    spread = standard_deviation(F.col("value"), ddof, by_series())
    return panel.select("series", "sasdate", ((F.col("value") - F.avg("value").over(by_series())) / F.nullif(spread, F.lit(0.0))).alias("value"))
