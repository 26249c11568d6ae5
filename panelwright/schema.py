"""The canonical long panel and its invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

PANEL = StructType([StructField("series", StringType()), StructField("sasdate", DateType()), StructField("value", DoubleType())])


def by_series() -> WindowSpec:
    """The window of every statistic of a series. One exchange by series serves it and in_order()."""
    return Window.partitionBy("series")


def in_order() -> WindowSpec:
    """The window of every lag and fill."""
    return by_series().orderBy("sasdate")


def clean(value: Column | str) -> Column:
    """A double without NaN and infinities; what is no number is NULL."""
    number = F.expr(f"try_cast(`{value}` AS DOUBLE)") if isinstance(value, str) else value
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def as_panel(df: DataFrame, series: str = "series", date: str = "sasdate", value: str = "value") -> DataFrame:
    """Rename and cast three columns into a canonical panel; the other columns go."""
    missing = [c for c in (series, date, value) if c not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}")
    return df.select(F.col(f"`{series}`").cast("string").alias("series"), F.col(f"`{date}`").cast("date").alias("sasdate"), clean(value).alias("value"))


def to_wide(panel: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Rows are dates, columns are series; a boundary format."""
    return panel.groupBy("sasdate").pivot("series", series).agg(F.first("value")).orderBy("sasdate")


def to_long(wide: DataFrame, date: str = "sasdate") -> DataFrame:
    """Every cell of a wide panel, those of NULL too. Values are coerced to numbers."""
    others = [c for c in wide.columns if c != date]
    text = wide.select(F.col(f"`{date}`").alias("sasdate"), *[F.col(f"`{c}`").cast("string").alias(c) for c in others])
    return as_panel(text.unpivot("sasdate", [f"`{c}`" for c in others], "series", "value"))
