"""Panels that arrive as streams: daily sums with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sums(stream: DataFrame, time: str = "ts", series: str = "series", value: str = "value", lateness: str = "7 days") -> DataFrame:
    """(series, sasdate, value, n) of a stream or a batch, by day.

    Rows later than ``lateness`` behind the newest are dropped, as a stream must; a batch drops none.
    """
    rows = stream.select(F.col(time).cast("timestamp").alias("ts"), F.col(series).alias("series"), F.col(value).cast("double").alias("value"))
    days = rows.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "series").agg(F.sum("value").alias("value"), F.count("value").alias("n"))
    return days.select("series", F.col("window.start").cast("date").alias("sasdate"), "value", "n")
