"""Monthly calendar: a contiguous month-start grid for every series."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.schema import in_order


def month_bounds(panel: DataFrame) -> DataFrame:
    """One row (start, end): a first day inside a month rolls forward to the next month's start."""
    low, high = F.min("sasdate").alias("low"), F.max("sasdate").alias("high")
    start = F.when(F.trunc("low", "MM") == F.col("low"), F.col("low")).otherwise(F.add_months(F.trunc("low", "MM"), 1))
    return panel.agg(low, high).select(start.alias("start"), F.trunc("high", "MM").alias("end"))


def calendar(panel: DataFrame) -> DataFrame:
    """All month starts from the first to the last date of the panel."""
    return month_bounds(panel).where("start <= end").select(F.explode(F.expr("sequence(start, end, interval 1 month)")).alias("sasdate"))


def densify(panel: DataFrame, start, end) -> DataFrame:
    """Every month from start to end for every series; dates outside or off the grid go.

    The panel is read once and dealt once, by series: the first row of a series brings the
    empty months along, which are merged with the series' own. All windows of a series use
    that exchange again. Two rows of one month are an error.
    """
    cell = lambda day, value, own: F.struct(day.alias("sasdate"), value.cast("double").alias("value"), F.lit(own).alias("own"))
    none = F.array().cast("array<struct<sasdate:date,value:double,own:int>>")
    months = F.transform(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 month")), lambda m: cell(m, F.lit(None), 0))
    on_grid = (F.trunc("sasdate", "MM") == F.col("sasdate")) & F.col("sasdate").between(F.lit(start), F.lit(end))
    rows = panel.select("series", "sasdate", "value").repartition("series").withColumn("place", F.row_number().over(in_order()))
    own = F.when(on_grid, F.array(cell(F.col("sasdate"), F.col("value"), 1))).otherwise(none)
    rows = rows.select("series", F.inline(F.concat(F.when(F.col("place") == 1, months).otherwise(none), own)))
    cells = rows.groupBy("series", "sasdate").agg(F.max("value").alias("value"), F.sum("own").alias("own"))
    twice = F.concat(F.lit("more than one row of "), F.col("series"), F.lit(" on "), F.col("sasdate").cast("string"))
    return cells.select("series", "sasdate", F.when(F.col("own") > 1, F.raise_error(twice).cast("double")).otherwise(F.col("value")).alias("value"))


def monthly_grid(panel: DataFrame) -> DataFrame:
    """Align all series to the panel's calendar: missing months become NULL, dates off the grid go.

    A panel without any date, or with two rows of a series on one date, is an error.
    """
    start, end = month_bounds(panel).first()
    if start is None:
        raise ValueError("no date in the panel")
    repeated = duplicate_dates(panel).limit(1).collect()
    if repeated:
        raise ValueError(f"more than one row of {repeated[0].series} on {repeated[0].sasdate}")
    if start > end:
        return panel.limit(0)
    return densify(panel, start, end)


def duplicate_dates(panel: DataFrame) -> DataFrame:
    """(series, sasdate, n) of dates that a series has more than once."""
    return panel.where("sasdate IS NOT NULL").groupBy("series", "sasdate").agg(F.count("*").alias("n")).where("n > 1")


def grid_gaps(panel: DataFrame) -> DataFrame:
    """Months of the calendar that no row of the panel has."""
    return calendar(panel).join(panel.select("sasdate").distinct(), "sasdate", "left_anti")


def since(panel: DataFrame, anchor) -> DataFrame:
    """Rows on the anchor date or later."""
    return panel.where(F.col("sasdate") >= F.lit(anchor).cast("date"))


def _whole(label, last: bool):
    """A label of a year (1965) or of a month (1965-03) as its first day, or its last."""
    if not isinstance(label, str) or not re.fullmatch(r"\d{4}(-\d{2})?", label):
        return label
    year, month = int(label[:4]), int(label[5:] or (12 if last else 1))
    return date(year, month, monthrange(year, month)[1] if last else 1)


def between(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from start to end, both included; either may be open. A year or a month as text is all of it."""
    start, end = _whole(start, False), _whole(end, True)
    if start is not None:
        panel = panel.where(F.col("sasdate") >= F.lit(start).cast("date"))
    return panel if end is None else panel.where(F.col("sasdate") <= F.lit(end).cast("date"))


def nearest_date(panel: DataFrame, date) -> DataFrame:
    """One row: the panel's date next to ``date``, the earlier of two as near."""
    gap = F.abs(F.datediff("sasdate", F.lit(date).cast("date")))
    return panel.select("sasdate").distinct().agg(F.min_by("sasdate", F.struct(gap, "sasdate")).alias("sasdate"))


def nearest_dates(asked: DataFrame, panel: DataFrame, date: str = "asked", days: int = 4096) -> DataFrame:
    """(asked, sasdate): for each distinct date of a table the panel's date next to it, the earlier of two as near; NULL if the panel has none.

    Both tables' dates are put in one order within spans of days, and the last and the
    next date of the panel carried to what is asked. What lies outside of a span comes
    from one row a span, its first and last date of the panel.
    """
    none = F.lit(None).cast("date")
    have = panel.where("sasdate IS NOT NULL").select("sasdate").distinct()
    rows = have.select(F.col("sasdate").alias("day"), F.col("sasdate").alias("own"), none.alias("asked"))
    rows = rows.unionByName(asked.select(F.col(date).cast("date").alias("day")).where("day IS NOT NULL").distinct().select("day", none.alias("own"), F.col("day").alias("asked")))
    rows = rows.withColumn("span", F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / days))
    spans = rows.groupBy("span").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    every = Window.orderBy("span")  # one row a span, not one a date
    before = F.last("last", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(every.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.select("span", before.alias("before"), after.alias("after"))
    order = Window.partitionBy("span").orderBy("day", F.col("own").asc_nulls_last())
    inside = rows.withColumn("last", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("next", F.first("own", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("asked IS NOT NULL")
    found = inside.join(spans, "span").select("asked", F.coalesce("last", "before").alias("last"), F.coalesce("next", "after").alias("next"))
    earlier = F.col("next").isNull() | (F.datediff("asked", "last") <= F.datediff("next", "asked"))
    return found.select("asked", F.when(F.col("last").isNotNull() & earlier, F.col("last")).otherwise(F.col("next")).alias("sasdate"))
