"""Long series in chunks of time, so that one series is many tasks.

A chunk is a span of days; a series with a row a day at most has no more rows in it than
days. What a row needs of rows before its chunk comes from one row a chunk: the last rows
of the chunk, and its last value. These are few, and are carried along by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Days that a chunk spans: ninety years.
CHUNK_DAYS = 1 << 15


def chunk_of(days: int = CHUNK_DAYS) -> Column:
    """The number of the chunk that a row's date lies in; rows without a date come first."""
    since = F.datediff("sasdate", F.lit("1970-01-01").cast("date"))
    return F.coalesce(F.floor(since / days), F.lit(-(1 << 40)))


def in_chunk_order() -> WindowSpec:
    """The window of every lag and fill within a chunk."""
    return Window.partitionBy("series", "chunk").orderBy("sasdate")


def _tail(cells: Column, rows: int) -> Column:
    """The last rows of a chunk with the last value of the chunk up to each."""
    split = F.greatest(F.size(cells) - rows, F.lit(0))
    before = F.try_element_at(F.filter(F.slice(cells, F.lit(1), split), lambda c: c["value"].isNotNull()), F.lit(-1))["value"]
    step = lambda a, c: F.concat(a, F.array(F.struct(c["sasdate"].alias("sasdate"), c["value"].alias("value"), F.coalesce(c["value"], F.try_element_at(a, F.lit(-1))["seed"], before).alias("seed"))))
    return F.aggregate(F.slice(cells, split + 1, F.size(cells)), F.array().cast("array<struct<sasdate:date,value:double,seed:double>>"), step)


def in_chunks(panel: DataFrame, rows: int, days: int = CHUNK_DAYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(series, chunk, sasdate, value, seed, own) and the columns ``carry``, which are one value a series.

    Each chunk has its own rows, and before them the last ``rows`` rows of the series
    before the chunk (own is false), whose seed is the last value of the series up to
    them. So any lag of up to as many rows, and the carrying forward of values, is a
    window over the chunk. The rows are dealt once, by series and chunk.
    """
    cell = F.struct("sasdate", "value")
    chunks = panel.groupBy("series", chunk_of(days).alias("chunk")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), *[F.min(c).alias(c) for c in carry])
    order = Window.partitionBy("series").orderBy("chunk")
    ends = chunks.select("series", "chunk", _tail(F.col("cells"), rows).alias("tail")).withColumn("last", F.try_element_at("tail", F.lit(-1))["seed"])
    ends = ends.withColumn("before", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    filled = F.transform("tail", lambda c: F.struct(c["sasdate"].alias("sasdate"), c["value"].alias("value"), F.coalesce(c["seed"], F.col("before")).alias("seed"), F.lit(False).alias("own")))
    ends = ends.select("series", "chunk", filled.alias("tail"))
    recent = F.flatten(F.collect_list("tail").over(order.rowsBetween(-rows, -1)))
    halo = ends.withColumn("recent", recent).select("series", "chunk", F.slice("recent", F.greatest(F.size("recent") - rows, F.lit(0)) + 1, rows).alias("halo"))
    own = F.transform("cells", lambda c: F.struct(c["sasdate"].alias("sasdate"), c["value"].alias("value"), F.lit(None).cast("double").alias("seed"), F.lit(True).alias("own")))
    return chunks.join(halo, ["series", "chunk"]).select("series", "chunk", *carry, F.inline(F.concat("halo", own)))
