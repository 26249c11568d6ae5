"""Groups, summaries and correlations of series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_groups(names: DataFrame, groups: DataFrame) -> DataFrame:
    """(series, group); the group of a series that no taxonomy knows is NULL. ``groups`` has one row a known series."""
    return names.select("series").distinct().join(groups, "series", "left")


def filter_by_group(panel: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Rows of the series of a group."""
    return panel.join(groups.where(F.col("group") == group).select("series"), "series", "left_semi")


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    """(column, n) of each value."""
    part = df if with_null else df.where(F.col(column).isNotNull())
    return part.groupBy(column).agg(F.count("*").alias("n"))


def _beside(values: DataFrame, of_series: DataFrame, spread: int) -> DataFrame:
    """Every value with the one row of its series. Both are dealt to ``spread`` parts a series, so that a long series is many tasks."""
    part = F.pmod(F.xxhash64("sasdate", "value"), F.lit(spread))
    copies = of_series.withColumnRenamed("series", "of").withColumn("of_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return values.withColumn("part", part).join(copies, F.col("series").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "part", "of_part")


def _near_ranks(panel: DataFrame, at: tuple[float, ...], margin: float, spread: int) -> DataFrame:
    """(series, n, first, value, c): the distinct values of the bins that hold the ranks looked for, how often each occurs, and the rank from 0 of the first of a value."""
    values = panel.where("value IS NOT NULL").select("series", "sasdate", "value")
    cuts = sorted({min(max(a + d, 0.0), 1.0) for a in at for d in (-margin, margin)})
    splits = values.groupBy("series").agg(F.percentile_approx("value", cuts, 10_000).alias("splits"), F.count("*").alias("n"))
    bin_ = F.size(F.filter("splits", lambda s: s < F.col("value"))).alias("bin")
    sizes = _beside(values, splits, spread).groupBy("series", "n", "splits", bin_).agg(F.count("*").alias("size"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy("series").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    ranks = F.array(*[f(a * (F.col("n") - 1)) for a in at for f in (F.floor, F.ceil)])
    wanted = sizes.select("series", "n", "splits", "bin", "size", start).where(F.exists(ranks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("size"))))
    wanted = wanted.groupBy("series", "n", "splits").agg(F.map_from_entries(F.collect_list(F.struct("bin", "start"))).alias("starts"))
    near = _beside(values, wanted, spread).withColumn("start", F.try_element_at("starts", bin_)).where("start IS NOT NULL")
    counted = near.groupBy("series", "n", "start", "value").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("series", "start").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.select("series", "n", (F.col("start") + before).alias("first"), "value", "c")


def quantiles(panel: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75), margin: float = 0.001, spread: int = 64) -> DataFrame:
    """(series, q): exact quantiles of each series' values, interpolated between neighbours, in the order of ``at``.

    Ranks are selected in two readings. A sketch of each series gives two cuts about every
    quantile, ``margin`` of the values on either side; the values between cuts are
    counted, which tells the bins that hold the ranks exactly, and only their values are
    sorted: some 2 * margin of a long series. How good the sketch is decides the size of
    the bins and nothing else. A series without a value has no row.
    """
    near = _near_ranks(panel, at, margin, spread)
    value_at = lambda r: F.max(F.when((r >= F.col("first")) & (r < F.col("first") + F.col("c")), F.col("value")))
    place = [a * (F.col("n") - 1) for a in at]
    found = near.groupBy("series", "n").agg(*[value_at(f(h)).alias(f"{name}{i}") for i, h in enumerate(place) for name, f in (("low", F.floor), ("high", F.ceil))])
    between = [F.col(f"low{i}") + (h - F.floor(h)) * (F.col(f"high{i}") - F.col(f"low{i}")) for i, h in enumerate(place)]
    return found.select("series", F.array(*between).alias("q"))


def describe(panel: DataFrame) -> DataFrame:
    """Per series: count, nulls, mean, standard deviation (of a sample), minimum, quartiles (interpolated) and maximum."""
    v = F.col("value")
    out = panel.groupBy("series").agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(panel).withColumnRenamed("series", "of")
    out = out.join(q, F.col("series").eqNullSafe(F.col("of")), "left")
    return out.select("series", "count", "nulls", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q25", "q50", "q75"))], "max")


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_GRAM = "a string, b string, " + ", ".join(f"{c} double" for c in _SUMS)


def _matrix(names: pa.Array, cells: pa.ListArray, dates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether there is one), a row a series and a column a date."""
    at = np.repeat(np.arange(len(names)), cells.value_lengths().to_numpy())
    flat = cells.flatten()
    place = np.searchsorted(dates, flat.field("sasdate").to_numpy(zero_copy_only=False).astype("datetime64[D]").astype(np.int64))
    values, some = np.zeros((len(names), len(dates))), np.zeros((len(names), len(dates)))
    values[at, place], some[at, place] = flat.field("value").to_numpy(zero_copy_only=False), 1.0
    return values, some


def _gram(table: pa.Table) -> pa.Table:
    """Sums over the dates that both have, of each pair of a series on the left and one on the right (left and right alike: a <= b)."""
    cells = table.column("cells").combine_chunks()
    dates = np.unique(cells.flatten().field("sasdate").to_numpy(zero_copy_only=False).astype("datetime64[D]").astype(np.int64))
    left, right = (table.column(c).combine_chunks() for c in ("left", "right"))
    names = table.column("series").combine_chunks()
    (x, has_x), (y, has_y) = (_matrix(names.filter(side), cells.filter(side), dates) for side in (left, right))
    a, b = names.filter(left), names.filter(right)
    sums = (has_x @ has_y.T, x @ has_y.T, has_x @ y.T, (x * x) @ has_y.T, has_x @ (y * y).T, x @ y.T)
    i, j = np.nonzero(sums[0] > 0)
    one, two = a.take(pa.array(i)), b.take(pa.array(j))
    out = pa.table({"a": one, "b": two} | {c: s[i, j] for c, s in zip(_SUMS, sums, strict=True)})
    within = table.column("g")[0].as_py() == table.column("h")[0].as_py()
    return out.filter(pc.less_equal(one, two)) if within else out


def correlations(panel: DataFrame, series_block: int = 1000, date_block: int = 1000) -> DataFrame:
    """(a, b, n, corr) of every pair a <= b of series, over the dates that both have. A series has one row a date.

    Series are dealt to groups and dates to blocks, so many that a group has about
    ``series_block`` series and a block ``date_block`` dates. A task takes two groups over
    one block as matrices of values and of which are there; their products are the sums
    of all pairs, and add up over the blocks. Rows are shuffled as arrays, one a series,
    block and pair of groups. Values are taken from their series' mean first, as sums of
    squares of what is far from zero lose digits.
    """
    have = panel.where("value IS NOT NULL AND series IS NOT NULL AND sasdate IS NOT NULL").select("series", "sasdate", "value")
    size = have.agg(F.approx_count_distinct("series").alias("s"), F.approx_count_distinct("sasdate").alias("d")).first()
    groups, blocks = -(-max(size.s, 1) // series_block), -(-max(size.d, 1) // date_block)
    block = F.pmod(F.xxhash64("sasdate"), F.lit(blocks)).alias("block")
    lists = have.groupBy("series", block).agg(F.collect_list(F.struct("sasdate", "value")).alias("cells"), F.sum("value").alias("total"), F.count("*").alias("n"))
    by = Window.partitionBy("series")
    mean = F.sum("total").over(by) / F.sum("n").over(by)
    lists = lists.withColumn("mean", mean).select("series", "block", F.transform("cells", lambda c: F.struct(c["sasdate"].alias("sasdate"), (c["value"] - F.col("mean")).alias("value"))).alias("cells"), F.pmod(F.xxhash64("series"), F.lit(groups)).alias("own"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("other")
    dealt = lists.select("series", "block", "cells", "own", other)
    g, h = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("block", g.alias("g"), h.alias("h"), "series", "cells", (F.col("own") == g).alias("left"), (F.col("own") == h).alias("right"))
    sums = dealt.groupBy("block", "g", "h").applyInArrow(_gram, _GRAM)
    pairs = sums.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(*[F.sum(c).alias(c) for c in _SUMS])
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    some = lambda s, ss: F.when(spread(s, ss) > 1e-12 * F.col("n") * F.col(ss), F.sqrt(spread(s, ss)))
    corr = F.try_divide(top, some("sx", "sxx") * some("sy", "syy"))
    within = F.when(corr > 1, 1.0).when(corr < -1, -1.0).otherwise(corr)
    return pairs.select("a", "b", F.col("n").cast("long").alias("n"), F.when(F.col("n") >= 2, within).alias("corr"))
