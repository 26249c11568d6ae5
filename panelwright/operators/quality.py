"""Checks of files, maps and targets. A check reports; it does not repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelwright.functions.names import clean_name
from panelwright.operators.calendar import duplicate_dates, grid_gaps


def bad_numbers(df: DataFrame, column: str) -> Column:
    """Aggregate: entries that are there but are no numbers."""
    return F.count_if(F.col(f"`{column}`").isNotNull() & F.expr(f"try_cast(`{column}` AS DOUBLE)").isNull())


def missing_names(names: DataFrame, codes: DataFrame) -> DataFrame:
    """Series of the panel that the map lacks."""
    return names.select("series").distinct().join(codes, "series", "left_anti")


def extra_names(names: DataFrame, codes: DataFrame) -> DataFrame:
    """Series of the map that the panel lacks."""
    return codes.select("series").distinct().join(names, "series", "left_anti")


def valid_codes(names: DataFrame, codes: DataFrame, require_all: bool = True) -> DataFrame:
    """The map's entries for the panel's series with codes from 1 to 7; a series left without is a KeyError if all are required."""
    kept = codes.where("tcode BETWEEN 1 AND 7").join(names.select("series").distinct(), "series", "left_semi")
    if require_all:
        gone = [r.series for r in missing_names(names, kept).orderBy("series").limit(20).collect()]
        if gone:
            raise KeyError(f"no valid code for {', '.join(map(str, gone))}")
    return kept


def code_diagnostics(names: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: missing_in_tcodes, the panel's series without a code from 1 to 7, and extra_in_tcodes, the map's series that the panel lacks."""
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list("series")).alias(name))
    missing = listed(missing_names(names, codes.where("tcode BETWEEN 1 AND 7")), "missing_in_tcodes")
    return missing.join(listed(extra_names(names, codes), "extra_in_tcodes"))


def file_order_is_sorted(rows: DataFrame, place: str, date: str, strictly: bool = False) -> DataFrame:
    """One row (sorted): whether dates never fall in the order of ``place``, or always rise. Compares neighbours by a join, not in one window."""
    a = rows.select(F.col(place).alias("p"), F.col(date).alias("d"))
    b = rows.select((F.col(place) - 1).alias("p"), F.col(date).alias("next"))
    return a.join(b, "p").agg(F.coalesce(F.bool_and(F.col("d") < F.col("next") if strictly else F.col("d") <= F.col("next")), F.lit(True)).alias("sorted"))


def structure_checks(panel: DataFrame, clean_names: DataFrame | None = None) -> DataFrame:
    """(check, passed, detail) of a panel: rows, dates, repeated dates, gaps of the grid, and repeated clean names (series, clean)."""
    rows = panel.agg(F.count("*").alias("n")).select(F.lit("not empty").alias("check"), (F.col("n") > 0).alias("passed"), F.col("n").cast("string").alias("detail"))

    def empty(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail"))

    out = rows.unionByName(empty("dates parse", panel.where("sasdate IS NULL")))
    out = out.unionByName(empty("dates are unique", duplicate_dates(panel))).unionByName(empty("no gap in the grid", grid_gaps(panel)))
    if clean_names is not None:
        out = out.unionByName(empty("clean names are unique", clean_names.groupBy("clean").agg(F.count("*").alias("n")).where("n > 1")))
    return out


def file_checks(rows: DataFrame, date: str = "sasdate", date_format: str = "MM/dd/yyyy") -> DataFrame:
    """(check, passed, detail) of a wide panel file as it was read, all columns text, in the file's order.

    Beyond structure_checks: dates never fall from a row to the next, clean names of
    columns are unique, and every column holds numbers or nothing.
    """
    if date not in rows.columns:
        return rows.sparkSession.createDataFrame([("columns", False, date)], "check string, passed boolean, detail string")
    others = [c for c in rows.columns if c != date]
    spark = rows.sparkSession
    day = F.try_to_date(F.col(f"`{date}`"), date_format)
    sums = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(day.isNull()).alias("dates parse"),
        (F.count(day) - F.count_distinct(day)).alias("dates are unique"),
        F.coalesce(F.floor(F.months_between(F.trunc(F.max(day), "MM"), F.min(day))).cast("long") + 1 - F.count_distinct(F.when(F.trunc(day, "MM") == day, day)), F.lit(0).cast("long")).alias("no gap in the grid"),
        *[bad_numbers(rows, c).alias(f"bad {i}") for i, c in enumerate(others)],
    )
    numbers = F.array_compact(F.array(*[F.when(F.col(f"bad {i}") > 0, F.lit(c)) for i, c in enumerate(others)]).cast("array<string>"))
    names = [clean_name(c) for c in others]
    repeated = sorted({c for c in names if names.count(c) > 1})
    # The last date of each part of the file is held against the first of the next; parts are read in order.
    part = rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), day.alias("day")).where("day IS NOT NULL")
    step = Window.partitionBy("part").orderBy("place")
    falls = part.withColumn("fall", F.coalesce(F.lag("day").over(step) > F.col("day"), F.lit(False)))
    parts = falls.groupBy("part").agg(F.count_if("fall").alias("falls"), F.min_by("day", "place").alias("first"), F.max_by("day", "place").alias("last"))
    ends = parts.agg(F.sum("falls").alias("falls"), F.array_sort(F.collect_list(F.struct("part", "first", "last"))).alias("x"))  # one entry a part
    crossed = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("x") - 1, F.lit(1))), lambda k: F.coalesce(F.get("x", k - 1)["last"] > F.get("x", k)["first"], F.lit(False))))
    order = ends.select((F.coalesce("falls", F.lit(0)) + crossed).cast("long").alias("dates are in order"))
    found = sums.join(order)
    count = lambda name: F.struct(F.lit(name).alias("check"), (F.col(f"`{name}`") == 0).alias("passed"), F.col(f"`{name}`").cast("string").alias("detail"))
    checks = [
        F.struct(F.lit("not empty").alias("check"), ((F.col("rows") > 0) & F.lit(bool(others))).alias("passed"), F.col("rows").cast("string").alias("detail")),
        *[count(c) for c in ("dates parse", "dates are unique", "dates are in order", "no gap in the grid")],
        F.struct(F.lit("clean names are unique").alias("check"), F.lit(not repeated).alias("passed"), F.lit(", ".join(repeated)).alias("detail")),
        F.struct(F.lit("columns are numbers").alias("check"), (F.size(numbers) == 0).alias("passed"), F.array_join(numbers, ", ").alias("detail")),
    ]
    return found.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def target_checks(target: DataFrame, date: str, value: str | None = None, strict_quarter_end: bool = False, place: str | None = None) -> DataFrame:
    """(check, passed, detail) of a target table as it was read: columns, dates, numbers, repetitions, and months that end quarters.

    Without ``value`` the table must have one column beside the date. With ``place``, the
    rows' order, dates must also rise from each row to the next.
    """
    others = [c for c in target.columns if c not in (date, place)]
    if value is None:
        if len(others) != 1:
            return target.sparkSession.createDataFrame([("one value column", False, ", ".join(others))], "check string, passed boolean, detail string")
        value = others[0]
    missing = [c for c in (date, value) if c not in target.columns]
    if missing:
        return target.sparkSession.createDataFrame([("columns", False, ", ".join(missing))], "check string, passed boolean, detail string")
    day = F.expr(f"try_cast(`{date}` AS DATE)")
    sums = target.agg(
        F.count("*").alias("rows"),
        F.count_if(day.isNull()).alias("dates parse"),
        (F.count(day) - F.count_distinct(day)).alias("dates are unique"),
        bad_numbers(target, value).alias("values are numbers"),
        F.count_if(F.month(day) % 3 != 0).alias("months end quarters"),
    )
    names = ["dates parse", "dates are unique", "values are numbers"] + ["months end quarters"] * strict_quarter_end
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x"))
    out = long.select("x.check", (F.col("x.n") == 0).alias("passed"), F.col("x.n").cast("string").alias("detail"))
    if place is None:
        return out
    order = file_order_is_sorted(target.withColumn("day", day), place, "day", strictly=True)
    return out.unionByName(order.select(F.lit("dates rise").alias("check"), F.col("sorted").alias("passed"), F.lit("").alias("detail")))


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def assert_unique_columns(df: DataFrame) -> None:
    """A name that occurs twice, case included, is an error."""
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise ValueError(f"repeated columns: {', '.join(repeated)}")


def assert_dates(panel: DataFrame) -> None:
    """The panel's dates must be dates."""
    if panel.schema["sasdate"].dataType.simpleString() != "date":
        raise TypeError("sasdate is no date")


def assert_monthly(panel: DataFrame) -> None:
    """Dates must be dates, and all months between the first and the last be there."""
    assert_dates(panel)
    gap = grid_gaps(panel).limit(1).collect()
    if gap:
        raise ValueError(f"no row for {gap[0].sasdate}")
