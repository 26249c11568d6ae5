"""A balanced, standardised panel as factor models take it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.missing import valid_places
from panelwright.operators.transforms import standard_deviation, standardise, transform_by_codes
from panelwright.schema import by_series

BALANCES = ("none", "initial", "all")
#: Rows that each code loses at the start. Fixed values.
LEADS_LOST = {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 2, 7: 2}


def balance_panel(panel: DataFrame, balance: str = "initial") -> DataFrame:
    """Drop series without values; then nothing (none), the rows before all series have begun (initial), or also rows with any gap (all)."""
    if balance not in BALANCES:
        raise ValueError(f"balance must be one of {BALANCES}")
    first = F.min(F.when(F.col("value").isNotNull(), F.col("sasdate"))).over(by_series())
    full = panel.withColumn("first", first).where("first IS NOT NULL")
    if balance == "none":
        return full.drop("first")
    begun = full.agg(F.max("first").alias("begin"))
    full = full.join(F.broadcast(begun)).where("sasdate >= begin").drop("first", "begin")  # one row
    if balance == "initial":
        return full
    whole = full.groupBy("sasdate").agg(F.bool_and(F.col("value").isNotNull()).alias("whole")).where("whole").select("sasdate")
    return full.join(whole, "sasdate", "left_semi")


def prepare_for_factors(panel: DataFrame, codes: DataFrame, balance: str = "initial", standardised: bool = True, ddof: int = 0) -> DataFrame:
    """Transform by codes, balance, then standardise what is left."""
    out = balance_panel(transform_by_codes(panel, codes), balance)
    return standardise(out, ddof) if standardised else out


def moments(panel: DataFrame, ddof: int = 0) -> DataFrame:
    """(series, mean, std) of a balanced panel before it is standardised; std is NULL for a series without spread."""
    return panel.groupBy("series").agg(F.avg("value").alias("mean"), F.nullif(standard_deviation(F.col("value"), ddof), F.lit(0.0)).alias("std"))


def prepare_with_info(panel: DataFrame, codes: DataFrame, balance: str = "initial", standardised: bool = True, ddof: int = 0) -> tuple[DataFrame, dict]:
    """As prepare_for_factors, with what was done.

    The second part has tables, which grow with the panel and are computed when they are
    read: all_missing (series dropped as they have no value), first_valid (place of the
    first value of each other series, from 0), global_first (one row: the latest of
    them), rows_dropped (dates), moments (mean and std of each series; None if not
    standardised); and the values standardised and leads_lost (rows that each code loses).
    """
    transformed = transform_by_codes(panel, codes)
    balanced = balance_panel(transformed, balance)
    places = valid_places(transformed)
    first = places.where("first_valid IS NOT NULL").select("series", (F.col("first_valid") - 1).alias("place"))
    info = {
        "all_missing": places.where("first_valid IS NULL").select("series"),
        "first_valid": first,
        "global_first": first.agg(F.coalesce(F.max("place"), F.lit(0).cast("long")).alias("place")),
        "rows_dropped": rows_dropped(transformed, balanced),
        "moments": moments(balanced, ddof) if standardised else None,
        "standardised": standardised,
        "leads_lost": dict(LEADS_LOST),
    }
    return (standardise(balanced, ddof) if standardised else balanced), info


def rows_dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Dates of ``before`` that ``after`` lacks."""
    return before.select("sasdate").distinct().join(after.select("sasdate").distinct(), "sasdate", "left_anti")


def first_full_place(panel: DataFrame) -> DataFrame:
    """One row: the latest of the first valid places of the series that have values."""
    return valid_places(panel).agg(F.max("first_valid").alias("place"))
