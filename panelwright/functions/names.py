"""Names and texts of panels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_name(name: str) -> str:
    """NFKC form, trimmed, spaces as underscores."""
    return unicodedata.normalize("NFKC", name).strip().replace(" ", "_")


def clean_names(names: Column) -> Column:
    """clean_name of a column. Use it on the dimension of series, not on cells."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean_name, na_action="ignore")

    return cleaned(names)


def with_clean_names(panel: DataFrame) -> DataFrame:
    """The panel with cleaned names of series; names are cleaned once a series."""
    names = panel.select("series").distinct().withColumn("clean", clean_names(F.col("series")))
    return panel.join(names, "series").select(F.col("clean").alias("series"), "sasdate", "value")


def significant(values: Column, digits: int) -> Column:
    """Numbers with so many significant digits, without trailing zeros, and an empty text for NULL and NaN.

    As a power of ten where the exponent is below -4 or has no fewer than ``digits`` places, else plain.
    """
    power = F.format_string(f"%.{digits - 1}e", values)
    shown = F.regexp_extract(power, r"^(.*?)\.?0*(e.*)$", 1)
    exponent = F.regexp_extract(power, r"e(.*)$", 1).try_cast("int")
    places = digits + 3  # of the smallest plain number
    plain = F.regexp_replace(power.try_cast(f"decimal({2 * digits + 4},{places})").cast("string"), r"\.?0+$", "")
    text = F.when((exponent < -4) | (exponent >= digits), F.concat(shown, F.regexp_extract(power, r"(e.*)$", 1))).otherwise(plain)
    return F.when(values.isNull() | F.isnan(values), "").otherwise(text)


def ten_digits(values: Column) -> Column:
    """Ten significant digits, as panels are written."""
    return significant(values, 10)


def us_date(date: Column | str) -> Column:
    """MM/dd/yyyy."""
    return F.date_format(date, "MM/dd/yyyy")


def parse_us_date(text: Column | str) -> Column:
    """A date of month/day/year with or without leading zeros; NULL for anything else."""
    return F.try_to_date(text, "M/d/yyyy")
