"""Series as they were known on a day: fetching payloads in tasks, and a store of vintages.

A vintage row is (series, sasdate, value, known_from): from that day on the month had this
value, until a later row of the month. A value that was withdrawn is a row with NULL.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Payloads(DataSource):
    """(series, payload) of addresses, one partition a series. Options: series, names split by commas; url, with {series} in it; pause and retries.

    Addresses may be of any kind that urllib opens, file: too. A task waits ``pause``
    seconds before each attempt after the first, twice as long each time, and gives up
    with a RuntimeError after ``retries`` more. A status of 4xx is not tried again.
    """

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "series string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Series(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "series" not in options or "url" not in options:
            raise ValueError("the options series and url must be given")
        self.names = [s.strip() for s in options["series"].split(",") if s.strip()]
        self.url, self.pause, self.retries = options["url"], float(options.get("pause", 1)), int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        return [_Series(n) for n in self.names]

    def read(self, partition: _Series) -> Iterator[tuple[str, str]]:
        address = self.url.replace("{series}", partition.name)
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.pause * 2 ** (attempt - 1))
            try:
                with urllib.request.urlopen(address, timeout=30) as answer:  # noqa: S310
                    yield partition.name, answer.read().decode()
                    return
            except urllib.error.HTTPError as found:
                if 400 <= found.code < 500:
                    raise RuntimeError(f"status {found.code} of {address}") from found
            except urllib.error.URLError:
                pass
        raise RuntimeError(f"no answer of {address}")


def read_payloads(spark: SparkSession, series: list[str], url: str, pause: float = 1, retries: int = 3) -> DataFrame:
    """(series, payload) of every series, fetched in tasks."""
    spark.dataSource.register(Payloads)
    return spark.read.format("payloads").option("series", ",".join(series)).option("url", url).option("pause", str(pause)).option("retries", str(retries)).load()


def changes(vintages: DataFrame) -> DataFrame:
    """(series, sasdate, value, known_from, known_until): rows of a month that say what the one before said go; the last is known until NULL. Of rows of one day the one of greatest value counts, NULL least."""
    rows = vintages.where("known_from IS NOT NULL").groupBy("series", "sasdate", "known_from").agg(F.max("value").alias("value"))
    order = Window.partitionBy("series", "sasdate").orderBy("known_from")
    first = F.row_number().over(order) == 1
    new = rows.withColumn("new", first | ~F.lag("value").over(order).eqNullSafe(F.col("value"))).where("new").drop("new")
    return new.withColumn("known_until", F.lead("known_from").over(order)).select("series", "sasdate", "value", "known_from", "known_until")


def as_of(vintages: DataFrame, day) -> DataFrame:
    """The panel (series, sasdate, value) as it was known on a day; months that were not known yet are not there. One aggregation, without a sort."""
    known = vintages.where(F.col("known_from") <= F.lit(day).cast("date"))
    last = F.max(F.struct("known_from", "value"))
    return known.groupBy("series", "sasdate").agg(last.alias("last")).select("series", "sasdate", "last.value")


def as_of_each(vintages: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """(day, series, sasdate, value): the panel as of each day of a table.

    What a row says holds from one day to another, so this is a join of days with
    intervals: intervals are laid on the years they touch, and joined by year first.
    """
    asked = days.select(F.col(day).cast("date").alias("day")).where("day IS NOT NULL").distinct()
    last = asked.agg(F.max("day").alias("last"))
    spans = changes(vintages).join(F.broadcast(last)).where("known_from <= last")  # one row
    until = F.coalesce(F.least(F.date_sub("known_until", 1), F.col("last")), F.col("last"))
    years = F.explode(F.sequence(F.year("known_from"), F.year(until))).alias("year")
    laid = spans.select("series", "sasdate", "value", "known_from", "known_until", years)
    found = laid.join(asked.withColumn("year", F.year("day")), "year").where("day >= known_from AND (known_until IS NULL OR day < known_until)")
    return found.select("day", "series", "sasdate", "value")
