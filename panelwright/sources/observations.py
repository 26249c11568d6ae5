"""Observation services: JSON payloads, and metadata on HTML pages.

Fetching is done by the driver (one series), by tasks (vintages.read_payloads) or by a job
that stores payloads as text; parsing is a Spark expression over a table of payloads.
"""

from __future__ import annotations

import urllib.parse
import urllib.request
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.schema import clean
from panelwright.sources import files

_PAYLOAD = "struct<observations: array<struct<date: string, value: string>>>"


def request_url(api_url: str, series_id: str, key: str, vintage: str | None = None, extra: dict | None = None) -> str:
    """The address of a series; a vintage asks for the values as they were on that day."""
    query = {"series_id": series_id, "api_key": key, "file_type": "json"}
    if vintage:
        query |= {"realtime_start": vintage, "realtime_end": vintage}
    return f"{api_url}?{urllib.parse.urlencode(query | (extra or {}))}"


def fetch(url: str, timeout: float = 30) -> str:
    """The text at an address; any status but 200 is a RuntimeError."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        if answer.status != 200:
            raise RuntimeError(f"status {answer.status} of {url}")
        return answer.read().decode()


def download(url: str, path: str, overwrite: bool = False, timeout: float = 30) -> str:
    """Store the text at an address at any path that Spark writes, unless something is there already."""
    spark = SparkSession.active()
    if overwrite or not files.is_there(spark, path):
        files.write_text(fetch(url, timeout), path, overwrite)
    return path


def parse_observations(payloads: DataFrame, payload: str = "payload", series: str = "series") -> DataFrame:
    """(series, sasdate, value) of JSON payloads, one a row; "." and other texts are NULL."""
    rows = payloads.select(F.col(series).alias("series"), F.explode(F.from_json(payload, _PAYLOAD)["observations"]).alias("x"))
    return rows.select("series", F.try_to_date("x.date").alias("sasdate"), F.col("x.value").alias("raw")).select("series", "sasdate", clean("raw").alias("value"))


def require_observations(observations: DataFrame) -> DataFrame:
    """The same, or a RuntimeError if there is none."""
    if observations.isEmpty():
        raise RuntimeError("no observations")
    return observations


def get_series(spark: SparkSession, series_id: str, key: str, api_url: str, vintage: str | None = None, timeout: float = 30, extra: dict | None = None, fetcher=fetch) -> DataFrame:
    """(sasdate, <series_id>) of a service: fetched by the driver, parsed by Spark. RuntimeError if there is no observation.

    A vintage asks for the values as they were known on that day.
    """
    payload = fetcher(request_url(api_url, series_id, key, vintage, extra), timeout)
    found = parse_observations(spark.createDataFrame([(series_id, payload)], "series string, payload string"))
    return require_observations(found).select("sasdate", F.col("value").alias(series_id)).orderBy("sasdate")


def check_metadata(pages: DataFrame, folder: str, label: str = "label", html: str = "html", overwrite: bool = False) -> DataFrame:
    """Write a line for every page with frequency and seasonality to folder/report, and the labels of the others to folder/failed, which are returned."""
    mode = "overwrite" if overwrite else "errorifexists"
    parse_metadata(pages, label, html).write.mode(mode).parquet(f"{folder}/parsed")
    found = pages.sparkSession.read.parquet(f"{folder}/parsed")
    line = F.concat("label", F.lit(": Frequency = "), "frequency", F.lit(", Seasonality = "), "seasonality")
    found.where("ok").select(line.alias("value")).write.mode(mode).text(f"{folder}/report")
    failed = found.where("NOT ok").select("label")
    failed.write.mode(mode).text(f"{folder}/failed")
    return failed


class _Metadata(HTMLParser):
    """Texts of the elements that a simple selector (tag.classes element.classes) names."""

    def __init__(self, outer: tuple[str, str], inner: tuple[str, str]):
        super().__init__()
        self.outer, self.inner = outer, inner
        self.found: list[str] = []
        self.depth = 0
        self.open = False

    @staticmethod
    def _fits(tag: str, attributes, want: tuple[str, str]) -> bool:
        return tag == want[0] and set(want[1].split(".")) <= set((dict(attributes).get("class") or "").split())

    def handle_starttag(self, tag, attrs):
        if self._fits(tag, attrs, self.outer):
            self.depth += 1
        elif self.depth and self._fits(tag, attrs, self.inner):
            self.found.append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag == self.inner[0]:
            self.open = False
        elif tag == self.outer[0] and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.open:
            self.found[-1] += data


def page_metadata(page: str | None, outer=("p", "mb-2"), inner=("span", "series-meta-value")) -> tuple[str | None, str | None]:
    """(frequency, seasonality) of a series' page."""
    parser = _Metadata(outer, inner)
    parser.feed(page or "")
    texts = [" ".join(t.split()) for t in parser.found]
    frequency = next((t for t in texts if any(w in t for w in ("Monthly", "Quarterly", "Weekly", "Daily", "Annual"))), None)
    season = next((t for t in texts if "Seasonally Adjusted" in t), None)
    return frequency, season


def parse_metadata(pages: DataFrame, label: str = "label", html: str = "html") -> DataFrame:
    """(label, frequency, seasonality, ok) of a table of pages."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [page_metadata(x) for x in part["html"]]
            yield pd.DataFrame({"label": part["label"], "frequency": [f for f, _ in found], "seasonality": [s for _, s in found]})

    out = pages.select(F.col(label).cast("string").alias("label"), F.col(html).alias("html")).mapInPandas(rows, "label string, frequency string, seasonality string")
    return out.withColumn("ok", F.col("frequency").isNotNull() & F.col("seasonality").isNotNull())
