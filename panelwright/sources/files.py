"""Reading and writing panels as files."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.names import parse_us_date, ten_digits, us_date
from panelwright.schema import to_long

# ---------------------------------------------------------------- reading


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text."""
    return spark.read.option("header", True).csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header's names; no row is parsed."""
    return raw_csv(spark, path).columns


def find_code_row(spark: SparkSession, path: str, date_col: str = "sasdate", most_rows: int = 5) -> int | None:
    """The place (from 1) of the first of the first rows whose cells, but for the date, are all codes from 1 to 7. None without one.

    Empty cells do not count, but one must be there. 5.7 passes as 5.
    """
    columns = [c for c in csv_columns(spark, path) if c != date_col]
    for place, row in enumerate(raw_csv(spark, path).limit(most_rows).collect(), start=1):
        cells = [row[c] for c in columns if row[c] is not None and row[c].strip()]
        if len(cells) == len(columns) and cells and all(_code(x) in range(1, 8) for x in cells):
            return place
    return None


def _code(text: str) -> int | None:
    try:
        return int(float(text))
    except ValueError:
        return None


def embedded_codes(spark: SparkSession, path: str, date_col: str = "sasdate", code_row: int | None = None) -> DataFrame:
    """(series, tcode) of the file's row of codes; what is no code from 1 to 7 is left out."""
    place = code_row or find_code_row(spark, path, date_col)
    if place is None:
        raise ValueError(f"no row of codes in {path}")
    row = raw_csv(spark, path).limit(place).collect()[place - 1]
    found = [(c, _code(row[c])) for c in row.asDict() if c != date_col and row[c] is not None]
    return spark.createDataFrame([(c, k) for c, k in found if k in range(1, 8)], "series string, tcode int")


def read_raw_panel(spark: SparkSession, path: str, date_col: str = "sasdate") -> DataFrame:
    """The long panel of a file with an embedded row of codes, which goes: it has no date, and a code from 1 to 7 in every other cell.

    Any other row whose date does not parse stays, with a NULL date, for the checks to report.
    """
    rows = raw_csv(spark, path)
    cells = F.array(*[F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in rows.columns if c != date_col])
    day = parse_us_date(F.col(f"`{date_col}`"))
    codes = day.isNull() & F.forall(cells, lambda x: F.coalesce((x >= 1) & (x < 8), F.lit(False)))
    return to_long(rows.where(~codes).withColumn(date_col, day), date_col)


def load_stage(spark: SparkSession, config: dict, stage: str = "raw", root: str = "data") -> tuple[DataFrame, DataFrame | None]:
    """(panel, codes) of the ``raw`` or the ``processed`` file that the configuration's ``paths`` name; a processed file has no codes."""
    if stage not in ("raw", "processed"):
        raise ValueError("stage must be raw or processed")
    name = config.get("paths", {}).get(f"{stage}_filename")
    if name is None:
        raise KeyError(f"no paths.{stage}_filename in the configuration")
    if stage == "raw":
        path = f"{root}/raw_data/{name}"
        return read_raw_panel(spark, path), embedded_codes(spark, path)
    return read_panel_csv(spark, f"{root}/processed_data/{name}"), None


def first_series(spark: SparkSession, path: str, k: int, date_col: str = "sasdate") -> DataFrame:
    """(series, place) of the first k columns in the header's order."""
    names = [c for c in csv_columns(spark, path) if c != date_col][:k]
    return spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "series string, place int")


def read_target(spark: SparkSession, path: str, date_col: str = "sasdate") -> DataFrame:
    """A target CSV as text, with ``place``, the order of its rows from 0, for target_checks. A target is a short file, read in one part."""
    rows = raw_csv(spark, path).coalesce(1)
    if date_col not in rows.columns:
        raise KeyError(f"no column {date_col}")
    return rows.withColumn("place", F.monotonically_increasing_id())


def read_panel_csv(spark: SparkSession, path: str, date_col: str = "sasdate", date_format: str = "M/d/yyyy") -> DataFrame:
    """The long panel of a wide CSV file. A date that does not parse is NULL, as an empty cell is."""
    rows = raw_csv(spark, path)
    if date_col not in rows.columns:
        raise KeyError(f"no column {date_col}")
    return to_long(rows.withColumn(date_col, F.try_to_date(F.col(f"`{date_col}`"), date_format)), date_col)


def read_code_json(spark: SparkSession, path: str) -> DataFrame:
    """(series, tcode) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("series", "tcode"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label) of a text file: trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("label")).where("label <> ''")


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a file or a folder at the path."""
    try:
        spark.read.text(path).isEmpty()
        return True
    except AnalysisException as found:
        if found.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON object as write_json writes it, or in a single file."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def read_config(path: str, spark: SparkSession | None = None) -> dict:
    """A YAML file at any path that Spark reads, in UTF-8 with or without its mark, or else in Windows-1252."""
    import yaml

    found = (spark or SparkSession.active()).read.format("binaryFile").load(path).first()  # none of an empty file
    data = bytes(found.content) if found else b""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return yaml.safe_load(data.decode(encoding)) or {}
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path} is in no known encoding")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# ---------------------------------------------------------------- writing


def write_panel(panel: DataFrame, path: str, overwrite: bool = False) -> None:
    """The long panel as Parquet, the primary format."""
    panel.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_panel_csv(panel: DataFrame, path: str, series: list[str] | None = None, overwrite: bool = False) -> None:
    """The wide panel as CSV: dates as MM/dd/yyyy, ten significant digits, nothing for NULL.

    Wide rows are as wide as there are series; the long form is for large panels.
    """
    text = panel.select("series", us_date("sasdate").alias("sasdate"), F.col("sasdate").alias("day"), ten_digits(F.col("value")).alias("value"))
    wide = text.groupBy("day", "sasdate").pivot("series", series).agg(F.first("value")).orderBy("day").drop("day")
    wide.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_positions(positions: DataFrame, path: str, overwrite: bool = False) -> None:
    """{"series", "missing_dates"} a line; empty lists stay."""
    positions.select("series", "missing_dates").write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_text(text: str, path: str, overwrite: bool = False) -> None:
    """One short text, as a folder with one file, at any path that Spark writes. FileExistsError if there is something and it may not be replaced."""
    row = SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1)
    try:
        row.write.mode("overwrite" if overwrite else "errorifexists").text(path)
    except AnalysisException as found:
        if found.getCondition() == "PATH_ALREADY_EXISTS":
            raise FileExistsError(path) from found
        raise


def write_json(value: dict, path: str, overwrite: bool = False) -> None:
    """A small JSON object with sorted keys, written as write_text does."""
    write_text(json.dumps(value, indent=2, sort_keys=True, default=str), path, overwrite)


def write_labels(panel: DataFrame, path: str, overwrite: bool = False) -> None:
    """The series' names as text, one a line."""
    names = panel.select("series").distinct().orderBy("series")
    names.select(F.col("series").alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_groups(groups: DataFrame, path: str, overwrite: bool = False) -> None:
    """(variable, group) of series as CSV."""
    table = groups.select(F.col("series").alias("variable"), "group").orderBy("variable")
    table.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_target(target: DataFrame, value: str, path: str, series_id: str, vintage: str | None = None, source: str | None = None, overwrite: bool = False) -> dict:
    """The target as CSV (yyyy-MM-dd, ten significant digits), and beside it a JSON file of what it is, which is returned."""
    table = target.select(F.date_format("sasdate", "yyyy-MM-dd").alias("sasdate"), ten_digits(F.col(value)).alias(value)).orderBy("sasdate")
    table.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)
    ends = target.agg(F.count("*").alias("n"), F.min("sasdate").alias("a"), F.max("sasdate").alias("z")).first()
    info = {"series_id": series_id, "vintage": vintage or "latest", "downloaded_at_utc": datetime.now(UTC).isoformat(timespec="seconds"), "rows": ends.n, "first_date": str(ends.a), "last_date": str(ends.z), "column_name": value, "source": source}
    write_json(info, f"{path}_meta.json", overwrite)
    return info


def extract_codes(spark: SparkSession, path: str, out: str, date_col: str = "sasdate", require_all: bool = True, overwrite: bool = False, sidecar: bool = True, code_row: int | None = None, detect: bool = True) -> dict:
    """Write a file's codes as JSON, and beside it where they come from. Returns the latter.

    The row of codes is ``code_row``, or with ``detect`` the one that find_code_row finds, or else the first.
    """
    place = code_row or (find_code_row(spark, path, date_col) if detect else None) or (1 if not detect else None)
    codes = {r.series: r.tcode for r in embedded_codes(spark, path, date_col, place).collect()}
    names = [c for c in csv_columns(spark, path) if c != date_col]
    missing = sorted(set(names) - set(codes))
    if missing and require_all:
        raise KeyError(f"no valid code for {', '.join(missing)}")
    write_json(codes, out, overwrite)
    info = {"csv_path": path, "csv_sha256": file_hashes(spark, path).first().sha256, "tcode_row": place, "n_series": len(codes), "missing_in_tcodes": missing, "extra_in_tcodes": sorted(set(codes) - set(names)), "mapping_json_path": out}
    if sidecar:
        write_json(info, f"{out}.meta.json", overwrite=True)
    return info


def as_target(observations: DataFrame, series_id: str, name: str) -> DataFrame:
    """Rename the value column of a series, which must be there."""
    if series_id not in observations.columns:
        raise KeyError(f"no column {series_id}")
    return observations.select("sasdate", F.col(f"`{series_id}`").alias(name))

