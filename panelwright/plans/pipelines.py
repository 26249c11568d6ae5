"""Whole jobs over files: panels, variants, reports, targets and groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.names import significant, ten_digits, with_clean_names
from panelwright.operators.calendar import monthly_grid, since
from panelwright.operators.describe import assign_groups, correlations, describe, filter_by_group, value_counts
from panelwright.operators.missing import boundaries, missing_by_series, missing_positions, missing_runs, missing_summary
from panelwright.operators.stationarity import test_panel
from panelwright.operators.quality import assert_dates
from panelwright.operators.transforms import apply_codes, extra_transform, standardise
from panelwright.operators.variants import Rules, build_variant, catalog, parse_variants
from panelwright.schema import as_panel
from panelwright.sources import files, observations

#: Variants by name and first month. Fixed values.
VARIANTS = {"panel_start_1965_keep_late": "1965-01-01", "panel_start_1960_drop_late": "1960-01-01"}


def rules_of(config: dict) -> Rules:
    """Rules from the ``preprocessing`` part of a configuration; what it lacks stays at its default."""
    part = config.get("preprocessing", {})
    names = {"coverage_threshold": "coverage", "train_years": "train_years", "holdout_months": "holdout_months", "min_run_consecutive": "min_run", "missing_share_max": "missing_share", "leading_na_limit_months": "leading", "interior_gap_max_months": "interior", "min_obs_train_months": "min_train"}
    return Rules(**{ours: part[theirs] for theirs, ours in names.items() if theirs in part})


def build_transformed_panel(spark: SparkSession, raw_csv: str, out: str, codes: DataFrame | None = None, dry_run: bool = False, overwrite: bool = False) -> DataFrame:
    """Raw CSV with embedded codes to a transformed panel, written as Parquet unless it is a dry run."""
    panel = files.read_raw_panel(spark, raw_csv)
    result = apply_codes(panel, codes if codes is not None else files.embedded_codes(spark, raw_csv))
    if dry_run:
        return result
    files.write_panel(result, out, overwrite)
    return spark.read.parquet(out)


def build_variants(panel: DataFrame, out: str, variants: dict[str, str] | list[str] | None = None, rules: Rules = Rules(), overwrite: bool = False, source: str | None = None, meta: str | None = None) -> dict[str, dict]:
    """Write every variant's panel, as Parquet and as CSV, and its catalog as JSON; returns the catalogs.

    variants: first dates by name, or texts NAME=MM/DD/YYYY. The panel is aligned to its
    calendar first, once for all variants. Catalogs go to the folder ``meta``, or where it
    is not given beside the panels. The two CSV files hold the same columns.
    """
    chosen_variants = parse_variants(variants) if isinstance(variants, list) else variants or VARIANTS
    found = {}
    with _kept(monthly_grid(panel)) as aligned:
        for name, anchor in chosen_variants.items():
            part, chosen = build_variant(aligned, anchor, rules)
            paths = {"panel_parquet": f"{out}/{name}", "panel_csv_index": f"{out}/{name}.csv", "panel_csv_with_sasdate_col": f"{out}/{name}_sasdate_column", "catalog_json": f"{meta or out}/{name}_catalog.json"}
            files.write_panel(part, paths["panel_parquet"], overwrite)
            found[name] = catalog(name, anchor, part, chosen, rules, since(aligned, anchor), source, paths)
            written = part.sparkSession.read.parquet(paths["panel_parquet"])
            for kind in ("panel_csv_index", "panel_csv_with_sasdate_col"):
                files.write_panel_csv(written, paths[kind], found[name]["kept_series"], overwrite)
            files.write_json(found[name], paths["catalog_json"], overwrite)
    return found


@contextmanager
def _kept(panel: DataFrame) -> Iterator[DataFrame]:
    """The panel, kept on the executors while a job reads it several times; what is lost is computed again."""
    kept = panel.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def extra_transforms(panel: DataFrame, config: dict, drop_first: bool = False) -> DataFrame:
    """The configuration's transforms of single series."""
    return extra_transform(panel, config.get("preprocessing", {}).get("extra_transforms", {}), drop_first)


def report_missing(panel: DataFrame, out: str, overwrite: bool = False, source: str | None = None, meta: str | None = None) -> dict:
    """Write what is missing: by series, positions (with JSON lines) and runs, a summary and a catalog of all in JSON. Returns the catalog.

    The two JSON files go to the folder ``meta``, or where it is not given beside the tables.
    The panel is evaluated once.
    """
    with _kept(panel) as kept:
        return _report_missing(kept, out, overwrite, source, meta)


def _report_missing(panel: DataFrame, out: str, overwrite: bool, source: str | None, meta: str | None) -> dict:
    mode = "overwrite" if overwrite else "errorifexists"
    assert_dates(panel)
    paths = {"by_series_csv": f"{out}/by_series", "positions_summary_csv": f"{out}/positions_summary", "positions_jsonl": f"{out}/positions", "runs_csv": f"{out}/runs", "summary_json": f"{meta or out}/missing_summary.json"}
    by_series = missing_by_series(panel)
    by_series.withColumn("pct_missing", ten_digits(F.col("pct_missing"))).orderBy("series").write.mode(mode).option("header", True).csv(paths["by_series_csv"])
    positions = missing_positions(panel)
    positions.drop("missing_dates").orderBy("series").write.mode(mode).option("header", True).csv(paths["positions_summary_csv"])
    files.write_positions(positions, paths["positions_jsonl"], overwrite)
    missing_runs(panel).orderBy("series", "start").write.mode(mode).option("header", True).csv(paths["runs_csv"])
    found = missing_summary(by_series).first().asDict()
    ends = boundaries(panel).first()
    bounds = {k: v.strftime("%m/%d/%Y") for k, v in ends.asDict().items() if k != "notes" and v} | {"notes": list(ends.notes)}
    summary = {"boundaries": bounds, "counts": {k: v for k, v in found.items() if k.startswith("n_")}, "lists": {k: v for k, v in found.items() if k.startswith("series_")}}
    files.write_json(summary, paths["summary_json"], overwrite)
    shape = panel.agg(F.count_distinct("sasdate").alias("rows"), F.count_distinct("series").alias("cols")).first().asDict()
    catalog_path = f"{meta or out}/panel_missing_catalog.json"
    result = {"input": source, "shape": shape, "params": {"date_format": "MM/dd/yyyy"}, "boundaries": bounds, "counts": summary["counts"], "artifacts": paths | {"catalog_json": catalog_path}}
    files.write_json(result, catalog_path, overwrite)
    return result


def report_stationarity(panel: DataFrame, out: str, overwrite: bool = False, **tests) -> dict[str, int]:
    """Test every series of the aligned panel and write the table with six digits; returns how often each decision came."""
    result = test_panel(with_clean_names(monthly_grid(panel)), **tests)
    _write_tests(result, out, 6, overwrite)
    written = panel.sparkSession.read.option("header", True).csv(out)
    return {r.decision: r["count"] for r in written.groupBy("decision").count().collect()}


def _write_tests(result: DataFrame, out: str, digits: int, overwrite: bool) -> None:
    doubles = [f.name for f in result.schema if f.dataType.simpleString() == "double"]
    text = result.withColumns({c: significant(F.col(c), digits) for c in doubles})
    text.orderBy("series").write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(out)


def fetch_target(spark: SparkSession, series_id: str, name: str, key: str, api_url: str, out: str, vintage: str | None = None, overwrite: bool = False, fetcher=observations.fetch) -> dict:
    """Fetch the observations of a target, name its column and write CSV and JSON; returns what the JSON file holds."""
    found = observations.get_series(spark, series_id, key, api_url, vintage, fetcher=fetcher)
    return files.write_target(files.as_target(found, series_id, name), name, out, series_id, vintage, api_url, overwrite)


def test_target(spark: SparkSession, csv: str, out: str, value: str, date_col: str = "sasdate", overwrite: bool = False, **tests) -> str:
    """Unit-root tests of one target file, written with ten digits; returns the decision. ValueError if it has no value."""
    rows = files.read_target(spark, csv, date_col)
    if value not in rows.columns:
        raise KeyError(f"no column {value}")
    target = as_panel(rows.select(F.lit(value).alias("series"), F.expr(f"try_cast(`{date_col}` AS DATE)").alias("sasdate"), F.col(f"`{value}`").alias("value")))
    if target.where("value IS NOT NULL").isEmpty():
        raise ValueError(f"no value in {csv}")
    result = test_panel(target, **({"kpss_reg": "c"} | tests))
    _write_tests(result, out, 10, overwrite)
    return spark.read.option("header", True).csv(out).first().decision


test_target.__test__ = False


def group_report(panel: DataFrame, groups: DataFrame, out: str, group: str = "Labor Market", overwrite: bool = False) -> tuple[dict[str, int], DataFrame]:
    """Write the group of every series as CSV; returns the sizes of the groups, and the panel of one group."""
    named = assign_groups(panel, groups)
    files.write_groups(named, out, overwrite)
    sizes = {r["group"]: r.n for r in value_counts(named, "group").collect()}
    return sizes, filter_by_group(panel, groups, group)


def explore(panel: DataFrame, first: list[str]) -> dict[str, DataFrame]:
    """The tables behind a first look: shape, summary of every series, correlations, and the panel of the series ``first``."""
    shape = panel.agg(F.count_distinct("sasdate").alias("rows"), F.count_distinct("series").alias("cols"))
    return {"shape": shape, "summary": describe(panel), "correlations": correlations(panel), "sample": panel.where(F.col("series").isin(first))}


def legacy_transform(spark: SparkSession, raw_csv: str, code_json: str, out: str | None = None, standardised: bool = True, overwrite: bool = False) -> DataFrame:
    """The older form of the transformed panel: code 7 without filling, z-scores of samples, written as CSV if ``out`` is given."""
    result = apply_codes(files.read_raw_panel(spark, raw_csv), files.read_code_json(spark, code_json), mode="legacy")
    result = standardise(result, ddof=1) if standardised else result
    if out is not None:
        files.write_panel_csv(result, out, overwrite=overwrite)
    return result
