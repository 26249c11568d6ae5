"""Panel operators against small tables with known results."""

import itertools
import json
import math
import re
from datetime import date

import numpy as np
import pandas as pd
import plain_stationarity
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.functions import linear, taxonomies, text
from panelwright.functions.names import clean_name, significant, with_clean_names
from panelwright.operators import calendar, chunks, describe, factors, missing, null_tables, quality, seasonal, stationarity, transforms, variants
from panelwright.plans import pipelines
from panelwright.schema import PANEL, as_panel
from panelwright.sources import files, observations, vintages


def months(n, year=2000):
    return [date(year + i // 12, i % 12 + 1, 1) for i in range(n)]


def panel_of(spark, **series):
    rows = [(name, d, v) for name, values in series.items() for d, v in zip(months(len(values)), values, strict=True)]
    return spark.createDataFrame(rows, PANEL)


def values(df, name, column="value"):
    return [getattr(r, column) for r in df.where(f"series = '{name}'").orderBy("sasdate").collect()]


def test_code_seven_fills_gaps_first_and_the_legacy_form_does_not(spark):
    panel = panel_of(spark, a=[1.0, 2.0, None, 4.0, 0.0, 0.0, 5.0, None])
    assert values(transforms.apply_code(panel, 7), "a") == [None, None, -1.0, 1.0, -2.0, None, None, None]
    assert values(transforms.apply_code(panel, 7, mode="legacy"), "a") == [None] * 8


def _pandas_code(s, code):
    log = np.log(s.where(s > 0))
    return {1: s, 2: s.diff(), 3: s.diff().diff(), 4: log, 5: log.diff(), 6: log.diff().diff()}[code]


def test_codes_agree_with_pandas(spark):
    rng = np.random.default_rng(1)
    table = {f"s{i}": [None if rng.random() < 0.2 else float(round(rng.normal() * 3, 3)) for _ in range(30)] for i in range(6)}
    panel = panel_of(spark, **table)
    for code in range(1, 7):
        got = transforms.apply_code(panel, code)
        for name, xs in table.items():
            want = _pandas_code(pd.Series(xs, dtype=float), code)
            for g, w in zip(values(got, name), want, strict=True):
                assert (g is None and math.isnan(w)) or g == pytest.approx(w)


def test_codes_must_be_known_and_valid(spark):
    panel = panel_of(spark, a=[1.0], b=[2.0])
    with pytest.raises(KeyError):
        transforms.apply_codes(panel, taxonomies.codes(spark, {"a": 1}))
    with pytest.raises(ValueError):
        transforms.apply_codes(panel, taxonomies.codes(spark, {"a": 1, "b": 9}))


def test_monthly_grid_rolls_forward_drops_off_grid_and_refuses_duplicates(spark):
    rows = [("a", date(2000, 1, 15), 1.0), ("a", date(2000, 2, 1), 2.0), ("a", date(2000, 4, 1), 4.0), ("b", date(2000, 3, 9), 9.0)]
    grid = calendar.monthly_grid(spark.createDataFrame(rows, PANEL))
    assert values(grid, "a") == [2.0, None, 4.0]
    assert values(grid, "b") == [None, None, None]
    with pytest.raises(ValueError):
        calendar.monthly_grid(spark.createDataFrame(rows + rows[:1], PANEL))
    with pytest.raises(ValueError):
        calendar.monthly_grid(spark.createDataFrame([], PANEL))


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([("a", date(2000, 1, 1), "nan"), ("a", date(2000, 2, 1), "."), ("a", date(2000, 3, 1), "1.5"), ("a", date(2000, 4, 1), "Infinity")], "series string, sasdate date, value string")
    assert values(as_panel(df), "a") == [None, None, 1.5, None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=24))
def test_runs_and_gaps_of_any_mask(spark, mask):
    panel = panel_of(spark, a=[None if m else 1.0 for m in mask], b=[1.0] * len(mask))
    runs, i = [], 0
    while i < len(mask):
        j = i
        while j < len(mask) and mask[j]:
            j += 1
        if j > i:
            runs.append((i, j - i))
        i = max(j, i + 1)
    got = missing.missing_runs(panel).where("series = 'a'").orderBy("start").collect()
    assert [(months(30).index(r.start), r.length) for r in got] == runs
    first = next((k for k, m in enumerate(mask) if not m), None)
    assert missing.leading_gap(panel).where("series = 'a'").first().lead_gap == (len(mask) if first is None else first)
    last = max((k for k, m in enumerate(mask) if not m), default=None)
    inside = len(mask) if first is None else max((n for s, n in runs if first < s and s + n - 1 < last), default=0)
    assert missing.interior_gap(panel).where("series = 'a'").first().gap == inside


def test_missing_report(spark):
    panel = panel_of(spark, a=[None, None, 1.0, None, None], b=[1.0] * 5)
    rows = {r.series: r for r in missing.missing_by_series(panel).collect()}
    assert (rows["a"].n_missing, rows["a"].miss_both_first_two, rows["a"].n_missing_intermediate, rows["a"].miss_last) == (4, True, 1, True)
    assert rows["b"].pct_missing == 0 and not rows["b"].miss_intermediate
    summary = missing.missing_summary(missing.missing_by_series(panel)).first()
    assert summary.series_last == ["a"] and summary.n_first == 1
    notes = missing.boundaries(panel, first="1990-01-01").first()
    assert notes.first == date(2000, 1, 1) and len(notes.notes) == 1
    cut = missing.missing_positions(panel, limit=2).where("series = 'a'").first()
    assert cut.n_runs == 2 and cut.longest_run == 2 and len(cut.missing_dates) == 2


def test_one_row_panel_has_itself_as_second_row(spark):
    row = missing.missing_by_series(panel_of(spark, a=[None])).first()
    assert row.miss_first and row.miss_second and not row.miss_intermediate


@pytest.mark.parametrize(("anchor", "kept", "branch"), [("1960-01-01", 3, "rolling")])
def test_variant_keeps_and_drops_by_the_first_rule(spark, anchor, kept, branch):
    n = 120
    full = [1.0] * n
    panel = panel_of(spark, a=full, b=full, c=full, share=[None] * 60 + full[60:], lead=[None] * 30 + full[30:], gap=full[:50] + [None] * 8 + full[58:])
    rules = variants.Rules(train_years=5, holdout_months=12)
    part, chosen = variants.build_variant(panel, anchor, rules)
    reasons = {r.series: r.reason for r in chosen.collect()}
    assert reasons == {"a": None, "b": None, "c": None, "share": "missing_share", "lead": "leading", "gap": "interior_gap"}
    assert part.select("series").distinct().count() == kept
    window = variants.training_window(panel, rules).first()
    assert window.branch == branch and window.train_end == months(n)[n - 13]
    found = variants.catalog("x", anchor, part, chosen, rules, panel)
    assert found["n_series"] == kept and found["n_rows"] == n and found["anchor_start"] == "01/01/1960"
    assert found["dropped_series"]["lead"]["drop_reason"] == "leading_na>24" and found["dropped_series"]["share"]["drop_reason"] == "missing_share>0.40"


#: Months without a value at the start of each series, and at other places from the end (1 is the last) of the transformed panel of 796 months; other series have the first two. Fixed values.
LEADING = {"ACOGNO": 398, "ANDENOx": 110, "TWEXAFEGSMTHx": 169, "UMCSENTx": 229, "VIXCLSx": 42, "COMPAPFFx": 0, "CP3Mx": 1, "PERMIT": 12, "PERMITNE": 12, "PERMITMW": 12, "PERMITS": 12, "PERMITW": 12}
LATER = {"ACOGNO": [1], "COMPAPFFx": [61], "CP3Mx": [61, 60], "BUSINVx": [1], "CMRMTSPLx": [1], "CONSPI": [1], "HWI": [1], "HWIURATIO": [1], "DTCOLNVHFNM": [1], "DTCTHFNM": [1]}


@pytest.mark.parametrize(("anchor", "rows", "dropped"), [("1960-01-01", 784, {"ACOGNO", "ANDENOx", "TWEXAFEGSMTHx", "UMCSENTx", "VIXCLSx"}), ("1965-01-01", 724, {"ACOGNO", "ANDENOx", "TWEXAFEGSMTHx", "UMCSENTx"})])
def test_variants_of_the_known_panel(spark, anchor, rows, dropped):
    n = 796
    cells = {}
    for name in taxonomies.code_map():
        gone = set(range(LEADING.get(name, 2))) | {n - k for k in LATER.get(name, ())}
        cells[name] = [None if i in gone else 1.0 for i in range(n)]
    table = pd.DataFrame([(name, d, v) for name, xs in cells.items() for d, v in zip(months(n, 1959), xs, strict=True)], columns=["series", "sasdate", "value"])
    panel = as_panel(spark.createDataFrame(table, PANEL))
    part, chosen = variants.build_variant(panel, anchor)
    found = variants.catalog("x", anchor, part, chosen, variants.Rules(), calendar.since(panel, anchor))
    assert (found["n_rows"], found["n_series"], set(found["dropped_series"])) == (rows, 126 - len(dropped), dropped)
    assert found["train_window"] == ["05/01/1990", "04/01/2020"]
    reasons = {k: v["drop_reason"] for k, v in found["dropped_series"].items()}
    assert reasons == {k: "missing_share>0.40" if k == "ACOGNO" else "leading_na>24" for k in dropped}


def test_variant_files(spark, tmp_path):
    panel = panel_of(spark, a=[float(i) for i in range(60)], b=[1.5] * 60, gap=[None] * 40 + [1.0] * 20)
    found = pipelines.build_variants(panel, str(tmp_path), ["late=01/01/2001"], variants.Rules(coverage=0.6, train_years=2, holdout_months=6, min_train=12), source="in.csv")
    assert files.read_json(spark, str(tmp_path / "late_catalog.json")) == found["late"] and found["late"]["kept_series"] == ["a", "b"]
    assert found["late"]["input_csv"] == "in.csv" and found["late"]["n_rows"] == 48
    assert values(files.read_panel_csv(spark, found["late"]["artifacts"]["panel_csv_with_sasdate_col"], date_format="MM/dd/yyyy"), "a")[0] == 12.0
    with pytest.raises(ValueError):
        variants.parse_variants(["late"])


def test_the_choice_of_series_takes_one_exchange_of_the_panel(spark, tmp_path):
    panel_of(spark, a=[1.0, None, 2.0], b=[1.0, 2.0, 3.0]).write.parquet(str(tmp_path / "p"))
    panel = spark.read.parquet(str(tmp_path / "p"))
    for df in (missing.gap_measures(panel), missing.missing_positions(panel), missing.interior_gap(panel)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        by_series = re.findall(r"Exchange hashpartitioning\(series#\d+, (\w+)", plan)
        assert sorted(by_series) == ["4", "_groupingexpression"] and plan.count("FileScan") == 1  # rows by series and chunk, then their summaries by series


def test_factor_panel(spark):
    panel = panel_of(spark, a=[1.0, 2.0, 4.0, 7.0], b=[None, 2.0, None, 5.0], c=[None] * 4)
    codes = taxonomies.codes(spark, {"a": 1, "b": 1, "c": 1})
    assert factors.prepare_for_factors(panel, codes, "none", standardised=False).count() == 8
    assert factors.prepare_for_factors(panel, codes, "initial", standardised=False).count() == 6
    assert factors.prepare_for_factors(panel, codes, "all", standardised=False).count() == 4
    with pytest.raises(ValueError):
        factors.balance_panel(panel, "some")
    z, info = factors.prepare_with_info(panel, codes, "all")
    assert z.count() == 4 and [r.series for r in info["all_missing"].collect()] == ["c"] and info["global_first"].first().place == 1
    assert {r.series: r.place for r in info["first_valid"].collect()} == {"a": 0, "b": 1}
    assert sorted(r.sasdate for r in info["rows_dropped"].collect()) == [months(4)[0], months(4)[2]]
    assert {r.series: (r.mean, r.std) for r in info["moments"].collect()} == {"a": (4.5, 2.5), "b": (3.5, 1.5)} and info["leads_lost"][6] == 2
    z = values(transforms.standardise(panel_of(spark, a=[1.0, 2.0, 3.0], k=[5.0, 5.0, 5.0])), "a")
    assert z == pytest.approx([-1.224744871, 0, 1.224744871])
    assert values(transforms.standardise(panel_of(spark, k=[5.0, 5.0])), "k") == [None, None]


def test_extra_transforms(spark):
    panel = panel_of(spark, a=[float(i * i) for i in range(14)], b=[1.0] * 14)
    assert values(transforms.extra_transform(panel, {"a": "yoy"}), "a")[12:] == [144.0, 168.0]
    assert values(transforms.extra_transform(panel, {"a": "DIFF "}, drop_first=True), "a")[0] == 1.0
    with pytest.warns(UserWarning, match="no series z"):
        kept = transforms.extra_transform(panel, {"z": "diff"}, drop_first=True)
    assert kept.count() == 28
    with pytest.raises(ValueError):
        transforms.extra_transform(panel, {"a": "log"})


def test_groups_and_codes_have_the_known_sizes(spark):
    assert len(taxonomies.code_map()) == 126
    counts = pd.Series(taxonomies.code_map()).value_counts().to_dict()
    assert counts == {1: 11, 2: 19, 4: 10, 5: 52, 6: 33, 7: 1}
    assert taxonomies.groups(spark, "eleven").count() == 126
    known = describe.assign_groups(taxonomies.codes(spark), taxonomies.groups(spark, "eight"))
    sizes = {r["group"]: r.n for r in describe.value_counts(known, "group").collect()}
    assert sizes == {"Labor Market": 31, "Interest Rate and Exchange Rates": 22, "Prices": 20, "Output and Income": 16, "Money and Credit": 13, "Orders and Inventories": 10, "Consumption and Orders": 10, "Stock Market": 4}


def test_names(spark):
    assert clean_name(" S&P div yield ") == "S&P_div_yield"
    assert [r.series for r in with_clean_names(panel_of(spark, **{" a b": [1.0]})).collect()] == ["a_b"]


def test_checks(spark):
    rows = [("a", date(2000, 1, 1), 1.0), ("a", date(2000, 1, 1), 2.0), ("a", date(2000, 3, 1), 2.0)]
    found = {r.check: r.passed for r in quality.structure_checks(spark.createDataFrame(rows, PANEL)).collect()}
    assert found == {"not empty": True, "dates parse": True, "dates are unique": False, "no gap in the grid": False}
    with pytest.raises(ValueError):
        quality.assert_monthly(spark.createDataFrame(rows, PANEL))
    target = spark.createDataFrame([("2000-03-01", "1"), ("2000-03-01", "x"), ("bad", "2")], "sasdate string, gdp string")
    found = {r.check: r.passed for r in quality.target_checks(target, "sasdate", "gdp", strict_quarter_end=True).collect()}
    assert found == {"dates parse": False, "dates are unique": False, "values are numbers": False, "months end quarters": True}
    several = target.withColumn("more", target.gdp)
    assert [(r.check, r.passed) for r in quality.target_checks(several, "sasdate").collect()] == [("one value column", False)]
    rising = spark.createDataFrame([(0, "2000-03-01", "1"), (1, "2000-06-01", "2"), (2, "2000-06-01", "2")], "place long, sasdate string, gdp string")
    assert {r.check: r.passed for r in quality.target_checks(rising, "sasdate", place="place").collect()} == {"dates parse": True, "dates are unique": False, "values are numbers": True, "dates rise": False}
    assert quality.target_checks(rising.where("place < 2"), "sasdate", place="place").where("NOT passed").count() == 0
    order = spark.createDataFrame([(1, date(2000, 1, 1)), (2, date(2000, 3, 1)), (3, date(2000, 2, 1))], "p int, d date")
    assert not quality.file_order_is_sorted(order, "p", "d").first().sorted


def test_checks_of_a_panel_file(spark, tmp_path):
    def found(text):
        path = tmp_path / f"f{abs(hash(text))}.csv"
        path.write_text(text)
        return {r.check for r in quality.file_checks(files.raw_csv(spark, str(path))).where("NOT passed").collect()}

    assert found("sasdate,A,B\n01/01/2000,1,\n02/01/2000,2,3\n") == set()
    assert found("sasdate,A B,A_B\n02/01/2000,1,x\n01/01/2000,2,3\n01/01/2000,2,3\n05/01/2000,,\n") == {"dates are unique", "dates are in order", "no gap in the grid", "clean names are unique", "columns are numbers"}
    assert found("sasdate,A\n") == {"not empty"} and found("day,A\n1,2\n") == {"columns"} and found("sasdate,A\nsoon,2\n01/01/2000,2\n") == {"dates parse"}


def test_a_year_is_all_of_it(spark):
    panel = panel_of(spark, a=[float(i) for i in range(40)])
    assert values(calendar.between(panel, "2001", "2001"), "a") == [float(i) for i in range(12, 24)]
    assert values(calendar.between(panel, "2001-03", "2001-04"), "a") == [14.0, 15.0] and calendar.between(panel, "2003-02-01").count() == 3


def test_gaps_of_the_grid(spark):
    rows = [("a", date(2000, m, 1), 1.0) for m in (1, 2, 5)] + [("b", date(2000, 4, 1), 1.0)]
    assert [r.sasdate for r in calendar.grid_gaps(spark.createDataFrame(rows, PANEL)).collect()] == [date(2000, 3, 1)]


def test_stages_labels_groups_and_the_legacy_form(spark, tmp_path):
    (tmp_path / "raw_data").mkdir()
    raw = tmp_path / "raw_data" / "r.csv"
    raw.write_text("sasdate,INDPRO,A B\nTransform:,7,1\n1/1/1959,1,2\nlater,9,9\n2/1/1959,.,4\n3/1/1959,3,6\n")
    config = {"paths": {"raw_filename": "r.csv"}}
    panel, codes = files.load_stage(spark, config, "raw", str(tmp_path))
    assert {r.series: r.tcode for r in codes.collect()} == {"INDPRO": 7, "A B": 1} and panel.where("sasdate IS NULL").count() == 2
    with pytest.raises(KeyError):
        files.load_stage(spark, config, "processed", str(tmp_path))
    with pytest.raises(ValueError):
        files.load_stage(spark, config, "cooked", str(tmp_path))
    assert [r.series for r in files.first_series(spark, str(raw), 1).collect()] == ["INDPRO"]
    files.write_labels(panel, str(tmp_path / "labels"))
    assert [r.label for r in files.read_labels(spark, str(tmp_path / "labels")).orderBy("label").collect()] == ["A B", "INDPRO"]
    dated = panel.where("sasdate IS NOT NULL")
    sizes, part = pipelines.group_report(dated, taxonomies.groups(spark, "eight"), str(tmp_path / "groups"), "Output and Income")
    assert sizes == {"Output and Income": 1} and part.count() == 3
    assert {(r.variable, r["group"]) for r in spark.read.option("header", True).csv(str(tmp_path / "groups")).collect()} == {("INDPRO", "Output and Income"), ("A B", None)}
    look = pipelines.explore(dated, ["A B"])
    assert look["shape"].first().asDict() == {"rows": 3, "cols": 2} and look["sample"].count() == 3
    info = files.extract_codes(spark, str(raw), str(tmp_path / "codes.json"), code_row=1)
    assert info["n_series"] == 2
    out = pipelines.legacy_transform(spark, str(raw), str(tmp_path / "codes.json"), str(tmp_path / "legacy"))
    assert [v for v in values(out.where("sasdate IS NOT NULL"), "A B")][0] < 0 and (tmp_path / "legacy").exists()
    bad = tmp_path / "bad.csv"
    bad.write_text("sasdate,A,B\nTransform:,2,9\n1/1/1959,1,2\n")
    with pytest.raises(KeyError):
        files.extract_codes(spark, str(bad), str(tmp_path / "bad.json"), detect=False)
    diagnosis = quality.code_diagnostics(panel, taxonomies.codes(spark, {"INDPRO": 9, "C": 1})).first()
    assert (diagnosis.missing_in_tcodes, diagnosis.extra_in_tcodes) == (["A B", "INDPRO"], ["C"])


def test_target_job(spark, tmp_path):
    rng = np.random.default_rng(2)
    payload = json.dumps({"observations": [{"date": f"{1980 + i // 4}-{i % 4 * 3 + 1:02d}-01", "value": "." if i == 3 else f"{v:.4f}"} for i, v in enumerate(rng.normal(size=80))]})
    asked = []

    def fetcher(url, timeout):
        asked.append(url)
        return payload

    info = pipelines.fetch_target(spark, "GDP1", "gdp", "key", "http://x", str(tmp_path / "gdp"), vintage="2020-01-01", fetcher=fetcher)
    assert (info["rows"], info["first_date"], info["vintage"]) == (80, "1980-01-01", "2020-01-01") and "realtime_end=2020-01-01" in asked[0]
    assert files.read_json(spark, str(tmp_path / "gdp_meta.json")) == info
    checks = {r.check: r.passed for r in quality.target_checks(files.read_target(spark, str(tmp_path / "gdp")), "sasdate", place="place").collect()}
    assert all(checks.values())
    assert pipelines.test_target(spark, str(tmp_path / "gdp"), str(tmp_path / "tests"), "gdp", pp=True) == "stationary"
    with pytest.raises(KeyError):
        pipelines.test_target(spark, str(tmp_path / "gdp"), str(tmp_path / "none"), "other")
    with pytest.raises(RuntimeError):
        observations.get_series(spark, "GDP1", "key", "http://x", fetcher=lambda url, timeout: "{}")


def test_pages_with_and_without_metadata_are_split(spark, tmp_path):
    cell = '<p class="mb-2"><span class="series-meta-value">{}</span></p>'
    pages = spark.createDataFrame([("a", cell.format("Monthly") + cell.format("Seasonally Adjusted")), ("b", cell.format("Monthly")), ("c", None)], "label string, html string")
    assert sorted(r.label for r in observations.check_metadata(pages, str(tmp_path)).collect()) == ["b", "c"]
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a: Frequency = Monthly, Seasonality = Seasonally Adjusted"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "failed")).collect()) == ["b", "c"]


def test_raw_file_with_embedded_codes(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("sasdate,A B,C&D\nTransform:,2,5.0\n1/1/1959,1.5,2\n2/1/1959,.,4\n")
    assert files.find_code_row(spark, str(path)) == 1
    assert {r.series: r.tcode for r in files.embedded_codes(spark, str(path)).collect()} == {"A B": 2, "C&D": 5}
    panel = files.read_raw_panel(spark, str(path))
    assert values(panel, "A B") == [1.5, None] and values(panel, "C&D") == [2.0, 4.0]
    out = pipelines.build_transformed_panel(spark, str(path), str(tmp_path / "panel"))
    assert values(out, "C&D")[1] == pytest.approx(math.log(2))
    info = files.extract_codes(spark, str(path), str(tmp_path / "codes.json"))
    assert info["tcode_row"] == 1 and files.read_json(spark, str(tmp_path / "codes.json")) == {"A B": 2, "C&D": 5}
    assert {r.series: r.tcode for r in files.read_code_json(spark, str(tmp_path / "codes.json")).collect()} == {"A B": 2, "C&D": 5}
    with pytest.raises(FileExistsError):
        files.extract_codes(spark, str(path), str(tmp_path / "codes.json"))
    files.write_panel_csv(panel, str(tmp_path / "wide"))
    back = files.read_panel_csv(spark, str(tmp_path / "wide"))
    assert values(back, "A B") == [1.5, None]
    plain = tmp_path / "plain.csv"
    plain.write_text("sasdate,A\n1/1/1959,150\n")
    assert files.find_code_row(spark, str(plain)) is None


def test_report_files(spark, tmp_path):
    panel = panel_of(spark, a=[None, 1.0], b=[1.0, 2.0])
    info = pipelines.report_missing(panel, str(tmp_path / "report"), source="x.csv")
    assert info["counts"]["n_series"] == 2 and info["shape"] == {"rows": 2, "cols": 2} and info["boundaries"]["last"] == "02/01/2000"
    assert files.read_json(spark, str(tmp_path / "report" / "panel_missing_catalog.json")) == info
    summary = files.read_json(spark, str(tmp_path / "report" / "missing_summary.json"))
    assert summary["lists"]["series_first"] == ["a"] and summary["lists"]["series_last"] == []
    with pytest.raises(TypeError):
        pipelines.report_missing(panel.withColumn("sasdate", panel.sasdate.cast("string")), str(tmp_path / "other"))
    lines = [json.loads(x) for f in (tmp_path / "report" / "positions").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["series"]: len(x["missing_dates"]) for x in lines} == {"a": 1, "b": 0}


def test_observations_and_metadata(spark):
    payload = json.dumps({"observations": [{"date": "2000-01-01", "value": "1.5"}, {"date": "2000-04-01", "value": "."}]})
    got = observations.parse_observations(spark.createDataFrame([("g", payload), ("h", "no json")], "series string, payload string"))
    assert values(got, "g") == [1.5, None]
    with pytest.raises(RuntimeError):
        observations.require_observations(got.where("series = 'h'"))
    assert "realtime_start=2020-01-01" in observations.request_url("http://x", "s", "k", vintage="2020-01-01")
    page = '<p class="mb-2"><b>Frequency</b> <span class="series-meta-value">Monthly</span></p><p class="mb-2 x"><span class="series-meta-value"> Seasonally  Adjusted </span></p><span class="series-meta-value">Daily</span>'
    assert observations.page_metadata(page) == ("Monthly", "Seasonally Adjusted")
    with pytest.raises(KeyError):
        files.as_target(got, "x", "gdp")


def test_unit_root_tests_tell_noise_from_a_walk(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=300)
    walk = np.cumsum(rng.normal(size=300))
    panel = panel_of(spark, noise=[float(v) for v in noise], walk=[float(v) for v in walk], none=[None] * 300, flat=[1.0] * 300)
    rows = {r.series: r for r in stationarity.test_panel(panel, kpss_reg="c", pp=True, dfgls=True, za=True).collect()}
    assert rows["noise"].decision == "stationary" and rows["noise"].adf_pvalue < 0.01 and rows["noise"].pp_pvalue < 0.01
    assert rows["walk"].decision == "non-stationary" and rows["walk"].adf_pvalue > 0.1
    assert rows["none"].decision == "inconclusive" and rows["none"].n_non_na == 0 and rows["none"].adf_pvalue is None
    assert rows["flat"].adf_pvalue is None and rows["flat"].decision == "inconclusive"
    assert rows["noise"].za_break_index is not None and rows["noise"].za_pvalue < 0.01 and rows["noise"].dfgls_pvalue < 0.05
    assert rows["walk"].za_pvalue > 0.1 and rows["walk"].dfgls_pvalue > rows["noise"].dfgls_pvalue
    tests = [plain_stationarity.zivot_andrews(walk, t) for t in ("c", "t", "ct")]
    assert any(rows["walk"].za_stat == pytest.approx(t, rel=1e-9) for t, _, _ in tests)


def _series_of_all_kinds():
    rng = np.random.default_rng(1)
    out = {}
    for k, n in enumerate((5, 12, 20, 40, 81, 150, 300)):
        out |= {f"noise{k}": 10 + 5 * rng.normal(size=n), f"walk{k}": np.cumsum(rng.normal(size=n)), f"trend{k}": np.arange(n) * 0.3 + rng.normal(size=n)}
        out[f"mean{k}"] = np.convolve(rng.normal(size=n + 3), [1, 0.5, 0.3, 0.2], "valid")
    return out | {"three": np.array([1.0, 2.0, 4.0]), "two": np.array([1.0, 2.0])}


TESTS = {
    "adf_stat": (lambda df: stationarity.adf(df), lambda x: plain_stationarity.adf(x)),
    "adf_all_lags": (lambda df: stationarity.adf(df, None, "adf_all_lags"), lambda x: plain_stationarity.adf(x, None)),
    "adf_bic": (lambda df: stationarity.adf(df, "BIC", "adf_bic"), lambda x: plain_stationarity.adf(x, "BIC")),
    "kpss_stat": (lambda df: stationarity.kpss(df), lambda x: plain_stationarity.kpss(x)),
    "kpss_line": (lambda df: stationarity.kpss(df, "ct", "legacy", "kpss_line"), lambda x: plain_stationarity.kpss(x, "ct", "legacy")),
    "kpss_three": (lambda df: stationarity.kpss(df, "c", 3, "kpss_three"), lambda x: plain_stationarity.kpss(x, "c", 3)),
    "pp_stat": (lambda df: stationarity.phillips_perron(df), lambda x: plain_stationarity.phillips_perron(x)),
    "dfgls_stat": (lambda df: stationarity.df_gls(df), lambda x: plain_stationarity.df_gls(x)),
    "dfgls_line": (lambda df: stationarity.df_gls(df, "ct", "dfgls_line"), lambda x: plain_stationarity.df_gls(x, "ct")),
    "za": (lambda df: stationarity.zivot_andrews(df), None),
}


@pytest.mark.parametrize("name", TESTS)
def test_tests_of_series_agree_with_numpy(spark, name):
    table = _series_of_all_kinds()
    frame = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in table.items()], "series string, x array<double>")
    native, plain = TESTS[name]
    rows = {r.series: r[name] for r in native(frame).select("series", name).collect()}
    compared = 0
    for k, x in table.items():
        with np.errstate(all="ignore"):
            for kind in ("c", "t", "ct") if name == "za" else ("",):
                want = plain_stationarity.quiet(plain_stationarity.zivot_andrews, x, kind) if kind else plain_stationarity.quiet(plain, x)
                got = rows[k][kind] if kind else rows[k]
                if len(x) < 20 and (want is None or got is None or (kind and got.stat is None)):
                    continue  # as many regressors as values: one of the two may find a column that depends on the others
                assert (want is None) == (got is None), (k, kind, want, got)
                if want is not None:
                    compared += 1
                    assert (got.stat if kind else got) == pytest.approx(want[0], rel=1e-8, abs=1e-8), (k, kind)
                    assert not kind or got.place == want[2]
    assert compared >= 20


def test_tests_of_series_run_without_python_workers(spark):
    plan = stationarity.test_panel(panel_of(spark, a=[1.0, 2.0, 3.0, 2.5]), pp=True, dfgls=True, za=True)._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan]


@pytest.mark.parametrize("trend", ["c", "t", "ct"])
def test_break_search_agrees_with_a_regression_a_place(trend):
    x = np.cumsum(np.random.default_rng(4).normal(size=150)) + np.where(np.arange(150) > 90, 6.0, 0.0)
    stat, _, place = plain_stationarity.zivot_andrews(x, trend)
    found = {}
    for lags in range(14):  # the number of lags is one of these
        d = np.diff(x)
        y, level = d[lags:], x[lags:-1]
        time = np.arange(lags + 1, len(x))
        before = [d[lags - k : len(d) - k] for k in range(1, lags + 1)]
        for b in range(max(22, lags + 2), 127):
            broken = {"c": [time > b], "t": [np.maximum(time - b, 0)], "ct": [time > b, np.maximum(time - b, 0)]}[trend]
            z = np.column_stack([level, np.ones(len(y)), time, *broken, *before]).astype(float)
            beta, rss = np.linalg.lstsq(z, y, rcond=None)[:2]
            error = math.sqrt(rss[0] / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
            found[lags, b] = beta[0] / error
    least = [min(((t, b) for (k, b), t in found.items() if k == lags)) for lags in range(14)]
    assert any(stat == pytest.approx(t, rel=1e-8) and place == b for t, b in least)
    assert plain_stationarity.quiet(plain_stationarity.zivot_andrews, np.ones(60), trend) is None


def _of_numbers(spark, numbers, f):
    frame = spark.createDataFrame([(i, float(t)) for i, t in enumerate(numbers)], "i int, t double")
    return [r.p for r in frame.select("i", text.expr(f(text.col("t"))).alias("p")).orderBy("i").collect()]


def test_published_critical_values(spark):
    at_5, at_1, low, high = _of_numbers(spark, [-2.86, -3.43, -20, 3], stationarity.mackinnon_p)
    assert at_5 == pytest.approx(0.05, abs=0.002) and at_1 == pytest.approx(0.01, abs=0.001) and (low, high) == (0, 1)


def test_p_values_pass_through_the_critical_values(spark):
    for kind, critical in null_tables.ZA_PUBLISHED.items():
        table = null_tables.za_quantiles(kind)
        points = [*critical, table[0] - 2, table[-1] + 0.5, 0.0]
        got = _of_numbers(spark, points, lambda t: stationarity.tail_p(t, table))  # noqa: B023
        assert got[:3] == pytest.approx(null_tables.PUBLISHED_P, abs=1e-9) and got[3] < 0.001 and 0.999 < got[4] <= got[5] < 1
        assert got == pytest.approx([plain_stationarity.tail_p(t, table, null_tables.PROBABILITIES) for t in points], rel=1e-9)
        assert table == sorted(table)
    for n in (25, 50, 100, 200, 1e9):
        table = null_tables.gls_quantiles(n)
        assert table == sorted(table)
    assert _of_numbers(spark, null_tables.GLS_PUBLISHED, lambda t: stationarity.tail_p(t, table)) == pytest.approx(null_tables.PUBLISHED_P, abs=1e-6)


def test_tables_of_p_values_are_those_of_random_walks():
    at = [null_tables.PROBABILITIES.index(p) for p in (0.05, 0.1, 0.5, 0.9)]
    walks = null_tables.break_statistics(400, 6000, 5)
    for kind, found in walks.items():
        assert np.quantile(found, (0.05, 0.1, 0.5, 0.9)) == pytest.approx(np.array(null_tables.ZA_SIMULATED[kind])[at], abs=0.09)
    for n in (50, 100, 200):
        found = null_tables.gls_statistics(n, 60_000, n)
        for p in null_tables.PUBLISHED_P:
            k = null_tables.PROBABILITIES.index(p)
            assert np.mean(found <= null_tables.gls_quantiles(n)[k]) == pytest.approx(p, abs=0.006)


def test_simulated_breaks_are_the_statistic_without_lags():
    n, seed = 60, 8
    d = np.random.default_rng(seed).normal(size=(2000, n - 1))[:3]
    got = null_tables.break_statistics(n, 3, seed)
    time = np.arange(1, n, dtype=float)
    for walk in range(3):
        x = np.cumsum(d[walk]) - d[walk]
        for kind in ("c", "t", "ct"):
            found = []
            for b in range(9, 51):
                broken = {"c": [time > b], "t": [np.maximum(time - b, 0)], "ct": [time > b, np.maximum(time - b, 0)]}[kind]
                z = np.column_stack([x, np.ones(n - 1), time, *broken]).astype(float)
                beta, rss = np.linalg.lstsq(z, d[walk], rcond=None)[:2]
                found.append(beta[0] / math.sqrt(rss[0] / (n - 1 - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0]))
            assert got[kind][walk] == pytest.approx(min(found), rel=1e-8)


def test_the_normal_distribution_and_the_triangle(spark):
    z = [-9.5, -8, -5.5, -3, -1, -1e-9, 0, 0.3, 2, 6, 9.5]
    got = _of_numbers(spark, z, linear.normal_cdf)
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rel=1e-12, abs=1e-15)
    m = np.cov(np.random.default_rng(2).normal(size=(4, 40)))
    frame = spark.createDataFrame([([[float(v) for v in r] for r in m],)], "m array<array<double>>")
    rows = frame.select(text.expr(linear.cholesky(text.col("m"), text.array(2, 0, 3))).alias("l")).first().l
    want = np.linalg.cholesky(m[np.ix_([2, 0, 3], [2, 0, 3])])
    assert [len(r) for r in rows] == [1, 2, 3] and np.concatenate(rows) == pytest.approx(want[np.tril_indices(3)])


def test_decision_rule(spark):
    rows = spark.createDataFrame([(0.01, 0.10), (0.5, 0.01), (0.01, 0.01), (0.5, 0.1), (None, 0.1)], "a double, k double")
    assert [r.d for r in rows.select(stationarity.decision("a", "k").alias("d")).collect()] == ["stationary", "non-stationary", "inconclusive", "inconclusive", "inconclusive"]


def test_stl_separates_a_season(spark):
    t = np.arange(120)
    season = np.sin(2 * np.pi * t / 12)
    y = 0.05 * t + season
    got, trend = seasonal.stl(y)
    assert np.abs(got - season)[12:-12].max() < 0.05 and np.abs(trend - 0.05 * t)[12:-12].max() < 0.05
    out = seasonal.deseasonalise(panel_of(spark, a=[float(v) for v in y], short=[1.0] * 120)).where("series = 'a'")
    assert out.count() == 120
    with pytest.raises(EnvironmentError):
        seasonal.external_adjustment(panel_of(spark, a=[1.0]), "no-such-program")


@pytest.mark.parametrize("n,span", [(40, 7), (40, 12), (9, 13), (5, 5), (1, 7)])
@pytest.mark.parametrize("degree", [0, 1])
def test_local_regression_agrees_with_one_over_all_places(n, span, degree):
    rng = np.random.default_rng(n)
    y, rho, x = rng.normal(size=n), rng.uniform(0.1, 1, size=n), np.arange(n)
    at = np.arange(-1, n + 1, dtype=float)
    for place, got in zip(at, seasonal.loess(y, span, at, rho, degree), strict=True):
        far = np.abs(x - place)
        reach = np.sort(far)[min(span, n) - 1] + max(span - n, 0) // 2
        w = rho * np.clip(1 - (far / max(reach, 1e-12)) ** 3, 0, None) ** 3
        if w.sum() > 1e-12 and (np.count_nonzero(w) > 1 or degree == 0):
            w = w / w.sum()
            mean = w @ x
            slope = w @ ((x - mean) * y) / (w @ (x - mean) ** 2) if degree else 0.0
            assert got == pytest.approx(w @ y + slope * (place - mean), abs=1e-9)


def test_an_external_program_is_run_for_every_series(spark, tmp_path):
    program = tmp_path / "adjust"
    program.write_text("""#!/usr/bin/env python3
import re, sys
spec = open(sys.argv[1] + ".spc").read()
year, month = map(int, re.search(r"start=(\\d+)\\.(\\d+)", spec).groups())
values = [float(x) for x in re.search(r"data=\\((.*?)\\)", spec)[1].split()]
if len(values) > 1:
    with open(sys.argv[1] + ".d11", "w") as out:
        out.write("date\\tx\\n------\\t-----\\n")
        for i, v in enumerate(values):
            k = year * 12 + month - 1 + i
            out.write(f"{k // 12}{k % 12 + 1:02d}\\t{v - 1}\\n")
""".replace("\\\\", "\\"))
    program.chmod(0o755)
    out = seasonal.external_adjustment(panel_of(spark, a=[float(v) for v in range(14)], short=[1.0]), str(program))
    assert values(out, "a", "adjusted") == [v - 1.0 for v in range(14)] and values(out, "a", "seasonal") == [1.0] * 14
    assert values(out, "short", "adjusted") == [None]


def test_daily_sums_of_a_stream(spark, tmp_path):
    from panelwright.streaming.arrivals import daily_sums

    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-09 00:00:00", "a", 4.0)], "ts string, series string, value double").selectExpr("cast(ts as timestamp) ts", "series", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = daily_sums(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lateness="1 day")
    query = stream.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {str(r.sasdate): r.value for r in spark.table("sums").collect()} == {"2024-01-01": 3.0, "2024-01-09": 4.0}


def test_window_plan_has_one_exchange(spark):
    panel = panel_of(spark, a=[1.0, 2.0], b=[3.0, 4.0])
    plan = transforms.standardise(transforms.apply_code(panel, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(series") == 1


# ------------------------------------------------------------ long series, runs and correlations


def _long(spark, n, seed=3):
    """Two series of n days, a third of the values missing, one series much shorter."""
    from pyspark.sql import functions as F

    rows = spark.range(n).select(F.lit("hot").alias("series"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("sasdate"), F.when(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)) > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 + 0.5).alias("value"))
    return rows.unionByName(rows.where("sasdate < DATE '1900-02-10'").withColumn("series", F.lit("short")))


@pytest.mark.parametrize("days", [3, 50, 100_000])
def test_chunks_change_no_transformation(spark, days):
    panel = _long(spark, 400)
    for code in range(1, 8):
        for mode in transforms.MODES:
            assert transforms.apply_code(panel, code, mode, chunk_days=days).exceptAll(transforms.apply_code(panel, code, mode)).count() == 0
    for kind in ("diff", "yoy"):
        got = transforms.extra_transform(panel, kind, chunk_days=days)
        assert got.count() == panel.count() and got.exceptAll(transforms.extra_transform(panel, kind)).count() == 0
    codes = taxonomies.codes(spark, {"hot": 7, "short": 6})
    assert transforms.transform_by_codes(panel, codes, chunk_days=days).exceptAll(transforms.transform_by_codes(panel, codes)).count() == 0


def test_one_long_series_is_many_tasks(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = transforms.apply_code(_long(spark, 300_000), 7, chunk_days=4096)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) == 4 and max(tasks) < 0.5 * sum(tasks)


@given(st.lists(st.booleans(), max_size=30), st.lists(st.integers(0, 30), max_size=4))
@settings(max_examples=25, deadline=None)
def test_run_summaries_of_parts_add_up(spark, gone, cuts):
    from pyspark.sql import functions as F

    bounds = sorted({0, len(gone), *[min(c, len(gone)) for c in cuts]})
    parts = [[(months(1)[0], g) for g in gone[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)] or [[]]
    frame = spark.createDataFrame([(parts,)], "parts array<array<struct<sasdate:date,gone:boolean>>>")
    folded = F.aggregate("parts", missing._counts(0, 0, 0, 0, 0, 0), lambda a, p: missing.merged_runs(a, missing._run_summary(p)))
    got = frame.select(folded.alias("s")).select("s.*").first()
    runs = [(k, len(list(g))) for k, g in itertools.groupby(gone)]
    lead = runs[0][1] if runs and runs[0][0] else 0
    trail = runs[-1][1] if runs and runs[-1][0] else 0
    inner = max([n for k, n in runs[1:-1] if k], default=0)
    assert tuple(got) == (len(gone), sum(gone), lead, trail, inner, sum(k for k, _ in runs))


def test_runs_over_chunks_and_without_a_sort(spark):
    panel = _long(spark, 500)
    rows = panel.where("series = 'hot'").orderBy("sasdate").collect()
    want, before = [], None
    for r in rows:
        if r.value is None:
            want = want[:-1] + [(want[-1][0], r.sasdate, want[-1][2] + 1)] if before else want + [(r.sasdate, r.sasdate, 1)]
        before = r.value is None
    for days in (2, 64, 100_000):
        chunk = chunks.chunk_of
        missing.chunk_of = lambda: chunk(days)  # noqa: B023
        try:
            got = sorted((r.start, r.end, r.length) for r in missing.missing_runs(panel).where("series = 'hot'").collect())
            plan = missing.gap_measures(panel)._jdf.queryExecution().executedPlan().toString()
        finally:
            missing.chunk_of = chunk
        assert got == want and "Sort " not in plan and "Window" not in plan


@pytest.mark.parametrize(("series", "dates"), [(1000, 1000), (2, 3), (1, 40)])
def test_correlations_by_blocks(spark, series, dates):
    rng = np.random.default_rng(6)
    table = {f"s{i}": [None if rng.random() < 0.3 else float(1e6 + rng.normal() * (i + 1)) for _ in range(40)] for i in range(6)} | {"flat": [2.0] * 40, "once": [1.0] + [None] * 39}
    got = {(r.a, r.b): (r.n, r["corr"]) for r in describe.correlations(panel_of(spark, **table), series, dates).collect()}
    frame = pd.DataFrame(table, dtype=float)
    for a in table:
        for b in table:
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            if a <= b and len(both):
                n, corr = got.pop((a, b))
                want = np.nan if "flat" in (a, b) or len(both) < 2 else both.iloc[:, 0].corr(both.iloc[:, -1])
                assert n == len(both) and ((corr is None and np.isnan(want)) or corr == pytest.approx(want, abs=1e-9))
    assert not got


def test_nearest_dates_of_a_table(spark):
    days = [date(1990, 1, 1), date(1990, 3, 1), date(2005, 6, 15)]
    panel = panel_of(spark, a=[1.0]).limit(0).unionByName(spark.createDataFrame([("a", d, 1.0) for d in days], PANEL))
    asked = [date(1980, 1, 1), date(1990, 1, 30), date(1990, 1, 31), date(1990, 3, 1), date(1997, 10, 22), date(1997, 10, 23), date(2030, 1, 1)]
    frame = spark.createDataFrame([(d,) for d in asked + asked[:2]] + [(None,)], "asked date")
    want = {d: min(days, key=lambda p: (abs((p - d).days), p)) for d in asked}
    for span in (5, 400, 100_000):
        got = calendar.nearest_dates(frame, panel, days=span).collect()
        assert {r.asked: r.sasdate for r in got} == want and len(got) == len(want)
    assert [r.sasdate for r in calendar.nearest_dates(frame, panel.limit(0)).collect()] == [None] * len(want)


# ------------------------------------------------------------ vintages


def test_payloads_are_read_by_tasks_one_a_series(spark, tmp_path):
    for name, value in (("one", "1.5"), ("two", ".")):
        (tmp_path / name).write_text(json.dumps({"observations": [{"date": "2000-01-01", "value": value}]}))
    url = tmp_path.as_uri() + "/{series}"
    read = vintages.read_payloads(spark, ["one", "two"], url)
    assert read.rdd.getNumPartitions() == 2
    got = observations.parse_observations(read)
    assert values(got, "one") == [1.5] and values(got, "two") == [None]
    with pytest.raises(Exception, match="no answer"):
        vintages.read_payloads(spark, ["three"], url, pause=0.01, retries=1).collect()
    with pytest.raises(Exception, match="must be given"):
        spark.read.format("payloads").load().collect()


def test_vintages_of_one_month_are_told_apart(spark):
    jan, feb = months(2)
    day = lambda m, d: date(2000, m, d)
    rows = [("g", jan, 1.0, day(2, 1)), ("g", jan, 1.0, day(2, 20)), ("g", jan, 2.0, day(3, 1)), ("g", jan, None, day(5, 1)), ("g", feb, 5.0, day(3, 1)), ("g", feb, 4.0, day(3, 1)), ("g", feb, 9.0, None)]
    frame = spark.createDataFrame(rows, "series string, sasdate date, value double, known_from date")
    want = {day(1, 31): {}, day(2, 1): {jan: 1.0}, day(2, 29): {jan: 1.0}, day(3, 1): {jan: 2.0, feb: 5.0}, day(4, 30): {jan: 2.0, feb: 5.0}, date(2003, 1, 1): {jan: None, feb: 5.0}}
    for d, panel in want.items():
        assert {r.sasdate: r.value for r in vintages.as_of(frame, d).collect()} == panel
    each = vintages.as_of_each(frame, spark.createDataFrame([(d,) for d in [*want, *want, None]], "day date")).collect()
    assert sorted((r.day, r.sasdate) for r in each) == sorted((d, m) for d, panel in want.items() for m in panel)
    assert all(r.value == want[r.day][r.sasdate] for r in each)
    assert [(r.value, r.known_from, r.known_until) for r in vintages.changes(frame).where(f"sasdate = '{jan}'").orderBy("known_from").collect()] == [(1.0, day(2, 1), day(3, 1)), (2.0, day(3, 1), day(5, 1)), (None, day(5, 1), None)]
    assert vintages.as_of_each(frame.limit(0), spark.createDataFrame([(jan,)], "day date")).collect() == []


# ------------------------------------------------------------ jobs on any path


def test_jobs_write_to_paths_of_spark_alone(spark, tmp_path):
    out = (tmp_path / "jobs").as_uri()
    panel = panel_of(spark, a=[float(i) for i in range(60)], gap=[None] * 40 + [1.0] * 20)
    found = pipelines.build_variants(panel, out, {"late": "2001-01-01"}, variants.Rules(coverage=0.5, train_years=2, holdout_months=6, min_train=12))["late"]
    assert files.read_json(spark, f"{out}/late_catalog.json") == found
    assert set(found["artifacts"]) == {"panel_parquet", "panel_csv_index", "panel_csv_with_sasdate_col", "catalog_json"}
    one, two = (files.read_panel_csv(spark, found["artifacts"][k], date_format="MM/dd/yyyy") for k in ("panel_csv_index", "panel_csv_with_sasdate_col"))
    assert one.count() == 48 and one.exceptAll(two).count() == 0
    info = pipelines.report_missing(panel, f"{out}/report")
    assert files.read_json(spark, f"{out}/report/panel_missing_catalog.json") == info
    with pytest.raises(FileExistsError):
        files.write_json({}, f"{out}/late_catalog.json")
    files.write_json({"b": 1}, f"{out}/late_catalog.json", overwrite=True)
    assert files.read_json(spark, f"{out}/late_catalog.json") == {"b": 1}
    counts = pipelines.report_stationarity(panel, f"{out}/tests")
    assert sum(counts.values()) == 2 and set(counts) <= {"stationary", "non-stationary", "inconclusive"}


def test_a_report_reads_its_panel_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    panel = panel_of(spark, a=[1.0, None, 2.0], b=[1.0, 2.0, None]).mapInArrow(counted, PANEL)
    pipelines.report_missing(panel, str(tmp_path / "report"))
    assert read.value == 6


def test_configurations_and_downloads(spark, tmp_path, monkeypatch):
    for name, data in (("utf8", "a: ü".encode()), ("marked", "a: ü".encode("utf-8-sig")), ("windows", "a: ü".encode("cp1252"))):
        (tmp_path / name).write_bytes(data)
        assert files.read_config((tmp_path / name).as_uri()) == {"a": "ü"}
    (tmp_path / "empty").write_bytes(b"")
    assert files.read_config(str(tmp_path / "empty")) == {}
    fetched = []
    monkeypatch.setattr(observations, "fetch", lambda url, timeout: fetched.append(url) or "sasdate,x\n1/1/2000,1")
    path = (tmp_path / "store" / "x.csv").as_uri()
    assert observations.download("http://x", path) == path and observations.download("http://x", path) == path and fetched == ["http://x"]
    assert files.read_panel_csv(spark, path).collect()[0].value == 1.0
    observations.download("http://y", path, overwrite=True)
    assert fetched == ["http://x", "http://y"]


def test_a_dry_run_writes_nothing(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("sasdate,A\nTransform:,2\n1/1/2000,1\n2/1/2000,3\n")
    out = pipelines.build_transformed_panel(spark, str(tmp_path / "raw.csv"), str(tmp_path / "panel"), dry_run=True)
    assert values(out, "A") == [None, 2.0] and not (tmp_path / "panel").exists()


@pytest.mark.parametrize(("balance", "scans"), [("none", 1), ("initial", 2)])
def test_factor_panels_scan_their_panel_at_most_twice(spark, tmp_path, balance, scans):
    panel_of(spark, a=[1.0, None, 2.0], b=[1.0, 2.0, 3.0]).write.parquet(str(tmp_path / "p"))
    dense = calendar.densify(spark.read.parquet(str(tmp_path / "p")), date(2000, 1, 1), date(2000, 3, 1))
    plan = factors.prepare_for_factors(dense, taxonomies.codes(spark, {"a": 1, "b": 2}), balance)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == scans


@pytest.mark.parametrize("digits", [6, 10])
def test_significant_digits_are_written_as_python_writes_them(spark, digits):
    rng = np.random.default_rng(9)
    numbers = [float(x) for x in rng.normal(size=1500) * 10.0 ** rng.integers(-12, 15, size=1500)]
    numbers += [0.0, 1.0, -1.0, 100.0, 1e9, 1e10, 123456.0, 999999.96, 9999999999.7, 0.0001, 0.00001, 1e300, -2.5e-300, 0.1, 1234567.0]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)] + [(-1, None), (-2, float("nan"))], "i int, x double")
    got = {r.i: r.t for r in frame.select("i", significant(frame.x, digits).alias("t")).collect()}
    assert got.pop(-1) == "" and got.pop(-2) == ""
    assert [got[i] for i in range(len(numbers))] == [f"{x:.{digits}g}" for x in numbers]
    assert "Python" not in frame.select(significant(frame.x, digits))._jdf.queryExecution().toString()


def test_quantiles_are_exact_and_sort_few_values_of_a_long_series(spark):
    rng = np.random.default_rng(8)
    data = {f"s{n}": [float(v) for v in rng.integers(-3, 4, n)] for n in range(1, 40)} | {"same": [2.5] * 90, "none": [None, None]}
    panel = panel_of(spark, **data).union(spark.createDataFrame([(None, None, 7.0), (None, None, 9.0)], "series string, sasdate date, value double"))
    got = {r.series: (r.q25, r.q50, r.q75) for r in describe.describe(panel).collect()}
    assert got.pop(None) == (7.5, 8.0, 8.5) and got.pop("none") == (None, None, None)
    assert set(got) == set(data) - {"none"}
    for name, quartiles in got.items():
        assert quartiles == pytest.approx(np.quantile(data[name], (0.25, 0.5, 0.75)), abs=1e-12)
    assert describe.quantiles(panel.limit(0)).count() == 0

    n = 300_000
    hot = spark.range(n, numPartitions=8).selectExpr("'hot' AS series", "CAST(NULL AS DATE) AS sasdate", "CASE WHEN id % 3 = 0 THEN 0D ELSE hash(id) / 1000D END AS value")
    values = np.array([r.value for r in hot.select("value").collect()])
    at = (0.0, 0.1, 0.5, 0.999, 1.0)
    assert describe.quantiles(hot, at).first().q == pytest.approx(np.quantile(values, at), rel=1e-12)
    assert describe._near_ranks(hot, (0.25, 0.75), 0.001, 64).count() < 0.01 * n
