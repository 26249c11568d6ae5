"""Training windows by coverage, and the choice of series by gap rules."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.calendar import since
from panelwright.operators.missing import coverage, gap_measures


@dataclass(frozen=True)
class Rules:
    """Limits of the choice. A series goes if it is beyond the first of them, in this order: share, leading, gap, observations."""

    coverage: float = 0.75
    train_years: int = 30
    holdout_months: int = 60
    min_run: int = 12
    missing_share: float = 0.40
    leading: int = 24
    interior: int = 6
    min_train: int = 36


def rolling_coverage(panel: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(sasdate, place, coverage, ok): ok where the last ``min_run`` months all reach the coverage. One row a month."""
    order = Window.orderBy("sasdate")
    run = order.rowsBetween(-(rules.min_run - 1), 0)
    placed = coverage(panel).withColumn("place", F.row_number().over(order) - 1)
    low = F.when(F.count("*").over(run) == rules.min_run, F.min("coverage").over(run))
    return placed.withColumn("ok", F.coalesce(low >= rules.coverage, F.lit(False)))


def training_window(panel: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: first_ok, branch (rolling, single or fallback), train_start, train_end.

    first_ok ends the first run of enough coverage; without one it is the first month of
    enough coverage, else the min_run-th month. Training ends before the holdout months
    and is at most train_years long, but not before first_ok; where that leaves nothing
    it is the min_run months from first_ok.
    """
    months = rolling_coverage(panel, rules)
    found = months.agg(
        F.min(F.when(F.col("ok"), F.col("place"))).alias("rolling"),
        F.min(F.when(F.col("coverage") >= rules.coverage, F.col("place"))).alias("single"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list("sasdate")).alias("dates"),
    ).where("n > 0")
    first = F.coalesce("rolling", "single", F.least(F.lit(rules.min_run - 1), F.col("n") - 1))
    branch = F.when(F.col("rolling").isNotNull(), "rolling").when(F.col("single").isNotNull(), "single").otherwise("fallback")
    found = found.withColumns({"first": first.cast("int"), "branch": branch, "stop": F.greatest(F.lit(0), F.col("n") - rules.holdout_months - 1).cast("int")})
    found = found.withColumn("begin", F.greatest("first", F.col("stop") - 12 * rules.train_years + 1))
    late = F.col("begin") > F.col("stop")
    start = F.when(late, F.col("first")).otherwise(F.col("begin"))
    end = F.when(late, F.least(F.col("first") + rules.min_run - 1, F.col("n").cast("int") - 1)).otherwise(F.col("stop"))
    at = lambda place: F.get("dates", place)
    return found.select(at(F.col("first")).alias("first_ok"), "branch", at(start).alias("train_start"), at(end).alias("train_end"))


def decisions(panel: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per series: the four measures, kept, and the reason of a series that goes. One exchange on the series, apart from the window's months."""
    inside = panel.join(F.broadcast(training_window(panel, rules)))  # one row
    in_training = F.count(F.when(F.col("sasdate").between(F.col("train_start"), F.col("train_end")), F.col("value")))
    out = gap_measures(inside, in_training).withColumn("missing_share", F.col("n_missing") / F.col("n_rows")).withColumnRenamed("more_0", "nobs_train")
    reason = (
        F.when(F.col("missing_share") > rules.missing_share, "missing_share")
        .when(F.col("lead_gap") > rules.leading, "leading")
        .when(F.col("gap") > rules.interior, "interior_gap")
        .when(F.col("nobs_train") < rules.min_train, "nobs_train")
    )
    return out.select("series", "missing_share", "nobs_train", "lead_gap", "gap", reason.alias("reason")).withColumn("kept", F.col("reason").isNull())


def build_variant(panel: DataFrame, anchor, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """(panel of the kept series from the anchor on, decisions)."""
    part = since(panel, anchor)
    chosen = decisions(part, rules)
    return part.join(chosen.where("kept").select("series"), "series", "left_semi"), chosen


def parse_variants(items: list[str]) -> dict[str, str]:
    """Variants written as NAME=MM/DD/YYYY: first dates by name."""
    out = {}
    for item in items:
        name, found, anchor = item.partition("=")
        if not found or not name:
            raise ValueError(f"{item!r} is not NAME=MM/DD/YYYY")
        out[name] = datetime.strptime(anchor, "%m/%d/%Y").date().isoformat()
    return out


def catalog(name: str, anchor, panel: DataFrame, chosen: DataFrame, rules: Rules, anchored: DataFrame | None = None, source: str | None = None, artifacts: dict | None = None) -> dict:
    """What a variant is, for its JSON file. One row a series is gathered.

    panel is what is kept; anchored, all series from the anchor on, gives the training
    window (panel itself where it is not passed). Reasons are written with their limits.
    """
    whole = panel if anchored is None else anchored
    window = training_window(whole, rules).first()
    span = whole.agg(F.min("sasdate"), F.max("sasdate")).first()
    rows = chosen.orderBy("series").collect()
    day = lambda d: d.strftime("%m/%d/%Y") if d else None
    reasons = {"missing_share": f"missing_share>{rules.missing_share:.2f}", "leading": f"leading_na>{rules.leading}", "interior_gap": f"interior_gap>{rules.interior}", "nobs_train": f"nobs_train<{rules.min_train}"}
    return {
        "input_csv": source,
        "variant": name,
        "anchor_start": day(date.fromisoformat(str(anchor))),
        "train_window": [day(window.train_start), day(window.train_end)] if window else None,
        "rules": {"missing_share_max": rules.missing_share, "leading_na_limit_months": rules.leading, "interior_gap_max_months": rules.interior, "min_obs_train_months": rules.min_train, "leading_ref": "anchor_start"},
        "training_window_selection": {"cov_thresh": rules.coverage, "train_years": rules.train_years, "holdout_months": rules.holdout_months, "min_run_consecutive": rules.min_run, "anchored_span": [day(d) for d in span]},
        "n_rows": whole.select("sasdate").distinct().count(),
        "n_series": sum(r.kept for r in rows),
        "kept_series": [r.series for r in rows if r.kept],
        "dropped_series": {r.series: {"missing_share": r.missing_share, "leading_na_since_anchor": r.lead_gap, "interior_gap_months": r.gap, "nobs_train": r.nobs_train, "drop_reason": reasons[r.reason]} for r in rows if not r.kept},
        "artifacts": artifacts or {},
    }
