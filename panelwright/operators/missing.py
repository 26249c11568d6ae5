"""What is missing where: flags, counts, positions and runs of a dense panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.calendar import between
from panelwright.operators.chunks import chunk_of


def _gone() -> Column:
    return F.col("value").isNull()


def boundaries(panel: DataFrame, first=None, second=None, last=None) -> DataFrame:
    """One row (first, second, last, notes). A date that is asked for but not there falls back to its place, with a note."""
    dates = panel.select("sasdate").distinct()
    ends = dates.agg(F.min("sasdate").alias("a"), F.max("sasdate").alias("z"), F.array_sort(F.collect_set("sasdate")).alias("all"))
    found = {"first": F.col("a"), "second": F.coalesce(F.get("all", F.lit(1)), F.col("a")), "last": F.col("z")}
    columns, notes = [], []
    for name, asked in (("first", first), ("second", second), ("last", last)):
        if asked is None:
            columns.append(found[name].alias(name))
        else:
            date = F.lit(asked).cast("date")
            there = F.array_contains("all", date)
            columns.append(F.when(there, date).otherwise(found[name]).alias(name))
            notes.append(F.when(~there, F.lit(f"{name} date {asked} is not in the panel")))
    return ends.select(*columns, F.array_compact(F.array(*notes)).cast("array<string>").alias("notes"))


def missing_by_series(panel: DataFrame, first=None, second=None, last=None) -> DataFrame:
    """Per series: rows, missing rows, and flags at the panel's first, second and last date and between them."""
    bounds = boundaries(panel, first, second, last)
    at = panel.join(F.broadcast(bounds))  # one row
    flag: dict[str, Column] = {name: F.coalesce(F.bool_or((F.col("sasdate") == F.col(name)) & _gone()), F.lit(False)) for name in ("first", "second", "last")}
    inner = F.count_if((F.col("sasdate") > F.col("second")) & (F.col("sasdate") < F.col("last")) & _gone())
    out = at.groupBy("series").agg(
        F.count("*").alias("n_rows"),
        F.count_if(_gone()).alias("n_missing"),
        (F.count_if(_gone()) / F.count("*") * 100).alias("pct_missing"),
        flag["first"].alias("miss_first"),
        flag["second"].alias("miss_second"),
        (flag["first"] & flag["second"]).alias("miss_both_first_two"),
        (flag["first"] | flag["second"]).alias("miss_any_first_two"),
        inner.alias("n_missing_intermediate"),
        flag["last"].alias("miss_last"),
    )
    return out.withColumn("miss_intermediate", F.col("n_missing_intermediate") > 0)


def missing_summary(report: DataFrame) -> DataFrame:
    """One row over missing_by_series: series, and how many and which have each flag."""
    flags = {"first": "miss_first", "second": "miss_second", "both_first_two": "miss_both_first_two", "any_first_two": "miss_any_first_two", "intermediate": "miss_intermediate", "last": "miss_last"}
    counts = [F.count_if(c).alias(f"n_{k}") for k, c in flags.items()]
    names = [F.array_sort(F.collect_list(F.when(F.col(c), F.col("series")))).alias(f"series_{k}") for k, c in flags.items()]
    return report.agg(F.count("*").alias("n_series"), *counts, *names)


_COUNTS = ("rows", "gone", "lead", "trail", "inner", "runs")


def _counts(*values) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, int) else v).cast("long").alias(k) for k, v in zip(_COUNTS, values, strict=True)])


def merged_runs(a: Column, b: Column) -> Column:
    """The summary of the rows of a followed by those of b: rows, missing rows, the missing ones before the first value, after the last one, the longest run between two values, and runs. Associative; no row at all is its zero."""
    a_gone, b_gone = a["gone"] == a["rows"], b["gone"] == b["rows"]
    meeting = F.when(a_gone | b_gone, 0).otherwise(a["trail"] + b["lead"])
    return _counts(
        a["rows"] + b["rows"],
        a["gone"] + b["gone"],
        a["lead"] + F.when(a_gone, b["lead"]).otherwise(0),
        b["trail"] + F.when(b_gone, a["trail"]).otherwise(0),
        F.greatest(a["inner"], b["inner"], meeting),
        a["runs"] + b["runs"] - F.when((a["trail"] > 0) & (b["lead"] > 0), 1).otherwise(0),
    )


def _chunks(panel: DataFrame, *more: Column) -> DataFrame:
    """(series, chunk, cells, ...): the dates of a chunk's rows in order and whether they are missing, and aggregates of its rows."""
    cell = F.struct("sasdate", _gone().alias("gone"))
    return panel.groupBy("series", chunk_of().alias("chunk")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), *more)


def _run_summary(cells: Column) -> Column:
    leaf = lambda c: F.when(c["gone"], _counts(1, 1, 1, 1, 0, 1)).otherwise(_counts(1, 0, 0, 0, 0, 0))
    return F.aggregate(cells, _counts(0, 0, 0, 0, 0, 0), lambda a, c: merged_runs(a, leaf(c)))


def run_summaries(panel: DataFrame, **more: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """Per series, the summary of merged_runs; and for each of ``more`` an aggregate of a chunk's rows, and the aggregate of these.

    Rows are folded in chunks, and the chunks' summaries, a few numbers each, by series.
    Nothing is sorted but the rows within a chunk; a panel that is dealt by series is not
    dealt again.
    """
    chunks = _chunks(panel, *[c.alias(name) for name, (c, _) in more.items()])
    parts = chunks.select("series", F.struct("chunk", _run_summary(F.col("cells")).alias("part")).alias("part"), *more)
    out = parts.groupBy("series").agg(F.array_sort(F.collect_list("part")).alias("parts"), *[f(name).alias(name) for name, (_, f) in more.items()])
    whole = F.aggregate("parts", _counts(0, 0, 0, 0, 0, 0), lambda a, p: merged_runs(a, p["part"]))
    return out.select("series", whole.alias("s"), *more).select("series", "s.*", *more)


def _runs_of(cells: Column) -> Column:
    """The runs of missing rows of a chunk: start, end, length, and the values before them."""

    def step(a: Column, c: Column) -> Column:
        last = F.try_element_at(a["runs"], F.lit(-1))
        go_on = (F.size(a["runs"]) > 0) & (last["before"] == a["values"])
        run = F.struct(F.when(go_on, last["start"]).otherwise(c["sasdate"]).alias("start"), c["sasdate"].alias("end"), (F.when(go_on, last["length"]).otherwise(0) + 1).cast("long").alias("length"), a["values"].alias("before"))
        kept = F.when(go_on, F.slice(a["runs"], 1, F.size(a["runs"]) - 1)).otherwise(a["runs"])
        return F.struct((a["values"] + F.when(c["gone"], 0).otherwise(1)).cast("long").alias("values"), F.when(c["gone"], F.concat(kept, F.array(run))).otherwise(a["runs"]).alias("runs"))

    none = F.array().cast("array<struct<start:date,end:date,length:bigint,before:bigint>>")
    return F.aggregate(cells, F.struct(F.lit(0).cast("long").alias("values"), none.alias("runs")), step)


def missing_runs(panel: DataFrame, start=None, end=None) -> DataFrame:
    """(series, start, end, length) of every run of missing rows; a series without gaps has none.

    Runs of a chunk are named by the values of the series before them, so runs that meet
    at the end of a chunk become one.
    """
    chunks = _chunks(between(panel, start, end)).select("series", "chunk", _runs_of(F.col("cells")).alias("found")).select("series", "chunk", "found.*")
    counts = chunks.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("chunk", "values"))).alias("all"))
    before = lambda all_, c: F.aggregate(F.filter(all_, lambda x: x["chunk"] < c["chunk"]), F.lit(0).cast("long"), lambda a, x: a + x["values"])
    offsets = counts.select("series", F.explode(F.transform("all", lambda c: F.struct(c["chunk"].alias("chunk"), before(F.col("all"), c).alias("offset")))).alias("o")).select("series", "o.*")
    runs = chunks.join(offsets, ["series", "chunk"]).select("series", "offset", F.explode("runs").alias("r"))
    out = runs.groupBy("series", (F.col("offset") + F.col("r.before")).alias("run")).agg(F.min("r.start").alias("start"), F.max("r.end").alias("end"), F.sum("r.length").alias("length"))
    return out.drop("run")


def gap_measures(panel: DataFrame, *more: Column) -> DataFrame:
    """Per series: n_rows, n_missing, lead_gap and gap as leading_gap and interior_gap have them, and sums of ``more`` aggregates."""
    out = run_summaries(panel, **{f"more_{i}": (c, F.sum) for i, c in enumerate(more)})
    gap = F.when(F.col("gone") == F.col("rows"), F.col("rows")).otherwise(F.col("inner"))
    return out.select("series", F.col("rows").alias("n_rows"), F.col("gone").alias("n_missing"), F.col("lead").alias("lead_gap"), gap.alias("gap"), *[f"more_{i}" for i in range(len(more))])


def missing_positions(panel: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Per series: missing rows, first and last missing date, runs, the longest run, and the dates (at most ``limit``, if given)."""
    gone = F.when(_gone(), F.col("sasdate"))
    out = run_summaries(
        between(panel, start, end),
        first_missing=(F.min(gone), F.min),
        last_missing=(F.max(gone), F.max),
        missing_dates=(F.collect_list(gone), lambda c: F.array_sort(F.flatten(F.collect_list(c)))),
    )
    shown = F.col("missing_dates") if limit is None else F.slice("missing_dates", 1, limit)
    return out.select("series", F.col("rows").alias("n_rows"), F.col("gone").alias("n_missing"), (F.col("gone") / F.col("rows") * 100).alias("pct_missing"), "first_missing", "last_missing", F.col("runs").alias("n_runs"), F.greatest("lead", "trail", "inner").alias("longest_run"), shown.alias("missing_dates"))


def valid_places(panel: DataFrame) -> DataFrame:
    """Per series: rows, and the places (from 1) of the first and last value; NULL without values."""
    some = F.col("gone") < F.col("rows")
    return run_summaries(panel).select("series", F.col("rows").alias("n_rows"), F.when(some, F.col("lead") + 1).alias("first_valid"), F.when(some, F.col("rows") - F.col("trail")).alias("last_valid"))


def leading_gap(panel: DataFrame) -> DataFrame:
    """(series, lead_gap): missing rows before the first value; all rows of a series without values."""
    return gap_measures(panel).select("series", "lead_gap")


def interior_gap(panel: DataFrame) -> DataFrame:
    """(series, gap): the longest run of missing rows between the first and the last value; all rows of a series without values."""
    return gap_measures(panel).select("series", "gap")


def coverage(panel: DataFrame) -> DataFrame:
    """(sasdate, coverage): the share of series with a value."""
    return panel.groupBy("sasdate").agg((F.count("value") / F.count("*")).alias("coverage"))
