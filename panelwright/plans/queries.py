"""Registered queries over the sample tables, with SQL that says the same.

The sample panel: a series is a nation and a market segment, a month's value the sum of
its orders; months without orders are missing. Codes are 1 + nation % 7.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators import calendar, describe, factors, missing, quality, seasonal, stationarity, transforms, variants
from panelwright.functions import names, taxonomies
from panelwright.plans import stationarity_sql
from panelwright.schema import to_long, to_wide
from panelwright.sources import observations, vintages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules that keep, and drop for each reason, some series of the sample panel.
RULES = variants.Rules(coverage=0.70, train_years=3, holdout_months=12, min_run=6, missing_share=0.30, leading=1, interior=3, min_train=26)
ANCHOR = "1996-01-01"
#: Chunks of some seven months, so that lags of two and of twelve rows cross them.
CHUNK_DAYS = 200


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, nation, sasdate, value) of months with orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    return rows.groupBy(F.concat_ws("|", "n_name", "c_mktsegment").alias("series"), F.col("n_nationkey").alias("nation"), month.alias("sasdate")).agg(cents.alias("value"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense sample panel."""
    months = order_months(spark, sf_dir).select("series", "sasdate", "value")
    dates = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    start, end = dates.select(F.trunc("a", "MM"), F.trunc("z", "MM")).first()
    return calendar.densify(months, start, end)


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat_ws("|", "n_name", "c_mktsegment").alias("series"), (F.col("n_nationkey") % 7 + 1).cast("int").alias("tcode"))


_P = """
WITH raw AS (SELECT n.n_name || '|' || c.c_mktsegment AS series, any_value(n.n_nationkey) AS nation, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS sasdate,
  CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 3),
cal AS (SELECT CAST(unnest(generate_series(min(sasdate), max(sasdate), INTERVAL 1 MONTH)) AS DATE) AS sasdate FROM raw),
s AS (SELECT series, CAST(1 + any_value(nation) % 7 AS INTEGER) AS tcode FROM raw GROUP BY 1),
p AS (SELECT s.series, s.tcode, cal.sasdate, raw.value FROM s CROSS JOIN cal LEFT JOIN raw ON raw.series = s.series AND raw.sasdate = cal.sasdate)
"""
_X = (
    _P
    + """,
w AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY sasdate ROWS UNBOUNDED PRECEDING) AS f, CASE WHEN value > 0 THEN ln(value) END AS l FROM p),
x AS (SELECT *, lag(value) OVER o AS v1, lag(value, 2) OVER o AS v2, lag(value, 12) OVER o AS v12, lag(l) OVER o AS l1, lag(l, 2) OVER o AS l2,
  f / nullif(lag(f) OVER o, 0) - 1 AS g, value / nullif(lag(value) OVER o, 0) - 1 AS h FROM w WINDOW o AS (PARTITION BY series ORDER BY sasdate)),
y AS (SELECT *, lag(g) OVER o AS g1, lag(h) OVER o AS h1 FROM x WINDOW o AS (PARTITION BY series ORDER BY sasdate))
"""
)
_CODE = {1: "value", 2: "value - v1", 3: "(value - v1) - (v1 - v2)", 4: "l", 5: "l - l1", 6: "(l - l1) - (l1 - l2)", 7: "g - g1"}
_CASE = "CASE tcode " + " ".join(f"WHEN {k} THEN {e}" for k, e in _CODE.items()) + " END"
_T = _X + f", t AS (SELECT series, tcode, sasdate, {_CASE} AS value FROM y)"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("value",)})


@_query("panel_build", _P + "SELECT series, sasdate, value FROM p")
def panel_build(spark, sf_dir):
    return panel(spark, sf_dir)


@_query(
    "monthly_grid",
    _P
    + """, off AS (SELECT series, CAST(sasdate + CAST(CASE WHEN nation % 5 = 1 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS sasdate, value FROM raw),
b AS (SELECT CASE WHEN date_trunc('month', min(sasdate)) = min(sasdate) THEN min(sasdate) ELSE date_trunc('month', min(sasdate)) + INTERVAL 1 MONTH END AS a, date_trunc('month', max(sasdate)) AS z FROM off),
c AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS sasdate FROM b)
SELECT n.series, c.sasdate, off.value FROM (SELECT DISTINCT series FROM off) n CROSS JOIN c LEFT JOIN off ON off.series = n.series AND off.sasdate = c.sasdate""",
)
def grid(spark, sf_dir):
    shift = F.when(F.col("nation") % 5 == 1, 1).otherwise(0)
    return calendar.monthly_grid(order_months(spark, sf_dir).select("series", F.date_add("sasdate", shift).alias("sasdate"), "value"))


@_query("tcode_panel", _T + "SELECT series, sasdate, round(value, 6) AS value FROM t")
def tcode_panel(spark, sf_dir):
    return _rounded(transforms.transform_by_codes(panel(spark, sf_dir), codes(spark, sf_dir)))


def _one_code(code: int):
    @_query(f"tcode_{code}", _X + f"SELECT series, sasdate, round({_CODE[code]}, 6) AS value FROM y")
    def one(spark, sf_dir):
        return _rounded(transforms.apply_code(panel(spark, sf_dir), code, chunk_days=CHUNK_DAYS))


for _k in _CODE:
    _one_code(_k)


@_query("tcode_legacy7", _X + "SELECT series, sasdate, round(h - h1, 6) AS value FROM y")
def tcode_legacy7(spark, sf_dir):
    return _rounded(transforms.apply_code(panel(spark, sf_dir), 7, mode="legacy", chunk_days=CHUNK_DAYS))


@_query("extra_diff", _X + "SELECT series, sasdate, round(value - v1, 6) AS value FROM y")
def extra_diff(spark, sf_dir):
    return _rounded(transforms.extra_transform(panel(spark, sf_dir), "diff", chunk_days=CHUNK_DAYS))


@_query("extra_yoy", _X + "SELECT series, sasdate, round(value - v12, 6) AS value FROM y")
def extra_yoy(spark, sf_dir):
    return _rounded(transforms.extra_transform(panel(spark, sf_dir), "yoy", chunk_days=CHUNK_DAYS))


@_query("extra_named", _X + "SELECT series, sasdate, round(CASE series WHEN 'NATION_6|BUILDING' THEN value - v1 WHEN 'NATION_18|MACHINERY' THEN value - v12 ELSE value END, 6) AS value FROM y")
def extra_named(spark, sf_dir):
    return _rounded(transforms.extra_transform(panel(spark, sf_dir), {"NATION_6|BUILDING": " Diff", "NATION_18|MACHINERY": "yoy"}))


def _zscore(ddof: int):
    spread = "stddev_pop" if ddof == 0 else "stddev_samp"

    @_query(f"zscore_ddof{ddof}", _P + f"SELECT series, sasdate, round((value - avg(value) OVER q) / nullif({spread}(value) OVER q, 0), 6) AS value FROM p WINDOW q AS (PARTITION BY series)")
    def z(spark, sf_dir):
        return _rounded(transforms.standardise(panel(spark, sf_dir), ddof))


_zscore(0)
_zscore(1)

_FACTORS = {
    "none": "SELECT * FROM have",
    "initial": "SELECT * FROM have WHERE sasdate >= (SELECT max(d) FROM (SELECT series, min(sasdate) AS d FROM have WHERE value IS NOT NULL GROUP BY series))",
}
_FACTORS["all"] = f"SELECT * FROM ({_FACTORS['initial']}) WHERE sasdate IN (SELECT sasdate FROM ({_FACTORS['initial']}) GROUP BY sasdate HAVING count(value) = count(*))"


def _factor_query(balance: str):
    sql = _T + f""", have AS (SELECT series, sasdate, value FROM t WHERE series IN (SELECT series FROM t WHERE value IS NOT NULL)), b AS ({_FACTORS[balance]})
SELECT series, sasdate, round((value - avg(value) OVER q) / nullif(stddev_pop(value) OVER q, 0), 5) AS value FROM b WINDOW q AS (PARTITION BY series)"""

    @_query(f"factors_balance_{balance}", sql)
    def prepared(spark, sf_dir):
        return factors.prepare_for_factors(panel(spark, sf_dir), codes(spark, sf_dir), balance).withColumn("value", F.round("value", 5))


for _b in _FACTORS:
    _factor_query(_b)

# The panel of regions and segments has months in which every series has a value.
_REGIONS = """
WITH raw AS (SELECT r.r_name || '|' || c.c_mktsegment AS series, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS sasdate, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2),
cal AS (SELECT CAST(unnest(generate_series(min(sasdate), max(sasdate), INTERVAL 1 MONTH)) AS DATE) AS sasdate FROM raw),
p AS (SELECT s.series, cal.sasdate, raw.value FROM (SELECT DISTINCT series FROM raw) s CROSS JOIN cal LEFT JOIN raw ON raw.series = s.series AND raw.sasdate = cal.sasdate),
t AS (SELECT series, sasdate, value - lag(value) OVER (PARTITION BY series ORDER BY sasdate) AS value FROM p),
have AS (SELECT * FROM t WHERE series IN (SELECT series FROM t WHERE value IS NOT NULL))"""


def region_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel of regions and market segments."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    months = rows.groupBy(F.concat_ws("|", "r_name", "c_mktsegment").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("sasdate")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    start, end = orders.agg(F.trunc(F.min("o_orderdate").cast("date"), "MM"), F.trunc(F.max("o_orderdate").cast("date"), "MM")).first()
    return calendar.densify(months, start, end)


def _region_factors(spark, sf_dir, balance: str):
    months = region_panel(spark, sf_dir)
    return factors.prepare_with_info(months, months.select("series").distinct().withColumn("tcode", F.lit(2)), balance)


@_query("factors_regions_all", _REGIONS + f", b AS ({_FACTORS['all']}) SELECT series, sasdate, round((value - avg(value) OVER q) / nullif(stddev_pop(value) OVER q, 0), 5) AS value FROM b WINDOW q AS (PARTITION BY series)")
def factors_regions_all(spark, sf_dir):
    return _region_factors(spark, sf_dir, "all")[0].withColumn("value", F.round("value", 5))


@_query("factors_rows_dropped", _REGIONS + f", b AS ({_FACTORS['all']}) SELECT DISTINCT sasdate FROM t WHERE sasdate NOT IN (SELECT sasdate FROM b)")
def factors_rows_dropped(spark, sf_dir):
    return _region_factors(spark, sf_dir, "all")[1]["rows_dropped"]


@_query("factors_moments", _REGIONS + f", b AS ({_FACTORS['initial']}) SELECT series, round(avg(value), 4) AS mean, round(nullif(stddev_pop(value), 0), 4) AS std FROM b GROUP BY series")
def factors_moments(spark, sf_dir):
    return _region_factors(spark, sf_dir, "initial")[1]["moments"].withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@_query("factors_first_valid", _T + ", e AS (SELECT series, sasdate, value, row_number() OVER (PARTITION BY series ORDER BY sasdate) - 1 AS k FROM t) SELECT series, min(k) AS place FROM e WHERE value IS NOT NULL GROUP BY series")
def factors_first_valid(spark, sf_dir):
    return factors.prepare_with_info(panel(spark, sf_dir), codes(spark, sf_dir))[1]["first_valid"]


_MISSING = (
    _P
    + """, d AS (SELECT min(sasdate) AS a, (SELECT min(sasdate) FROM cal WHERE sasdate > (SELECT min(sasdate) FROM cal)) AS b, max(sasdate) AS z FROM cal),
m AS (SELECT series, count(*) AS n_rows, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*) * 100, 6) AS pct_missing,
  bool_or(sasdate = a AND value IS NULL) AS miss_first, bool_or(sasdate = b AND value IS NULL) AS miss_second,
  bool_or(sasdate = a AND value IS NULL) AND bool_or(sasdate = b AND value IS NULL) AS miss_both_first_two,
  bool_or(sasdate = a AND value IS NULL) OR bool_or(sasdate = b AND value IS NULL) AS miss_any_first_two,
  count(*) FILTER (WHERE sasdate > b AND sasdate < z AND value IS NULL) AS n_missing_intermediate, bool_or(sasdate = z AND value IS NULL) AS miss_last,
  count(*) FILTER (WHERE sasdate > b AND sasdate < z AND value IS NULL) > 0 AS miss_intermediate FROM p, d GROUP BY series)
"""
)


@_query("missing_by_series", _MISSING + "SELECT * FROM m")
def missing_by_series(spark, sf_dir):
    return _rounded(missing.missing_by_series(panel(spark, sf_dir)), "pct_missing")


_FLAGS = {"first": "miss_first", "second": "miss_second", "both_first_two": "miss_both_first_two", "any_first_two": "miss_any_first_two", "intermediate": "miss_intermediate", "last": "miss_last"}


@_query(
    "missing_summary",
    _MISSING + "SELECT count(*) AS n_series, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{k}, coalesce(string_agg(series, ',' ORDER BY series) FILTER (WHERE {c}), '') AS series_{k}" for k, c in _FLAGS.items()) + " FROM m",
)
def missing_summary(spark, sf_dir):
    out = missing.missing_summary(missing.missing_by_series(panel(spark, sf_dir)))
    return out.withColumns({f"series_{k}": F.array_join(f"series_{k}", ",") for k in _FLAGS})


_RUNS = (
    _P
    + """, i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sasdate) AS place, count(value) OVER (PARTITION BY series ORDER BY sasdate ROWS UNBOUNDED PRECEDING) AS run FROM p),
r AS (SELECT series, run, min(sasdate) AS "start", max(sasdate) AS "end", count(*) AS length, min(place) AS a, max(place) AS z FROM i WHERE value IS NULL GROUP BY series, run),
e AS (SELECT series, count(*) AS n, min(place) FILTER (WHERE value IS NOT NULL) AS first_valid, max(place) FILTER (WHERE value IS NOT NULL) AS last_valid FROM i GROUP BY series)
"""
)


@_query("missing_runs", _RUNS + 'SELECT series, "start", "end", length FROM r')
def missing_runs(spark, sf_dir):
    return missing.missing_runs(panel(spark, sf_dir))


@_query(
    "missing_positions",
    _RUNS
    + """SELECT p.series, count(*) AS n_rows, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*) * 100, 6) AS pct_missing,
min(sasdate) FILTER (WHERE value IS NULL) AS first_missing, max(sasdate) FILTER (WHERE value IS NULL) AS last_missing, coalesce(any_value(q.n), 0)::BIGINT AS n_runs, coalesce(any_value(q.m), 0)::BIGINT AS longest_run,
coalesce(string_agg(strftime(sasdate, '%Y-%m-%d'), ',' ORDER BY sasdate) FILTER (WHERE value IS NULL), '') AS missing_dates
FROM p LEFT JOIN (SELECT series, count(*) AS n, max(length) AS m FROM r GROUP BY series) q ON p.series = q.series GROUP BY p.series""",
)
def missing_positions(spark, sf_dir):
    out = missing.missing_positions(panel(spark, sf_dir))
    return _rounded(out, "pct_missing").withColumn("missing_dates", F.array_join(F.col("missing_dates").cast("array<string>"), ","))


@_query("leading_na", _RUNS + "SELECT series, coalesce(first_valid - 1, n) AS lead_gap FROM e")
def leading_na(spark, sf_dir):
    return missing.leading_gap(panel(spark, sf_dir))


@_query("interior_gap", _RUNS + "SELECT e.series, CASE WHEN any_value(first_valid) IS NULL THEN any_value(n) ELSE coalesce(max(length) FILTER (WHERE a > first_valid AND z < last_valid), 0) END::BIGINT AS gap FROM e LEFT JOIN r ON e.series = r.series GROUP BY e.series")
def interior_gap(spark, sf_dir):
    return missing.interior_gap(panel(spark, sf_dir))


@_query("valid_places", _RUNS + "SELECT series, n AS n_rows, first_valid, last_valid FROM e")
def valid_places(spark, sf_dir):
    return missing.valid_places(panel(spark, sf_dir))


@_query("coverage", _P + "SELECT sasdate, round(count(value) / count(*), 6) AS coverage FROM p GROUP BY sasdate")
def coverage(spark, sf_dir):
    return _rounded(missing.coverage(panel(spark, sf_dir)), "coverage")


_WINDOW = _P.replace("p AS (SELECT", "whole AS (SELECT") + f""", p AS (SELECT * FROM whole WHERE sasdate >= DATE '{ANCHOR}'),
c AS (SELECT sasdate, row_number() OVER (ORDER BY sasdate) - 1 AS place, count(value) / count(*) AS coverage FROM p GROUP BY sasdate),
o AS (SELECT *, coalesce(CASE WHEN count(*) OVER k = {RULES.min_run} THEN min(coverage) OVER k END >= {RULES.coverage}, false) AS ok FROM c WINDOW k AS (ORDER BY sasdate ROWS BETWEEN {RULES.min_run - 1} PRECEDING AND CURRENT ROW)),
f AS (SELECT count(*) AS n, min(place) FILTER (WHERE ok) AS r1, min(place) FILTER (WHERE coverage >= {RULES.coverage}) AS r2 FROM o),
g AS (SELECT n, coalesce(r1, r2, least({RULES.min_run - 1}, n - 1)) AS first, CASE WHEN r1 IS NOT NULL THEN 'rolling' WHEN r2 IS NOT NULL THEN 'single' ELSE 'fallback' END AS branch, greatest(0, n - {RULES.holdout_months + 1}) AS stop FROM f),
h AS (SELECT *, greatest(first, stop - {12 * RULES.train_years - 1}) AS begin FROM g),
u AS (SELECT branch, first, CASE WHEN begin > stop THEN first ELSE begin END AS a, CASE WHEN begin > stop THEN least(first + {RULES.min_run - 1}, n - 1) ELSE stop END AS z FROM h),
t AS (SELECT (SELECT sasdate FROM c WHERE place = u.first) AS first_ok, branch, (SELECT sasdate FROM c WHERE place = u.a) AS train_start, (SELECT sasdate FROM c WHERE place = u.z) AS train_end FROM u)
"""


@_query("rolling_coverage_ok", _WINDOW + "SELECT sasdate, place, round(coverage, 6) AS coverage, ok FROM o")
def rolling_coverage_ok(spark, sf_dir):
    out = variants.rolling_coverage(calendar.since(panel(spark, sf_dir), ANCHOR), RULES)
    return _rounded(out, "coverage").withColumn("place", F.col("place").cast("long"))


@_query("training_window", _WINDOW + "SELECT * FROM t")
def training_window(spark, sf_dir):
    return variants.training_window(calendar.since(panel(spark, sf_dir), ANCHOR), RULES)


_DECIDE = (
    _WINDOW
    + f""", i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sasdate) AS place, count(value) OVER (PARTITION BY series ORDER BY sasdate ROWS UNBOUNDED PRECEDING) AS run FROM p),
e AS (SELECT series, count(*) AS n, min(place) FILTER (WHERE value IS NOT NULL) AS fv, max(place) FILTER (WHERE value IS NOT NULL) AS lv, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS missing_share,
  count(value) FILTER (WHERE sasdate BETWEEN (SELECT train_start FROM t) AND (SELECT train_end FROM t)) AS nobs_train FROM i GROUP BY series),
r AS (SELECT series, run, min(place) AS a, max(place) AS z, count(*) AS length FROM i WHERE value IS NULL GROUP BY series, run),
k AS (SELECT e.series, any_value(missing_share) AS missing_share, any_value(nobs_train) AS nobs_train, coalesce(any_value(fv) - 1, any_value(n)) AS lead_gap,
  CASE WHEN any_value(fv) IS NULL THEN any_value(n) ELSE coalesce(max(length) FILTER (WHERE a > fv AND z < lv), 0) END::BIGINT AS gap FROM e LEFT JOIN r ON e.series = r.series GROUP BY e.series),
v AS (SELECT *, CASE WHEN missing_share > {RULES.missing_share} THEN 'missing_share' WHEN lead_gap > {RULES.leading} THEN 'leading' WHEN gap > {RULES.interior} THEN 'interior_gap' WHEN nobs_train < {RULES.min_train} THEN 'nobs_train' END AS reason FROM k)
"""
)


@_query("variant_decisions", _DECIDE + "SELECT series, round(missing_share, 6) AS missing_share, nobs_train, lead_gap, gap, reason, reason IS NULL AS kept FROM v")
def variant_decisions(spark, sf_dir):
    return _rounded(variants.decisions(calendar.since(panel(spark, sf_dir), ANCHOR), RULES), "missing_share")


@_query("variant_panel", _DECIDE + "SELECT series, sasdate, value FROM p WHERE series IN (SELECT series FROM v WHERE reason IS NULL)")
def variant_panel(spark, sf_dir):
    return variants.build_variant(panel(spark, sf_dir), ANCHOR, RULES)[0]


_GROUPS = "SELECT n.n_name || '|' || c.c_mktsegment AS series, any_value(CASE WHEN r.r_regionkey < 4 THEN r.r_name END) AS \"group\" FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1"


def _groups(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey < 4")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat_ws("|", "n_name", "c_mktsegment").alias("series"), F.col("r_name").alias("group"))


@_query("group_assign", f"WITH g AS ({_GROUPS}) " + 'SELECT series, "group" FROM g')
def group_assign(spark, sf_dir):
    return describe.assign_groups(codes(spark, sf_dir), _groups(spark, sf_dir))


@_query("group_filter", _P + f", g AS ({_GROUPS}) SELECT series, sasdate, value FROM p WHERE series IN (SELECT series FROM g WHERE \"group\" = 'ASIA')")
def group_filter(spark, sf_dir):
    return describe.filter_by_group(panel(spark, sf_dir), _groups(spark, sf_dir), "ASIA")


@_query("group_counts", f'WITH g AS ({_GROUPS}) SELECT "group", count(*) AS n FROM g GROUP BY 1')
def group_counts(spark, sf_dir):
    return describe.value_counts(describe.assign_groups(codes(spark, sf_dir), _groups(spark, sf_dir)), "group", with_null=True)


@_query(
    "describe",
    _P
    + 'SELECT series, count(value) AS "count", count(*) - count(value) AS nulls, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS max FROM p GROUP BY series',
)
def summary(spark, sf_dir):
    out = describe.describe(panel(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@_query(
    "corr_matrix",
    _P + "SELECT x.series AS a, y.series AS b, count(*) AS n, CASE WHEN count(*) > 1 AND isfinite(corr(x.value, y.value)) THEN round(corr(x.value, y.value), 6) END AS corr FROM p x JOIN p y ON x.sasdate = y.sasdate AND x.series <= y.series WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2",
)
def corr_matrix(spark, sf_dir):
    return _rounded(describe.correlations(panel(spark, sf_dir)), "corr")


@_query("grid_gaps", _P + "SELECT sasdate FROM cal WHERE month(sasdate) % 5 = 0")
def grid_gaps(spark, sf_dir):
    """Of a panel that lacks every fifth and tenth month of a year. The sample begins in January and ends in August."""
    return calendar.grid_gaps(order_months(spark, sf_dir).where(F.month("sasdate") % 5 != 0))


@_query("series_gaps", _P + "SELECT series, sasdate FROM p WHERE value IS NULL")
def series_gaps(spark, sf_dir):
    """Months of the panel's calendar that a series lacks."""
    months = order_months(spark, sf_dir).select("series", "sasdate")
    return panel(spark, sf_dir).select("series", "sasdate").join(months, ["series", "sasdate"], "left_anti")


@_query("duplicate_dates", _P + ", dup AS (SELECT series, sasdate FROM raw UNION ALL SELECT series, sasdate FROM raw WHERE nation = 3) SELECT series, sasdate, count(*) AS n FROM dup GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_dates(spark, sf_dir):
    months = order_months(spark, sf_dir)
    return calendar.duplicate_dates(months.unionByName(months.where("nation = 3")))


@_query("tcode_missing", _P + "SELECT series FROM s WHERE tcode = 4")
def tcode_missing(spark, sf_dir):
    known = codes(spark, sf_dir)
    return quality.missing_names(known, known.where("tcode <> 4"))


@_query("tcode_extra", _P + "SELECT series FROM s WHERE tcode = 5")
def tcode_extra(spark, sf_dir):
    known = codes(spark, sf_dir)
    return quality.extra_names(known.where("tcode <> 5"), known)


@_query("code_diagnostics", _P + "SELECT (SELECT list(series ORDER BY series) FROM s WHERE tcode = 4) AS missing_in_tcodes, (SELECT list(series ORDER BY series) FROM s WHERE tcode = 5) AS extra_in_tcodes")
def code_diagnostics(spark, sf_dir):
    known = codes(spark, sf_dir)
    return quality.code_diagnostics(known.where("tcode <> 5"), known.where("tcode <> 4"))


@_query("year_range", _P + "SELECT series, sasdate, value FROM p WHERE sasdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def year_range(spark, sf_dir):
    return calendar.between(panel(spark, sf_dir), "1997", "1998")


@_query(
    "gap_measures",
    _RUNS + "SELECT e.series, any_value(n) AS n_rows, coalesce(sum(length), 0)::BIGINT AS n_missing, any_value(coalesce(first_valid - 1, n)) AS lead_gap, CASE WHEN any_value(first_valid) IS NULL THEN any_value(n) ELSE coalesce(max(length) FILTER (WHERE a > first_valid AND z < last_valid), 0) END::BIGINT AS gap FROM e LEFT JOIN r ON e.series = r.series GROUP BY e.series",
)
def gap_measures(spark, sf_dir):
    return missing.gap_measures(panel(spark, sf_dir))


@_query("bad_numeric_tokens", "SELECT count(*) FILTER (WHERE x IS NOT NULL AND try_cast(x AS DOUBLE) IS NULL) AS bad FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN '.' ELSE CAST(c_acctbal AS VARCHAR) END AS x FROM customer)")
def bad_numeric_tokens(spark, sf_dir):
    x = F.when(F.col("c_custkey") % 10 == 0, ".").otherwise(F.col("c_acctbal").cast("string")).alias("x")
    rows = table(spark, sf_dir, "customer").select(x)
    return rows.agg(quality.bad_numbers(rows, "x").alias("bad"))


@_query(
    "structure_check",
    _P
    + """, rough AS (SELECT series, CASE WHEN nation = 7 AND month(sasdate) = 2 THEN NULL ELSE sasdate END AS sasdate FROM raw WHERE month(sasdate) % 5 <> 0 UNION ALL SELECT series, sasdate FROM raw WHERE nation = 3 AND month(sasdate) % 5 <> 0),
twice AS (SELECT count(*) AS n FROM (SELECT series, sasdate FROM rough WHERE sasdate IS NOT NULL GROUP BY ALL HAVING count(*) > 1)),
g AS (SELECT count(*) AS n FROM cal WHERE sasdate NOT IN (SELECT sasdate FROM rough WHERE sasdate IS NOT NULL))
SELECT 'not empty' AS "check", count(*) > 0 AS passed, count(*)::VARCHAR AS detail FROM rough UNION ALL SELECT 'dates parse', count(*) = 0, count(*)::VARCHAR FROM rough WHERE sasdate IS NULL
UNION ALL SELECT 'dates are unique', n = 0, n::VARCHAR FROM twice UNION ALL SELECT 'no gap in the grid', n = 0, n::VARCHAR FROM g""",
)
def structure_check(spark, sf_dir):
    """Of a panel with months that no series has, repeated months of one nation, and no dates in the Februaries of another."""
    months = order_months(spark, sf_dir).where(F.month("sasdate") % 5 != 0)
    day = F.when((F.col("nation") == 7) & (F.month("sasdate") == 2), F.lit(None)).otherwise(F.col("sasdate")).alias("sasdate")
    return quality.structure_checks(months.select("series", day, "value").unionByName(months.where("nation = 3").select("series", "sasdate", "value")))


@_query(
    "target_check",
    """WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT CASE WHEN k % 50 = 7 THEN NULL ELSE d END AS d, k FROM t)
SELECT 'dates parse' AS "check", count(*) FILTER (WHERE d IS NULL) = 0 AS passed, count(*) FILTER (WHERE d IS NULL)::VARCHAR AS detail FROM x UNION ALL SELECT 'dates are unique', count(d) = count(DISTINCT d), (count(d) - count(DISTINCT d))::VARCHAR FROM x
UNION ALL SELECT 'values are numbers', count(*) FILTER (WHERE k % 40 = 1) = 0, count(*) FILTER (WHERE k % 40 = 1)::VARCHAR FROM x UNION ALL SELECT 'months end quarters', count(*) FILTER (WHERE month(d) % 3 <> 0) = 0, count(*) FILTER (WHERE month(d) % 3 <> 0)::VARCHAR FROM x""",
)
def target_check(spark, sf_dir):
    """Orders as a target of text: some dates do not parse, some values are no numbers."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 50 == 7, "soon").otherwise(day).alias("sasdate"), F.when(k % 40 == 1, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("gdp"))
    return quality.target_checks(rows, "sasdate", "gdp", strict_quarter_end=True)


@_query("wide_roundtrip", _P + "SELECT series, sasdate, value FROM p")
def wide_roundtrip(spark, sf_dir):
    return to_long(to_wide(panel(spark, sf_dir)))


@_query("anchor_filter", _P + "SELECT series, sasdate, value FROM p WHERE sasdate >= DATE '1998-06-01'")
def anchor_filter(spark, sf_dir):
    return calendar.since(panel(spark, sf_dir), "1998-06-01")


@_query("closed_range", _P + "SELECT series, sasdate, value FROM p WHERE sasdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-01'")
def closed_range(spark, sf_dir):
    return calendar.between(panel(spark, sf_dir), "1997-01-01", "1997-12-01")


@_query("rows_dropped", _P + ", w AS (SELECT sasdate FROM p GROUP BY sasdate HAVING count(value) = count(*)) SELECT DISTINCT sasdate FROM p WHERE sasdate NOT IN (SELECT sasdate FROM w)")
def rows_dropped(spark, sf_dir):
    whole = panel(spark, sf_dir)
    full = whole.groupBy("sasdate").agg(F.bool_and(F.col("value").isNotNull()).alias("full")).where("full")
    return factors.rows_dropped(whole, whole.join(full, "sasdate", "left_semi"))


@_query("nearest_date", _P + "SELECT sasdate FROM cal ORDER BY abs(date_diff('day', sasdate, DATE '1999-05-17')), sasdate LIMIT 1")
def nearest_date(spark, sf_dir):
    return calendar.nearest_date(panel(spark, sf_dir), "1999-05-17")


@_query(
    "nearest_dates",
    _P + """, q AS (SELECT sasdate FROM cal WHERE month(sasdate) % 4 = 1 AND year(sasdate) <> 1995),
a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT a.d, arg_min(sasdate, (abs(date_diff('day', sasdate, a.d)), sasdate)) AS sasdate FROM a, q GROUP BY a.d)
SELECT n.sasdate, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN n ON CAST(o_orderdate AS DATE) = n.d GROUP BY n.sasdate""",
)
def nearest_dates(spark, sf_dir):
    """Orders by the date next to theirs, of a panel with every fourth month but those of one year."""
    dates = order_months(spark, sf_dir).where((F.month("sasdate") % 4 == 1) & (F.year("sasdate") != 1995))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("asked"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    near = calendar.nearest_dates(orders, dates, days=300)
    return orders.join(near, "asked").groupBy("sasdate").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("value"))


@_query("target_summary", _P + "SELECT min(sasdate) AS first_date, max(sasdate) AS last_date, count(*) AS n FROM raw")
def target_summary(spark, sf_dir):
    return order_months(spark, sf_dir).agg(F.min("sasdate").alias("first_date"), F.max("sasdate").alias("last_date"), F.count("*").alias("n"))


@_query("clean_names", "SELECT DISTINCT n.n_name || '|' || c.c_mktsegment AS series, replace(trim(n.n_name || '|' || c.c_mktsegment), ' ', '_') AS clean FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def clean_names(spark, sf_dir):
    return codes(spark, sf_dir).select("series").distinct().withColumn("clean", names.clean_names(F.col("series")))


@_query("observations_json", "SELECT event_type AS series, CAST(ts AS DATE) AS sasdate, count(*) AS n, count(value) AS n_values, CAST(sum(CASE WHEN CAST(floor(value) AS INTEGER) % 7 <> 0 THEN CAST(floor(value) AS INTEGER) END) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def observations_json(spark, sf_dir):
    """Payloads as a service sends them, one an event type and day, parsed again."""
    day = F.col("ts").cast("date")
    value = F.when(F.floor("value").cast("int") % 7 == 0, ".").otherwise(F.floor("value").cast("int").cast("string"))
    each = F.struct(day.cast("string").alias("date"), F.when(F.col("value").isNotNull(), value).alias("value"))
    payloads = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), day.alias("d")).agg(F.to_json(F.struct(F.collect_list(each).alias("observations"))).alias("payload"), F.count("value").alias("n_values"))
    parsed = observations.parse_observations(payloads).groupBy("series", "sasdate").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return parsed.join(payloads.select("series", F.col("d").alias("sasdate"), "n_values"), ["series", "sasdate"])


_VINTAGES = """
WITH e AS (SELECT event_type AS series, CAST(date_trunc('week', ts) AS DATE) AS sasdate, CAST(ts AS DATE) AS day, CAST(round(value, 2) AS DECIMAL(18,2)) AS v FROM events WHERE value IS NOT NULL),
d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 2 DAY)) AS DATE) AS day FROM e)
"""


@_query("vintages_as_of", _VINTAGES + "SELECT d.day, series, sasdate, CAST(sum(v) AS DOUBLE) AS value FROM e JOIN d ON e.day <= d.day GROUP BY ALL")
def vintages_as_of(spark, sf_dir):
    """Weekly sums of events as they were known on every second day: each day's events revise their week."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    day = F.col("ts").cast("date")
    daily = events.groupBy(F.col("event_type").alias("series"), F.trunc(day, "WEEK").alias("sasdate"), day.alias("known_from")).agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("v"))
    so_far = Window.partitionBy("series", "sasdate").orderBy("known_from").rowsBetween(Window.unboundedPreceding, 0)
    revised = daily.select("series", "sasdate", "known_from", F.sum("v").over(so_far).cast("double").alias("value"))
    span = events.agg(F.min(day).alias("a"), F.max(day).alias("z"))
    return vintages.as_of_each(revised, span.select(F.explode(F.sequence("a", "z", F.expr("interval 2 days"))).alias("day")))


@_query(
    "page_metadata",
    """WITH k AS (SELECT page_id, length(coalesce(html, '')) AS k FROM pages) SELECT CAST(page_id AS VARCHAR) AS label, CASE k % 4 WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'Weekly, Ending Friday' END AS frequency,
CASE k % 3 WHEN 0 THEN 'Seasonally Adjusted' WHEN 1 THEN 'Not Seasonally Adjusted' END AS seasonality, k % 4 < 3 AND k % 3 < 2 AS ok FROM k""",
)
def page_metadata(spark, sf_dir):
    """The pages with the two elements of a series' page put before them; which ones goes by the length of the page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    element = lambda text: F.concat(F.lit('<p class="x mb-2"><b>k</b> <span class="series-meta-value"> '), text, F.lit("\n</span></p>"))
    k = F.length(F.coalesce("html", F.lit("")))
    frequency = F.when(k % 4 == 0, "Monthly").when(k % 4 == 1, "Quarterly").when(k % 4 == 2, "Weekly,  Ending Friday")
    season = F.when(k % 3 == 0, "Seasonally  Adjusted").when(k % 3 == 1, "Not Seasonally Adjusted")
    made = F.concat(*[F.coalesce(element(x), F.lit("")) for x in (frequency, season)], F.coalesce("html", F.lit("")))
    return observations.parse_metadata(pages.withColumn("html", made), "page_id")


@_query(
    "kpss_level_stat",
    _P
    + """, e AS (SELECT series, sasdate, value - avg(value) OVER (PARTITION BY series) AS e FROM p WHERE value IS NOT NULL),
q AS (SELECT *, sum(e) OVER o AS s, lag(e, 1) OVER (PARTITION BY series ORDER BY sasdate) AS l1, lag(e, 2) OVER (PARTITION BY series ORDER BY sasdate) AS l2 FROM e WINDOW o AS (PARTITION BY series ORDER BY sasdate ROWS UNBOUNDED PRECEDING))
SELECT series, count(*) AS n, round(sum(s * s) / nullif(count(*) * (sum(e * e) + coalesce(sum(e * l1), 0) * 2 * (1 - 1.0 / 3) + coalesce(sum(e * l2), 0) * 2 * (1 - 2.0 / 3)), 0), 5) AS stat FROM q GROUP BY series""",
)
def kpss_level_stat(spark, sf_dir):
    return stationarity.kpss_level(panel(spark, sf_dir), lags=2).withColumn("stat", F.round("stat", 5))


@_query(
    "stationarity_decision",
    """WITH t AS (SELECT o_orderkey AS k, (o_orderkey % 11) / 100 AS adf, (o_orderkey % 13) / 100 AS kpss FROM orders)
SELECT k, CASE WHEN adf < 0.05 AND kpss >= 0.05 THEN 'stationary' WHEN adf >= 0.05 AND kpss < 0.05 THEN 'non-stationary' ELSE 'inconclusive' END AS decision FROM t""",
)
def stationarity_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 11 / 100).alias("adf"), (F.col("o_orderkey") % 13 / 100).alias("kpss"))
    return rows.select("k", stationarity.decision("adf", "kpss").alias("decision"))


@_query(
    "target_order",
    """WITH t AS (SELECT o_orderkey AS place, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT a.d < b.d AS up FROM t a JOIN t b ON b.place = a.place + 1)
SELECT 'dates parse' AS "check", true AS passed, '0' AS detail UNION ALL SELECT 'dates are unique', count(*) = count(DISTINCT d), (count(*) - count(DISTINCT d))::VARCHAR FROM t
UNION ALL SELECT 'values are numbers', count(*) FILTER (WHERE o_totalprice < 100000) = 0, count(*) FILTER (WHERE o_totalprice < 100000)::VARCHAR FROM orders UNION ALL SELECT 'dates rise', coalesce(bool_and(up), true), '' FROM n""",
)
def target_order(spark, sf_dir):
    """Orders as a target in the order of their keys, with a text for small prices: dates repeat, fall, and some values are no numbers."""
    value = F.when(F.col("o_totalprice") < 100000, ".").otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("sasdate"), value.alias("gdp"), F.col("o_orderkey").alias("place"))
    return quality.target_checks(rows, "sasdate", place="place")


_TESTS = stationarity_sql.oracle(_P, stationarity.published_values())
_DIGITS = {"adf_stat": 6, "adf_pvalue": 7, "kpss_stat": 7, "kpss_pvalue": 7, "pp_pvalue": 7, "dfgls_pvalue": 7, "za_stat": 6, "za_pvalue": 7}


@_query("stationarity_panel", _TESTS + "SELECT series, " + ", ".join(f"round({c}, {k}) AS {c}" for c, k in _DIGITS.items()) + ", za_break_index, kpss_reg, n_non_na, decision FROM tests")
def stationarity_panel(spark, sf_dir):
    out = stationarity.test_panel(panel(spark, sf_dir), pp=True, dfgls=True, za=True)
    return out.withColumns({c: F.round(c, k) for c, k in _DIGITS.items()})


@_query("stationarity_counts", stationarity_sql.oracle(_P, stationarity.published_values(), more=False) + "SELECT decision, count(*) AS n FROM tests GROUP BY decision")
def stationarity_counts(spark, sf_dir):
    return describe.value_counts(stationarity.test_panel(panel(spark, sf_dir)), "decision")


@_query("stl_deseasonalised")
def stl_deseasonalised(spark, sf_dir):
    return seasonal.deseasonalise(panel(spark, sf_dir))


def _values(rows) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


_GROUP8, _GROUP11 = (dict(taxonomies.flat(t)) for t in (taxonomies.EIGHT_GROUPS, taxonomies.ELEVEN_GROUPS))


@_query(
    "known_codes",
    "WITH k AS (" + _values([(i, k, c, _GROUP8.get(k), _GROUP11.get(k)) for i, (k, c) in enumerate(taxonomies.code_map().items())]) + """ AS t(place, series, tcode, "group", group11)), n AS (SELECT count(*) AS n FROM k)
SELECT series, tcode, "group", group11, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 2) AS balance FROM customer JOIN k ON k.place = c_custkey % (SELECT n + 4 FROM n) GROUP BY ALL""",
)
def known_codes(spark, sf_dir):
    """Customers as rows of the known series, dealt by their keys; some have no series."""
    places = {k: i for i, k in enumerate(taxonomies.code_map())}
    series = F.create_map(*[F.lit(x) for k, i in places.items() for x in (i, k)])
    rows = table(spark, sf_dir, "customer").select(F.try_element_at(series, (F.col("c_custkey") % (len(places) + 4)).cast("int")).alias("series"), F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))
    known = taxonomies.codes(spark).join(taxonomies.groups(spark, "eight"), "series", "left").join(taxonomies.groups(spark, "eleven").withColumnRenamed("group", "group11"), "series", "left")
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal").cast("double"), 2).alias("balance")).join(known, "series")


@_query("daily_sums", "SELECT event_type AS series, CAST(ts AS DATE) AS sasdate, round(sum(value), 4) AS value, count(value) AS n FROM events GROUP BY 1, 2")
def daily_sums(spark, sf_dir):
    from panelwright.streaming.arrivals import daily_sums as sums

    return sums(table(spark, sf_dir, "events").withColumn("series", F.col("event_type"))).withColumn("value", F.round("value", 4))
