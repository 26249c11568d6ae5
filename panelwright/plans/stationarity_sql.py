"""DuckDB SQL of the stationarity tests, by another way: Gaussian elimination on lists of each regression's own columns."""

from __future__ import annotations

from panelwright.operators.null_tables import gls_terms, normal_quantiles, za_quantiles


def _eliminated(m: str, pivots: str) -> str:
    """The matrix m once its first ``pivots`` variables are taken out of the others."""
    return f"""list_reduce(list_transform(range(({pivots}) + 1), lambda q: {m}), lambda a, b, k: list_transform(a, lambda r, i: CASE WHEN i < k THEN r ELSE list_transform(r, lambda e, j: e - r[k - 1] * a[k - 1][j] / a[k - 1][k - 1]) END))"""


def _products(columns: str) -> str:
    return f"list_transform({columns}, lambda u: list_transform({columns}, lambda w: list_dot_product(u, w)))"


def _lag_columns(first: str, lags: str) -> str:
    return f"list_transform(range(1, ({lags}) + 1), lambda j: d[({first}) - j + 1:len(d) - j])"


def _cdf(z: str) -> str:
    """The normal distribution function: a half and a series of terms of one sign."""
    return f"CASE WHEN {z} > 9 THEN 1.0 WHEN {z} < -9 THEN 0.0 WHEN {z} IS NOT NULL THEN greatest(0.0, 0.5 + {z} * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(200), lambda k: exp(k * ln(greatest(({z}) * ({z}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)))) END"


def _through(t: str, critical: list) -> str:
    cases, last, z = "", "", normal_quantiles()
    for k in range(len(z) - 1):
        last = f"({z[k]} + ({z[k + 1]} - ({z[k]})) / ({critical[k + 1]} - ({critical[k]})) * ({t} - ({critical[k]})))"
        if k < len(z) - 2:
            cases += f" WHEN {t} <= {critical[k + 1]} THEN {last}"
    return f"CASE WHEN {t} IS NULL THEN NULL{cases} ELSE {last} END"


def _bounded_cdf(z: str) -> str:
    return f"CASE WHEN {z} IS NOT NULL THEN least(greatest({_cdf(z)}, 1e-4), 1 - 1e-4) END"


_WHOLE = "[list_transform(range({a}, len(d)), lambda t: 1.0::DOUBLE)]"
_T = "(({r})[{k}][{k} + 1] / ({r})[{k}][{k}]) / sqrt((({r})[{k} + 1][{k} + 1] - ({r})[{k}][{k} + 1] * ({r})[{k}][{k} + 1] / ({r})[{k}][{k}]) / greatest({df}, 1) / ({r})[{k}][{k}])"


def _t(reduced: str, k: str, df: str) -> str:
    return _T.format(r=reduced, k=f"({k})", df=df)


def _choose(name: str, source: str, base: str, n_base: int, extra: int) -> str:
    """CTEs name_s (series, p, score) and name (series, lags): the order of least AIC on the sample that ``most`` lags leave."""
    matrix = _products(f"list_concat({base}, {_lag_columns('most', 'p')}, [d[most + 1:]])")
    return f"""{name}_m AS (SELECT series, p, most, len(d) - most AS m, {matrix} AS g FROM {source}, (SELECT unnest(range(60)) AS p) WHERE p <= most),
{name}_s AS (SELECT series, p, m * ln(greatest(list_last(list_last({_eliminated("g", f"p + {n_base}")})), 1e-300) / m) + 2 * (p + {extra}) AS score FROM {name}_m),
{name} AS (SELECT series, arg_min(p, score) AS lags FROM (FROM {name}_s ORDER BY series, p) GROUP BY series)"""


def oracle(panel: str, fixed: dict, more: bool = True) -> str:
    """The columns of stationarity.test_panel with all tests, or without ``more`` those of ADF and KPSS, over the CTEs ``panel`` with a table p; ``fixed`` are its published values and their quantiles."""
    level, trend = "[x[most + 1:len(d)]]", "[list_transform(range(most, len(d)), lambda t: (t - (len(d) - 1) / 2) / len(d))]"
    const = _WHOLE.format(a="most")
    own = lambda first: f"[x[{first} + 1:len(d)]]"
    step = "list_transform(range(lags, len(d)), lambda t: CASE WHEN t >= b THEN 1.0 ELSE 0.0 END::DOUBLE)"
    slope = "list_transform(range(lags, len(d)), lambda t: greatest(t + 1 - b, 0)::DOUBLE)"
    trended = "[list_transform(range(lags, len(d)), lambda t: (t - (len(d) - 1) / 2) / len(d))]"
    kinds = {"c": (f"[{step}]", 1), "t": (f"[{slope}]", 1), "ct": (f"[{step}, {slope}]", 2)}
    own_columns = f"list_concat({_WHOLE.format(a='lags')}, {trended}, {_lag_columns('lags', 'lags')}, {own('lags')}, [d[lags + 1:]])"
    with_breaks = lambda c: f"list_concat(list_transform({c}, lambda u: list_concat(list_transform({c}, lambda w: list_dot_product(u, w)), list_transform(cols, lambda w: list_dot_product(u, w)))), list_transform(g, lambda r, i: list_concat(list_transform({c}, lambda u: list_dot_product(u, cols[i])), r)))"
    za = " UNION ALL ".join(
        f"SELECT series, '{k}' AS kind, {i} AS rank, b, {_t('m', f'lags + 3 + {more}', f'len(d) - lags - (lags + 2) - {more} - 1')} AS t FROM (SELECT series, d, lags, b, {_eliminated(f'(w)', f'lags + 2 + {more}')} AS m FROM (SELECT *, {with_breaks(c)} AS w FROM za_b))"
        for i, (k, (c, more)) in enumerate(kinds.items())
    )
    surface = lambda t, c: " + ".join(f"({v}) * pow({t}, {k})" for k, v in enumerate(c))
    mackinnon = lambda t: f"CASE WHEN {t} > {fixed['highest']} THEN 1.0 WHEN {t} < {fixed['lowest']} THEN 0.0 ELSE {_cdf('z')} END"
    z_of = lambda t: f"CASE WHEN {t} <= {fixed['star']} THEN {surface(t, fixed['small'])} ELSE {surface(t, fixed['large'])} END"
    kp, kc = fixed["kpss_p"], fixed["kpss"]["ct"]
    kpss_p = f"CASE WHEN t <= {kc[0]} THEN {kp[0]}" + "".join(f" WHEN t <= {kc[i + 1]} THEN {kp[i]} + ({kp[i + 1]} - {kp[i]}) * (t - {kc[i]}) / ({kc[i + 1]} - {kc[i]})" for i in range(3)) + f" WHEN t > {kc[-1]} THEN {kp[-1]} END"
    bartlett = lambda e, k: f"(list_dot_product({e}, {e}) + coalesce(list_sum(list_transform(range(1, least({k}, len({e}) - 1) + 1), lambda q: 2 * (1 - q / ({k} + 1)) * list_dot_product({e}[q + 1:], {e}[:len({e}) - q]))), 0)) / len({e})"
    minus_mean = lambda v: f"list_transform({v}, lambda w: w - list_avg({v}))"
    first = f"""{panel},
v AS (SELECT series, list(value ORDER BY sasdate) AS v, list(sasdate ORDER BY sasdate) AS dates FROM p WHERE value IS NOT NULL GROUP BY series),
b AS (SELECT series, v, dates, len(v) AS n, {minus_mean("v")} AS x, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS d,
  least(ceil(12 * pow(len(v) / 100, 0.25))::INTEGER, len(v) // 2 - 2) AS most FROM v WHERE list_min(v) < list_max(v)),
fit AS (SELECT * FROM b WHERE most >= 0),
{_choose("adf_l", "fit", f"list_concat({const}, {level})", 2, 2)},
adf AS (SELECT series, {_t(_eliminated(_products(f"list_concat({_WHOLE.format(a='lags')}, {_lag_columns('lags', 'lags')}, {own('lags')}, [d[lags + 1:]])"), "lags + 1"), "lags + 2", "len(d) - lags - lags - 2")} AS t FROM fit JOIN adf_l USING (series)),
r AS (SELECT series, adf.t AS adf_stat, {mackinnon("adf.t")} AS adf_pvalue FROM (SELECT *, {z_of("t")} AS z FROM adf) adf),
ke AS (SELECT series, n, list_transform(x, lambda w, i: w - (i - (n + 1) / 2) * list_sum(list_transform(x, lambda w, i: w * (i - (n + 1) / 2))) / list_sum(list_transform(x, lambda w, i: pow(i - (n + 1) / 2, 2)))) AS e FROM b),
kr AS (SELECT *, list_transform(range(1, floor(pow(n, 2.0 / 9))::INTEGER + 1), lambda q: list_dot_product(e[q + 1:], e[:n - q]) / (n / 2)) AS r FROM ke),
kl AS (SELECT *, least(floor(1.1447 * pow(pow(list_sum(list_transform(r, lambda w, i: i * w)) / (list_dot_product(e, e) / n + list_sum(r)), 2), 1.0 / 3) * pow(n, 1.0 / 3))::INTEGER, n - 1) AS lags FROM kr),
kpss AS (SELECT series, list_sum(list_transform(range(1, n + 1), lambda i: pow(list_sum(e[:i]), 2))) / (pow(n, 2) * {bartlett("e", "lags")}) AS t FROM kl),
rk AS (SELECT series, t AS kpss_stat, {kpss_p} AS kpss_pvalue FROM kpss)"""
    decided = "CASE WHEN adf_pvalue < 0.05 AND kpss_pvalue >= 0.05 THEN 'stationary' WHEN adf_pvalue >= 0.05 AND kpss_pvalue < 0.05 THEN 'non-stationary' ELSE 'inconclusive' END AS decision"
    if not more:
        return first + f""",
tests AS (SELECT s.series, adf_stat, adf_pvalue, kpss_stat, kpss_pvalue, {decided} FROM (SELECT DISTINCT series FROM p) s LEFT JOIN r USING (series) LEFT JOIN rk USING (series))
"""
    return first + f""",
gls_q AS (SELECT *, 1 - 7.0 / n AS a FROM fit),
gls_u AS (SELECT series, n, d, most, list_transform(v, lambda w: w - (v[1] + (1 - a) * list_sum(list_transform(range(1, n), lambda i: v[i + 1] - a * v[i]))) / (1 + (n - 1) * (1 - a) * (1 - a))) AS x FROM gls_q),
{_choose("gls_l", "gls_u", level, 1, 1)},
gls AS (SELECT series, n, {_t(_eliminated(_products(f"list_concat({_lag_columns('lags', 'lags')}, {own('lags')}, [d[lags + 1:]])"), "lags"), "lags + 1", "len(d) - lags - lags - 1")} AS t FROM gls_u JOIN gls_l USING (series)),
pa AS (SELECT series, {minus_mean("v[2:]")} AS y, {minus_mean("v[:n - 1]")} AS z, n - 1 AS m FROM b WHERE n >= 4),
pb AS (SELECT *, list_dot_product(z, z) AS zz, list_dot_product(y, z) / list_dot_product(z, z) AS slope FROM pa),
pc AS (SELECT *, list_transform(y, lambda w, i: w - slope * z[i]) AS e, ceil(12 * pow(m / 100, 0.25))::INTEGER AS lags FROM pb),
pd AS (SELECT *, list_dot_product(e, e) AS rss, {bartlett("e", "lags")} AS long FROM pc),
pp AS (SELECT series, sqrt(rss / m / long) * (slope - 1) / sqrt(rss / (m - 2) / zz) - 0.5 * (long - rss / m) / sqrt(long) * m * sqrt(1 / zz) AS t FROM pd),
za_f AS (SELECT * REPLACE (least(floor(12 * pow(n / 100, 0.25))::INTEGER, n // 4) AS most) FROM b WHERE n >= 4),
{_choose("za_l", "za_f", f"list_concat({const}, {trend}, {level})", 3, 3)},
za_g AS (SELECT *, {_products("cols")} AS g FROM (SELECT series, d, lags, n, {own_columns} AS cols FROM za_f JOIN za_l USING (series))),
za_b AS (SELECT series, d, lags, n, cols, g, unnest(range(greatest(floor(n * 0.15)::INTEGER, lags + 2), floor(n * 0.85)::INTEGER)) AS b FROM za_g),
za_t AS ({za}),
za_m AS (SELECT series, kind, rank, min(t) AS t, arg_min(b, t) AS place FROM (FROM za_t WHERE isfinite(t) ORDER BY series, rank, b) GROUP BY ALL),
za_z AS (SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN {_through('t', za_quantiles(k))}" for k in kinds)} END AS z FROM za_m),
za_p AS (SELECT *, {_bounded_cdf("z")} AS p FROM za_z),
za AS (SELECT series, t, p, place FROM za_p QUALIFY row_number() OVER (PARTITION BY series ORDER BY p DESC, rank) = 1),
rp AS (SELECT series, {mackinnon("pp.t")} AS pp_pvalue FROM (SELECT *, {z_of("t")} AS z FROM pp) pp),
rg AS (SELECT series, {_bounded_cdf("z")} AS dfgls_pvalue FROM (SELECT series, {_through("t", [f"({a} + ({b}) / n + {c} / (n * n))" for a, b, c in gls_terms()])} AS z FROM gls)),
a AS (SELECT s.series, adf_stat, adf_pvalue, kpss_stat, kpss_pvalue, pp_pvalue, dfgls_pvalue, za.t AS za_stat, za.p AS za_pvalue, v.dates[za.place + 1] AS za_break_index, 'ct' AS kpss_reg, coalesce(len(v.v), 0)::BIGINT AS n_non_na
  FROM (SELECT DISTINCT series FROM p) s LEFT JOIN v USING (series) LEFT JOIN r USING (series) LEFT JOIN rp USING (series) LEFT JOIN rg USING (series) LEFT JOIN rk USING (series) LEFT JOIN za USING (series)),
tests AS (SELECT *, {decided} FROM a)
"""
