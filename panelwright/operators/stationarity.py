"""Unit-root and stationarity tests of every series, as Spark expressions.

One aggregation gathers a series' values in order, 8 bytes each; everything after it is
higher-order functions on that array, without Python workers. Statistics follow the
published methods: augmented Dickey-Fuller with lags by AIC, KPSS with the automatic lag
of Hobijn, Franses and Ooms, Phillips-Perron, DF-GLS of Elliott, Rothenberg and Stock,
and Zivot-Andrews. All regressions on lagged differences come from one matrix of
cross-products a series: its first rows are sums over the series, the others follow along
the diagonals, one Cholesky triangle has the residuals of all lag orders, and the chosen
order's own sample adds a few rows. The break search folds once over the series.

The p-values of the first come from MacKinnon's response surface. That of KPSS goes through
published critical values and is bounded by the outermost of these. Those of DF-GLS and
Zivot-Andrews come from simulated tables (null_tables), that of DF-GLS by the number of
values. What cannot be computed (too few
values, a constant series, regressors that depend on each other) is NULL.

The tests are written in stages, a column each, and every stage binds what it reads with
``let``: each is short to analyse, and none is computed twice if stages are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as SF

from panelwright.functions import text as F
from panelwright.functions.text import Text, expr
from panelwright.functions.linear import at, cholesky, cut, dot, interpolated, least_place, let, let_all, normal_cdf, plus, solved_below, steps, total
from panelwright.operators.null_tables import PROBABILITIES, gls_quantiles, normal_quantiles, za_quantiles

#: Response surface of the Dickey-Fuller test with a constant: small p, large p, and their limits. Fixed values.
_SMALL_P = (2.1659, 1.4412, 0.038269)
_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
_STAR, _LOWEST, _HIGHEST = -1.61, -18.83, 2.74
#: Critical values by regression and the p-values they belong to. Fixed values.
_KPSS_P = (0.10, 0.05, 0.025, 0.01)
_KPSS = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}

#: Places in the matrix of cross-products: constant, trend, level before, difference, then the differences before.
_CONST, _TREND, _LEVEL, _Y, _LAGS = 0, 1, 2, 3, 4
_DOUBLES = "array<double>"


def published_values() -> dict:
    """The constants of the p-values by name."""
    return {"small": _SMALL_P, "large": _LARGE_P, "star": _STAR, "lowest": _LOWEST, "highest": _HIGHEST, "kpss": _KPSS, "kpss_p": _KPSS_P}


def mackinnon_p(t: Text) -> Text:
    """p-value of a Dickey-Fuller statistic with a constant."""

    def surface(t: Text, c: tuple[float, ...]) -> Text:
        out = F.lit(c[-1])
        for k in reversed(c[:-1]):
            out = out * t + F.lit(k)
        return out

    return let(t, lambda t: F.when(t > _HIGHEST, 1.0).when(t < _LOWEST, 0.0).when(t.isNotNull(), normal_cdf(F.when(t <= _STAR, surface(t, _SMALL_P)).otherwise(surface(t, _LARGE_P)))))


def tail_p(stat: Text, critical: list, p: tuple[float, ...] = PROBABILITIES) -> Text:
    """A p-value through the quantiles at p: straight lines between normal quantiles, the outer ones carried on, from 0.0001 to 0.9999."""
    z = normal_quantiles(p)
    lines = [z[k] + (z[k + 1] - z[k]) / (critical[k + 1] - critical[k]) * (stat - critical[k]) for k in range(len(z) - 1)]
    through = F.when(stat <= critical[1], lines[0])
    for k in range(1, len(lines) - 1):
        through = through.when(stat <= critical[k + 1], lines[k])
    return F.when(stat.isNotNull(), F.least(F.greatest(normal_cdf(through.otherwise(lines[-1])), F.lit(1e-4)), F.lit(1 - 1e-4)))


def schwert(n: Text, round_up: bool = True) -> Text:
    """12 (n / 100) ^ (1 / 4) as an integer."""
    lags = 12 * F.pow(n / 100, F.lit(0.25))
    return (F.ceil(lags) if round_up else F.floor(lags)).cast("int")


def centred(x: Text) -> Text:
    return let(x, lambda x: let(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))


def differences(x: Text) -> Text:
    return F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), cut(x, 0, F.size(x) - 1), lambda b, a: b - a)


def _trend_at(t: Text, n: Text) -> Text:
    return (t - (n - 1) / 2) / n


def lag_matrix(x: Text, d: Text, most: Text) -> Text:
    """Cross-products of constant, trend, level before, difference and its ``most`` lags, over the differences that have all of these.

    The sums of products of a difference with each one before it are taken over the
    series; those of two lags are the one before on the diagonal, with one product more
    at the start and one less at the end.
    """
    n, m = F.size(d), F.size(d) - most
    lag = lambda j: cut(d, most - j, m)
    level, time = cut(x, most, m), F.transform(steps(most, n - 1), lambda t: _trend_at(t, n))

    def whole(first: Text) -> Text:
        def along(i: Text, j: Text) -> Text:
            low, apart = F.least(i, j), F.abs(i - j)
            edge = lambda a, r: a + at(d, most - 1 - r) * at(d, most - 1 - r - apart) - at(d, n - 1 - r) * at(d, n - 1 - r - apart)
            return F.aggregate(steps(0, low - 1), at(first, apart), edge)

        return F.transform(steps(0, most), lambda i: F.transform(steps(0, most), lambda j: along(i, j)))

    def rows(level: Text, time: Text) -> Text:
        each = lambda f: F.transform(steps(0, most), lambda j: f(lag(j)))
        const = F.concat(F.array(m.cast("double"), total(time), total(level)), each(total))
        trend = F.concat(F.array(total(time), dot(time, time), dot(time, level)), each(lambda v: dot(time, v)))
        own = F.concat(F.array(total(level), dot(time, level), dot(level, level)), each(lambda v: dot(level, v)))
        lags = let(each(lambda v: dot(lag(F.lit(0)), v)), whole)
        three = lambda c, t, l: F.concat(F.array(c, t, l), F.zip_with(F.zip_with(F.slice(c, 4, most + 1), F.slice(t, 4, most + 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.zip_with(F.slice(l, 4, most + 1), lags, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p, q: F.concat(F.array(p["a"], p["b"], q["a"]), q["b"])))
        return let(const, lambda c: let(trend, lambda t: let(own, lambda l: three(c, t, l))))

    return let(level, lambda level: let(time, lambda time: rows(level, time)))


def _row_of(x: Text, d: Text, t: Text, lags: Text) -> Text:
    """Constant, trend, level before, difference and its lags at the place t."""
    head = F.array(F.lit(1.0), _trend_at(t, F.size(d)), at(x, t), at(d, t))
    return F.concat(head, F.reverse(cut(d, t - lags, lags)))


def extended(m: Text, x: Text, d: Text, most: Text, lags: Text) -> Text:
    """The matrix of ``lags`` lags with the rows that more lags had to leave out."""
    places = steps(0, _LAGS - 1 + lags)
    early = F.transform(steps(lags, most - 1), lambda t: _row_of(x, d, t, lags))
    return let(early, lambda z: F.transform(places, lambda i: F.transform(places, lambda j: at(m, i, j) + F.aggregate(z, F.lit(0.0), lambda a, row: a + at(row, i) * at(row, j)))))


def _order(*parts) -> Text:
    return F.concat(*[F.array(F.lit(p)) if isinstance(p, int) else p for p in parts])


def _lags_of(n: Text) -> Text:
    return steps(_LAGS, n + (_LAGS - 1))


def chosen_lags(m: Text, base: tuple[int, ...], most: Text, criterion: str) -> Text:
    """The number of lags of least criterion beside the variables ``base``, all on one sample."""
    count = at(m, _CONST, _CONST)
    weight = F.lit(2.0) if criterion == "AIC" else F.log(count)

    def scores(y: Text) -> Text:
        left = lambda p: at(m, _Y, _Y) - let(cut(y, 0, p + len(base)), lambda w: dot(w, w))
        score = lambda rss, p: F.when(rss.isNotNull(), count * F.log(F.greatest(rss, F.lit(1e-300)) / count) + weight * (p + len(base)))
        return F.transform(steps(0, most), lambda p: let(left(p), lambda rss: score(rss, p)))

    return let(F.element_at(cholesky(m, _order(*base, _lags_of(most), _Y)), -1), lambda y: least_place(scores(y)))


def _level_t(m: Text, before: tuple[int, ...], lags: Text) -> Text:
    """The t statistic of the level, after the variables ``before`` and the lags."""
    df = F.greatest(at(m, _CONST, _CONST) - (len(before) + lags + 1), F.lit(1.0))
    y = F.element_at(cholesky(m, _order(*before, _lags_of(lags), _LEVEL, _Y)), -1)
    return let(y, lambda y: F.try_divide(F.element_at(y, -2) * F.sqrt(df), F.element_at(y, -1)))


def _stage(df: DataFrame, out: str, sources: tuple[str, ...], body) -> DataFrame:
    """df with a column more, of columns that are there before; NULL where the first of these is."""
    columns = [F.col(c) for c in sources]
    return df.withColumn(out, expr(F.when(columns[0].isNotNull(), let_all(columns, body))))


def _regressions(df: DataFrame, x: Text, most: Text, base: tuple[int, ...], criterion: str | None, out: str) -> DataFrame:
    """df with the columns {out}_x, _d, _lags and _m: values, differences, the number of lags, and the cross-products of its own sample."""
    names = {k: f"{out}_{k}" for k in ("x", "d", "most", "all", "lags", "m")}
    df = df.withColumns({names["x"]: expr(x), names["most"]: expr(most)})
    df = _stage(df, names["d"], (names["x"],), differences)
    df = _stage(df, names["all"], (names["x"], names["d"], names["most"]), lag_matrix)
    df = _stage(df, names["lags"], (names["all"], names["most"]), (lambda m, most: chosen_lags(m, base, most, criterion)) if criterion else (lambda m, most: most))
    df = _stage(df, names["m"], (names["all"], names["x"], names["d"], names["most"], names["lags"]), extended)
    return df.drop(names["most"], names["all"])


def _dickey_fuller(df: DataFrame, x: Text, before: tuple[int, ...], criterion: str | None, out: str) -> DataFrame:
    df = _regressions(df, x, _most_lags(F.size(F.col("x"))), (*before, _LEVEL), criterion, out)
    df = _stage(df, out, (f"{out}_m", f"{out}_lags"), lambda m, lags: _level_t(m, before, lags))
    return df.withColumn(out, _finite(SF.col(out))).drop(*[f"{out}_{k}" for k in ("x", "d", "lags", "m")])


def _most_lags(n: Text) -> Text:
    return F.least(schwert(n), F.floor(n / 2).cast("int") - 2)


def _varied(least: int = 1) -> Text:
    """Whether a series has as many values, and not all alike."""
    return (F.size(F.col("x")) >= least) & (F.array_min(F.col("x")) < F.array_max(F.col("x")))


def adf(df: DataFrame, autolag: str | None = "AIC", out: str = "adf_stat") -> DataFrame:
    """df (x, in order) with the augmented Dickey-Fuller statistic with a constant. Lags are chosen on a common sample, then the regression runs on all it can."""
    return _dickey_fuller(df, F.when(_varied() & (_most_lags(F.size(F.col("x"))) >= 0), centred(F.col("x"))), (_CONST,), autolag, out)


def _quasi(x: Text, a: Text) -> Text:
    return F.concat(F.slice(x, 1, 1), F.zip_with(F.slice(x, 2, F.size(x) - 1), cut(x, 0, F.size(x) - 1), lambda v, b: v - a * b))


def df_gls(df: DataFrame, trend: str = "c", out: str = "dfgls_stat") -> DataFrame:
    """df (x) with the DF-GLS statistic: without the constant (c) or line (ct) that the quasi-differenced values have; lags by AIC."""

    def pieces(x: Text) -> Text:
        """Quasi-differences of the values, of a constant and of a line."""
        a = 1 - (7.0 if trend == "c" else 13.5) / F.size(x)
        columns = (x, F.transform(x, lambda v: F.lit(1.0)), F.transform(x, lambda v, i: (i + 1).cast("double")))
        return let(a, lambda a: F.struct(*[_quasi(c, a).alias(k) for k, c in zip("qzs", columns, strict=True)]))

    def detrended(p: Text, x: Text) -> Text:
        zz, zs, ss = dot(p["z"], p["z"]), dot(p["z"], p["s"]), dot(p["s"], p["s"])
        zq, sq = dot(p["z"], p["q"]), dot(p["s"], p["q"])
        if trend == "c":
            return let(zq / zz, lambda b: F.transform(x, lambda v: v - b))
        line = lambda zz, zs, ss, zq, sq: F.array(F.try_divide(zq * ss - sq * zs, zz * ss - zs * zs), F.try_divide(sq * zz - zq * zs, zz * ss - zs * zs))
        return let(let_all([zz, zs, ss, zq, sq], line), lambda b: F.transform(x, lambda v, i: v - at(b, 0) - at(b, 1) * (i + 1)))

    df = df.withColumn(f"{out}_raw", expr(F.when(_varied() & (_most_lags(F.size(F.col("x"))) >= 0), F.col("x"))))
    df = _stage(df, f"{out}_p", (f"{out}_raw",), pieces)
    df = _stage(df, f"{out}_u", (f"{out}_p", f"{out}_raw"), detrended)
    return _dickey_fuller(df, F.col(f"{out}_u"), (), "AIC", out).drop(f"{out}_raw", f"{out}_p", f"{out}_u")


def _product(e: Text, k: Text) -> Text:
    """Sum of the products of elements that are k apart."""
    return dot(cut(e, k, F.size(e) - k), cut(e, 0, F.size(e) - k))


def long_run(e: Text, lags: Text) -> Text:
    """Variance with Bartlett weights."""
    sums = F.transform(steps(1, F.least(lags, F.size(e) - 1)), lambda k: 2 * (1 - k / (lags + 1)) * _product(e, k))
    return (dot(e, e) + total(sums)) / F.size(e)


def automatic_lags(e: Text) -> Text:
    """The bandwidth that Hobijn, Franses and Ooms choose by the residuals' own autocovariances."""
    n = F.size(e)
    products = F.transform(steps(1, F.floor(F.pow(n, F.lit(2 / 9)))), lambda k: _product(e, k) / (n / 2))

    def of(p: Text) -> Text:
        s0 = dot(e, e) / n + total(p)
        s1 = total(F.transform(p, lambda v, i: (i + 1) * v))
        return F.least(F.floor(1.1447 * F.pow(F.pow(F.try_divide(s1, s0), F.lit(2.0)), F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3))).cast("int"), n - 1)

    return let(products, of)


def kpss_residuals(x: Text, regression: str) -> Text:
    """x less its mean (c) or its line (ct)."""
    if regression == "c":
        return centred(x)
    if regression != "ct":
        raise ValueError("regression must be c or ct")
    time = F.transform(x, lambda v, i: i - (F.size(x) - 1) / 2)
    line = lambda x, t: let(dot(t, x) / dot(t, t), lambda b: F.zip_with(x, t, lambda v, s: v - b * s))
    return let_all([centred(x), time], line)


def kpss(df: DataFrame, regression: str = "c", nlags: str | int = "auto", out: str = "kpss_stat") -> DataFrame:
    """df (x) with the KPSS statistic and, as {out}_lags, its number of lags."""
    e, lags = f"{out}_e", f"{out}_lags"

    def chosen(e: Text) -> Text:
        n = F.size(e)
        return automatic_lags(e) if nlags == "auto" else F.least(schwert(n), n - 1) if nlags == "legacy" else F.lit(int(nlags))

    def stat(e: Text, lags: Text) -> Text:
        step = lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["squares"] + (s["sum"] + v) * (s["sum"] + v)).alias("squares"))
        squares = F.aggregate(e, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares")), step, lambda s: s["squares"])
        return F.try_divide(squares, F.pow(F.size(e), F.lit(2.0)) * long_run(e, lags))

    df = df.withColumn(f"{out}_raw", expr(F.when(_varied(), F.col("x"))))
    df = _stage(df, e, (f"{out}_raw",), lambda x: kpss_residuals(x, regression))
    df = _stage(df, lags, (e,), chosen)
    df = _stage(df, out, (e, lags), stat)
    return df.withColumn(out, _finite(SF.col(out))).drop(e, f"{out}_raw")


def kpss_p(stat: Text, regression: str = "c") -> Text:
    """p-value from 0.01 to 0.10."""
    return interpolated(stat, _KPSS[regression], _KPSS_P)


def phillips_perron(df: DataFrame, out: str = "pp_stat") -> DataFrame:
    """df (x) with Z-tau with a constant."""

    def fitted(x: Text) -> Text:
        after, before = F.slice(x, 2, F.size(x) - 1), cut(x, 0, F.size(x) - 1)
        slope = lambda y, b: let_all([dot(b, b), dot(y, b)], lambda bb, yb: let(F.try_divide(yb, bb), lambda s: F.struct(bb.alias("spread"), s.alias("slope"), F.zip_with(y, b, lambda v, w: v - s * w).alias("e"))))
        return let_all([centred(after), centred(before)], slope)

    def stat(fit: Text, e: Text, rss: Text, long_: Text) -> Text:
        n = F.size(e)
        error = F.sqrt(F.try_divide(rss / (n - 2), fit["spread"]))
        first = F.sqrt(F.try_divide(rss / n, long_)) * F.try_divide(fit["slope"] - 1, error)
        return first - 0.5 * F.try_divide(long_ - rss / n, F.sqrt(long_)) * n * F.try_divide(error, F.sqrt(rss / (n - 2)))

    names = {k: f"{out}_{k}" for k in ("raw", "fit", "e", "rss", "long")}
    df = df.withColumn(names["raw"], expr(F.when(_varied(4), F.col("x"))))
    df = _stage(df, names["fit"], (names["raw"],), fitted).withColumn(names["e"], SF.col(f"{names['fit']}.e"))
    df = _stage(df, names["rss"], (names["e"],), lambda e: dot(e, e))
    df = _stage(df, names["long"], (names["e"],), lambda e: long_run(e, schwert(F.size(e))))
    df = _stage(df, out, tuple(names[k] for k in ("fit", "e", "rss", "long")), stat)
    return df.withColumn(out, _finite(SF.col(out))).drop(*names.values())


def _t_statistic(r: Text, df: Text) -> Text:
    """The t statistic of a regression on one variable, from its products xx, xy, yy."""
    rss = F.greatest(r["yy"] - F.try_divide(r["xy"] * r["xy"], r["xx"]), F.lit(0.0))
    return F.try_divide(F.try_divide(r["xy"], r["xx"]), F.sqrt(F.try_divide(F.try_divide(F.when(df > 0, rss), df), r["xx"])))


def zivot_andrews(df: DataFrame, trim: float = 0.15, out: str = "za") -> DataFrame:
    """df (x) with (c, t, ct), each (stat, place): the least statistic over all break places of the level, the slope or both, and its place. NULL where there is none.

    The lags are those of least AIC with a trend and no break. One fold from the last
    difference to the first place adds up the rows after a place, and these sums again for
    the slope; each place then costs two solutions with the triangle of the regression
    without a break.
    """

    def search(rows: Text, x: Text, d: Text, lags: Text) -> Text:
        n = F.size(x)
        count, k = F.size(d) - lags, lags + 2
        first, last = F.greatest(F.floor(n * F.lit(trim)).cast("int"), lags + 2), F.floor(n * F.lit(1 - trim)).cast("int") - 1
        level, y_row = at(rows, k, k), at(rows, k + 1)
        along = [cut(at(rows, k), 0, k), cut(y_row, 0, k)]
        unbroken = F.struct((level * level).alias("xx"), (at(y_row, k) * level).alias("xy"), (at(y_row, k) * at(y_row, k) + at(y_row, k + 1) * at(y_row, k + 1)).alias("yy"))

        def fold(wx: Text, wy: Text, whole: Text) -> Text:
            def t_of(r: Text, cc: Text, cx: Text, cy: Text, own: Text, more: int) -> Text:
                """The t statistic of the level once a column is taken out too, and what is left."""
                some = F.when(cc > 1e-12 * own, cc)
                return let(F.struct((r["xx"] - F.try_divide(cx * cx, some)).alias("xx"), (r["xy"] - F.try_divide(cx * cy, some)).alias("xy"), (r["yy"] - F.try_divide(cy * cy, some)).alias("yy")), lambda r: F.struct(r["xx"].alias("xx"), r["xy"].alias("xy"), r["yy"].alias("yy"), _t_statistic(r, count - k - more - 1).alias("t")))

            def stats(s: Text, g: Text, q: Text) -> Text:
                """t statistics with a step, a slope, and both, where q differences lie after the place."""
                ws, wg = solved_below(rows, cut(s, 0, k)), solved_below(rows, cut(g, 0, k))
                sizes = lambda ws, wg: F.struct(
                    (q - dot(ws, ws)).alias("cc"), (at(s, k) - dot(ws, wx)).alias("cx"), (at(s, k + 1) - dot(ws, wy)).alias("cy"),
                    (q * (q + 1) * (2 * q + 1) / 6 - dot(wg, wg)).alias("gg"), (at(g, k) - dot(wg, wx)).alias("gx"), (at(g, k + 1) - dot(wg, wy)).alias("gy"), (q * (q + 1) / 2 - dot(ws, wg)).alias("cg"),
                )
                cube = q * (q + 1) * (2 * q + 1) / 6
                of = lambda z: F.array(t_of(whole, z["cc"], z["cx"], z["cy"], q, 1)["t"], t_of(whole, z["gg"], z["gx"], z["gy"], cube, 1)["t"], let(t_of(whole, z["cc"], z["cx"], z["cy"], q, 1), lambda r: t_of(r, z["gg"] - F.try_divide(z["cg"] * z["cg"], z["cc"]), z["gx"] - F.try_divide(z["cg"] * z["cx"], z["cc"]), z["gy"] - F.try_divide(z["cg"] * z["cy"], z["cc"]), cube, 2))["t"])
                return let(ws, lambda ws: let(wg, lambda wg: let(sizes(ws, wg), of)))

            def step(acc: Text, t: Text) -> Text:
                row = let(_row_of(x, d, t, lags), lambda r: F.concat(F.slice(r, 1, 2), F.slice(r, _LAGS + 1, lags), F.slice(r, 3, 2)))

                def moved(s: Text, g: Text) -> Text:
                    found = F.when(t <= last, stats(s, g, (F.size(d) - t).cast("double")))
                    best = let(found, lambda f: F.transform(acc["best"], lambda b, i: F.when((at(f, i) <= b["stat"]) | (b["stat"].isNull() & at(f, i).isNotNull()), F.struct(at(f, i).alias("stat"), t.alias("place"))).otherwise(b)))
                    return F.struct(s.alias("s"), g.alias("g"), best.alias("best"))

                return let(plus(acc["s"], row), lambda s: let(plus(acc["g"], s), lambda g: moved(s, g)))

            zeros = F.array_repeat(F.lit(0.0), k + 2)
            none = F.struct(F.lit(None).cast("double").alias("stat"), F.lit(None).cast("int").alias("place"))
            start = F.struct(zeros.alias("s"), zeros.alias("g"), F.array(none, none, none).alias("best"))
            return F.aggregate(F.reverse(steps(first, F.size(d) - 1)), start, step, lambda a: a["best"])

        return let_all([*along, unbroken], fold)

    n = F.size(F.col("x"))
    most = F.least(schwert(n, round_up=False), F.floor(n / 4).cast("int"))
    df = _regressions(df, F.when(_varied(4), centred(F.col("x"))), most, (_CONST, _TREND, _LEVEL), "AIC", out)
    df = _stage(df, f"{out}_rows", (f"{out}_m", f"{out}_lags"), lambda m, lags: cholesky(m, _order(_CONST, _TREND, _lags_of(lags), _LEVEL, _Y)))
    df = _stage(df, f"{out}_found", tuple(f"{out}_{k}" for k in ("rows", "x", "d", "lags")), search)
    kinds = F.struct(*[at(F.col(f"{out}_found"), i).alias(c) for i, c in enumerate(("c", "t", "ct"))])
    return df.withColumn(out, expr(kinds)).drop(*[f"{out}_{k}" for k in ("x", "d", "lags", "m", "rows", "found")])


def decision(adf_p: Column | str, kpss_p: Column | str, alpha: float = 0.05) -> Column:
    """stationary if only ADF rejects, non-stationary if only KPSS does, else inconclusive; also where a p-value is missing."""
    a, k = (SF.nanvl(SF.col(c) if isinstance(c, str) else c, SF.lit(None).cast("double")) for c in (adf_p, kpss_p))
    return SF.when((a < alpha) & (k >= alpha), "stationary").when((a >= alpha) & (k < alpha), "non-stationary").otherwise("inconclusive")


def ordered_values(panel: DataFrame) -> DataFrame:
    """(series, dates, x): the dates and values of every series in order, without its missing rows.

    A row is small and the work on it is not, so rows are dealt to as many tasks as
    shuffles have, which adaptive execution would make fewer.
    """
    cell = SF.when(SF.col("value").isNotNull(), SF.struct("sasdate", "value"))
    rows = panel.groupBy("series").agg(SF.array_sort(SF.collect_list(cell)).alias("cells"))
    rows = rows.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series")
    return rows.select("series", SF.col("cells.sasdate").alias("dates"), SF.col("cells.value").alias("x"))


def _finite(x: Column) -> Column:
    return SF.when(~SF.isnan(x) & (SF.abs(x) < float("inf")), x)


def test_panel(panel: DataFrame, alpha: float = 0.05, autolag: str | None = "AIC", kpss_reg: str = "ct", kpss_nlags: str | int = "auto", pp: bool = False, dfgls: bool = False, za: bool = False) -> DataFrame:
    """Tests and decision of every series, a row each. Zivot-Andrews is the kind of break of largest p-value."""
    none = SF.lit(None).cast("double")
    kinds = ("c", "t", "ct")
    tests = kpss(adf(ordered_values(panel), autolag), kpss_reg, kpss_nlags)
    tests = phillips_perron(tests) if pp else tests.withColumn("pp_stat", none)
    tests = df_gls(tests) if dfgls else tests.withColumn("dfgls_stat", none)
    tests = zivot_andrews(tests) if za else tests.withColumn("za", SF.lit(None).cast("struct<" + ",".join(f"{k}:struct<stat:double,place:int>" for k in kinds) + ">"))
    each = [SF.struct(expr(tail_p(F.col("za")[k]["stat"], za_quantiles(k))).alias("p"), SF.lit(-i).alias("first"), SF.col(f"za.{k}.stat").alias("stat"), SF.col(f"za.{k}.place").alias("place")) for i, k in enumerate(kinds)]
    worst = SF.array_max(SF.filter(SF.array(*each), lambda z: z["p"].isNotNull()))
    out = tests.withColumn("worst", worst).select(
        "series",
        "adf_stat",
        expr(mackinnon_p(F.col("adf_stat"))).alias("adf_pvalue"),
        "kpss_stat",
        expr(kpss_p(F.col("kpss_stat"), kpss_reg)).alias("kpss_pvalue"),
        expr(mackinnon_p(F.col("pp_stat"))).alias("pp_pvalue"),
        expr(tail_p(F.col("dfgls_stat"), gls_quantiles(F.size(F.col("x"))))).alias("dfgls_pvalue"),
        SF.col("worst.stat").alias("za_stat"),
        SF.col("worst.p").alias("za_pvalue"),
        SF.get("dates", SF.col("worst.place")).alias("za_break_index"),
        SF.lit(kpss_reg).alias("kpss_reg"),
        SF.size("x").cast("long").alias("n_non_na"),
    )
    return out.withColumn("decision", decision("adf_pvalue", "kpss_pvalue", alpha))


test_panel.__test__ = False


def kpss_level(panel: DataFrame, lags: int = 0) -> DataFrame:
    """(series, n, stat): the level KPSS statistic with a fixed number of lags, in window functions alone."""
    from pyspark.sql import Window

    by = Window.partitionBy("series")
    order = by.orderBy("sasdate")
    e = panel.where("value IS NOT NULL").withColumn("e", SF.col("value") - SF.avg("value").over(by))
    parts = e.withColumn("s", SF.sum("e").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    products = [SF.sum(SF.col("e") * SF.col(f"l{k}")) * 2 * (1 - k / (lags + 1)) for k in range(1, lags + 1)]
    for k in range(1, lags + 1):
        parts = parts.withColumn(f"l{k}", SF.lag("e", k).over(order))
    spread = SF.sum(SF.col("e") * SF.col("e"))
    for p in products:
        spread = spread + SF.coalesce(p, SF.lit(0.0))
    out = parts.groupBy("series").agg(SF.count("*").alias("n"), SF.sum(SF.col("s") * SF.col("s")).alias("s2"), spread.alias("v"))
    return out.select("series", "n", SF.try_divide("s2", SF.col("n") * SF.col("v")).alias("stat"))
