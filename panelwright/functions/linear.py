"""Linear algebra and the normal distribution as SQL expressions over arrays of doubles.

Matrices are arrays of rows. Everything here is built from higher-order functions, so it
runs in the JVM without Python workers. A value that is used more than once is bound by
``let``: a plain expression inside a lambda would be computed again for each element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from panelwright.functions import text as F
from panelwright.functions.text import Text

#: Pivots below this share of a variable's own square count as zero.
_SINGULAR = 1e-13


def let(value: Text, body: Callable[[Text], Text]) -> Text:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: list[Text], body: Callable[..., Text]) -> Text:
    """body of several values, each computed once."""
    if not values:
        return body()
    return let(values[0], lambda v: let_all(values[1:], lambda *more: body(v, *more)))


def steps(a, b) -> Text:
    """The integers from a to b as an array, empty if b is below a."""
    a, b = (F.lit(x) if isinstance(x, int) else x.cast("int") for x in (a, b))
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def cut(x: Text, start, length) -> Text:
    """``length`` elements of x from the place ``start``, counted from 0."""
    start, length = (F.lit(v) if isinstance(v, int) else v.cast("int") for v in (start, length))
    return F.slice(x, start + 1, F.greatest(length, F.lit(0)))


def total(x: Text) -> Text:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Text, y: Text) -> Text:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def plus(x: Text, y: Text) -> Text:
    return F.zip_with(x, y, lambda a, b: a + b)


def at(x: Text, *places) -> Text:
    """x[i] or x[i][j], NULL outside."""
    for i in places:
        x = F.get(x, F.lit(i) if isinstance(i, int) else i.cast("int"))
    return x


def least_place(scores: Text) -> Text:
    """The first place of the least score that is not NULL."""
    return let(scores, lambda s: (F.array_position(s, F.array_min(s)) - 1).cast("int"))


def cholesky(m: Text, order: Text) -> Text:
    """Rows of the lower triangle of the matrix of the variables in ``order``. A singular variable makes its pivot and what depends on it NULL.

    Its row for a last variable y holds the coordinates of y along each one before it;
    the square of its last element is what they leave unexplained.
    """

    def row(rows: Text, v: Text) -> Text:
        def entry(done: Text, j: Text) -> Text:
            other = at(rows, j)
            below = (at(m, v, at(order, j)) - dot(done, F.slice(other, 1, F.size(done)))) / at(other, j)
            pivot = at(m, v, v) - dot(done, done)
            pivot = F.sqrt(F.when(pivot > _SINGULAR * at(m, v, v), pivot))
            return F.concat(done, F.array(F.when(j < F.size(rows), below).otherwise(pivot)))

        return F.aggregate(steps(0, F.size(rows)), F.array().cast("array<double>"), entry)

    return F.aggregate(order, F.array().cast("array<array<double>>"), lambda rows, v: F.concat(rows, F.array(row(rows, v))))


def solved_below(rows: Text, x: Text) -> Text:
    """The coordinates of x along the variables of the first rows of a Cholesky triangle, as many as x has."""

    def entry(done: Text, i: Text) -> Text:
        other = at(rows, i)
        return F.concat(done, F.array((at(x, i) - dot(done, F.slice(other, 1, F.size(done)))) / at(other, i)))

    return F.aggregate(steps(0, F.size(x) - 1), F.array().cast("array<double>"), entry)


def normal_cdf(z: Text, terms: int = 160) -> Text:
    """The normal distribution function by the series of positive terms of the error function; beyond 9 it is 0 or 1."""

    def series(z: Text) -> Text:
        step = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum"))
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        half = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["sum"]) * z * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return F.when(z > 9, 1.0).when(z < -9, 0.0).when(z.isNotNull(), F.greatest(0.5 + half, F.lit(0.0)))

    return let(z, series)


def interpolated(x: Text, places: tuple[float, ...], values: tuple[float, ...]) -> Text:
    """The broken line through (places, values), level beyond its ends."""
    out = F.when(x <= places[0], values[0])
    for a, b, u, v in zip(places, places[1:], values, values[1:]):
        out = out.when(x <= b, u + (v - u) * (x - a) / (b - a))
    return out.when(x > places[-1], values[-1])
