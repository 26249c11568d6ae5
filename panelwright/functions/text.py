"""SQL expressions as text, with the names and operators of pyspark.sql.functions.

A tree of Column objects costs a call to the JVM a node, which for the nested functions
of the stationarity tests adds up to seconds; text is handed over once, by ``expr``.
"""

from __future__ import annotations

import inspect
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_fresh = count()


def _text(x) -> str:
    if isinstance(x, Text):
        return x.text
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return f"{x!r}D" if isinstance(x, float) else f"({x})" if x < 0 else str(x)


class Text:
    """An expression; operators give longer ones."""

    def __init__(self, text: str):
        self.text = text

    def _two(op):  # noqa: N805
        return lambda self, other: Text(f"({self.text} {op} {_text(other)})")

    def _turned(op):  # noqa: N805
        return lambda self, other: Text(f"({_text(other)} {op} {self.text})")

    __add__, __sub__, __mul__, __truediv__ = _two("+"), _two("-"), _two("*"), _two("/")
    __radd__, __rsub__, __rmul__, __rtruediv__ = _turned("+"), _turned("-"), _turned("*"), _turned("/")
    __lt__, __le__, __gt__, __ge__, __eq__, __and__, __or__ = _two("<"), _two("<="), _two(">"), _two(">="), _two("="), _two("AND"), _two("OR")
    __hash__ = None

    def __neg__(self):
        return Text(f"(-{self.text})")

    def __invert__(self):
        return Text(f"(NOT {self.text})")

    def __getitem__(self, field: str):
        return Text(f"{self.text}.{field}")

    def cast(self, kind: str):
        return Text(f"CAST({self.text} AS {kind})")

    def alias(self, name: str):
        return name, self

    def isNull(self):  # noqa: N802
        return Text(f"({self.text} IS NULL)")

    def isNotNull(self):  # noqa: N802
        return Text(f"({self.text} IS NOT NULL)")


class Case(Text):
    """CASE WHEN, as long as branches are added."""

    def __init__(self, branches: str):
        super().__init__(f"CASE{branches} END")
        self.branches = branches

    def when(self, condition, value):
        return Case(f"{self.branches} WHEN {_text(condition)} THEN {_text(value)}")

    def otherwise(self, value):
        return Text(f"CASE{self.branches} ELSE {_text(value)} END")


def _argument(x) -> str:
    """A lambda gets names of its own, so that nested ones do not hide each other's."""
    if not callable(x):
        return _text(x)
    names = [f"v{next(_fresh)}" for _ in inspect.signature(x).parameters]
    return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_text(x(*map(Text, names)))}"


def _function(name: str):
    return lambda *arguments: Text(f"{name}({', '.join(map(_argument, arguments))})")


transform, aggregate, zip_with, filter = (_function(n) for n in ("transform", "aggregate", "zip_with", "filter"))
get, array, sequence, slice, size, concat, reverse, element_at, array_repeat, array_position, array_min, array_max = (_function(n) for n in ("get", "array", "sequence", "slice", "size", "concat", "reverse", "element_at", "array_repeat", "array_position", "array_min", "array_max"))
greatest, least, sqrt, exp, log, pow, floor, ceil, abs, try_divide = (_function(n) for n in ("greatest", "least", "sqrt", "exp", "ln", "pow", "floor", "ceil", "abs", "try_divide"))


def lit(x):
    return Text(_text(x))


def col(name: str):
    return Text(f"`{name}`")


def when(condition, value):
    return Case("").when(condition, value)


def struct(*fields):
    return Text("named_struct(" + ", ".join(f"'{name}', {_text(x)}" for name, x in fields) + ")")


def expr(x: Text) -> Column:
    """The Column of a text."""
    return F.expr(x.text)
