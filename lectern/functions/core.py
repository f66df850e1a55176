"""Small column helpers that the other function modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to an expression that uses it more than once."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    """Sum of an array of doubles, from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def r6(c: Column, name: str) -> Column:
    """A result column: rounded to six decimals, without negative zero."""
    return (F.round(c, 6) + 0.0).alias(name)


def half_even(c: Column) -> Column:
    """Rounds to the nearest integer, halves to the even one."""
    return F.rint(c)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for none to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
