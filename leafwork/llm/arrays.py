"""Running sums and maxima over array columns, in built-in functions, at n * sqrt(n) for long arrays.

A fold that appends copies its array at each step. Here an array is cut into about sqrt(n) chunks; each is folded by
itself, then each is put on top of what the chunks before it came to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(xs: Column, kind: str, op: Callable[[Column, Column], Column]) -> Column:
    step = lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, op(F.element_at(a, -1), x)).otherwise(x)))
    return F.aggregate(xs, F.array().cast(f"array<{kind}>"), step)


def running(xs: Column, kind: str, op: Callable[[Column, Column], Column]) -> Column:
    """op over x[0..i] for each i; op is associative, kind the type of its values and of the elements."""

    def long(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda c: _folded(F.slice(xs, c * width + 1, width), kind, op))
        on = lambda parts, ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: op(F.element_at(ends, i), x)))))
        return let(parts, lambda parts: let(_folded(F.transform(parts, lambda p: F.element_at(p, -1)), kind, op), lambda ends: on(parts, ends)))

    return let(xs, lambda xs: F.when(F.size(xs) <= SHORT, _folded(xs, kind, op)).otherwise(long(xs)))


def sums(xs: Column) -> Column:
    return running(F.transform(xs, lambda x: x.cast("int")), "int", lambda a, b: a + b)


def earlier(xs: Column, first: Column) -> Column:
    """The elements moved on by one place, with first in front."""
    return F.when(F.size(xs) > 0, F.concat(F.array(first), F.slice(xs, 1, F.size(xs) - 1))).otherwise(xs)
