"""Array building blocks for the operators that stay within Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind a column expression to a variable of ``body``: it is evaluated once for a row, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def positions(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def at(array: Column, i) -> Column:
    """Element i, counted from 0; null outside."""
    return F.get(array, i)


def run_starts(keys: Column, key_of) -> Column:
    """Positions at which a sorted array's key changes, the first one included."""
    return F.filter(positions(F.size(keys)), lambda i: (i == 0) | (key_of(at(keys, i)) != key_of(at(keys, i - 1))))


def lengths(starts: Column, n: Column) -> Column:
    """Lengths of the runs that begin at ``starts`` in an array of n elements."""
    return F.transform(starts, lambda s, i: F.coalesce(at(starts, i + 1), n) - s)
