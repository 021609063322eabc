"""Helpers over array columns, in Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column) -> Column:
    """``start`` plus the sum of the elements before each one."""
    zero = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def offsets(lengths: Column) -> Column:
    """The sum of the elements before each element of an array of longs.

    Appending copies an array, so sums run over blocks of about sqrt(n) elements: n * sqrt(n) references are
    copied in all, and not n * n.
    """

    def summed(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), side), lambda at: F.slice(v, at, side))

        def joined(b: Column) -> Column:
            before = _running(F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)), F.lit(0).cast("long"))
            return F.flatten(F.zip_with(b, before, _running))

        return F.when(F.size(v) > 0, let(blocks, joined)).otherwise(F.array().cast("array<long>"))

    return let(lengths.cast("array<long>"), summed)
