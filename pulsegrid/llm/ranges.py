"""Helpers for ranges of a key whose bounds are few and known."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _constant(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def position(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= key, by a coarse and a fine look of about sqrt(n) steps each."""
    if not bounds:
        return F.lit(0)
    step = max(1, isqrt(len(bounds)))
    coarse = F.size(F.filter(_constant(bounds[::step]), lambda b: b <= key))
    low = F.greatest(coarse - 1, F.lit(0)) * step
    return (low + F.size(F.filter(F.slice(_constant(bounds), low + 1, F.lit(step)), lambda b: b <= key))).cast("int")


def numbered(rows: DataFrame, units: list[tuple], unit_cols: dict[str, str], order: list[Column]) -> DataFrame:
    """``rows`` joined to a table of units (its size is the caller's bound) and ``slot``, a unit's offset plus the rank in it.

    ``units`` has the columns of ``unit_cols`` (name to type); those that rows have too are the unit's key, and
    "offset" is where its numbers start. So numbers run on without gaps over units, and no task orders
    more than one unit.
    """
    spark: SparkSession = rows.sparkSession
    table = spark.createDataFrame(units, ", ".join(f"{n} {t}" for n, t in unit_cols.items()))
    keys = [c for c in unit_cols if c in rows.columns]
    joined = rows.join(F.broadcast(table), keys)
    return joined.withColumn("slot", F.col("offset") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
