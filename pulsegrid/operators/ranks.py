"""Exact percentiles of groups of any size.

A group's values are counted first, so repeated values are one row. The rows are then dealt by ranges of (group,
value): a large group is spread over many tasks, and no task holds more than its range. Counts of the ranges tell in
which of them a wanted rank lies, and only those rows are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.plans.lineage import cut


def _steps(place: Column, low: Column, high: Column) -> Column:
    """The value between two neighbours at a fractional place."""
    share = place - F.floor(place)
    return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)


def percentiles_of(counted: DataFrame, keys: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """(keys, p): for each group the exact percentiles at ``shares`` of its values, interpolated between two ranks.

    ``counted`` holds each value of a group once with how often it occurs (``n``); null values count for nothing,
    and a group without values gets no row. Keys may be null; without keys there is one group. Wherever a group's
    rows lie, tasks read ranges of about equal size.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    rows = counted.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"), F.col(n).alias("n"))
    dealt = rows.repartitionByRange("g", "v").select("g", "v", "n", F.spark_partition_id().alias("lot"))
    dealt = cut(dealt)

    lots = dealt.groupBy("g", "lot").agg(F.sum("n").alias("n"))
    of_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(of_group.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = lots.select("g", "lot", "n", before.alias("before"), F.sum("n").over(of_group).alias("total"))

    last = F.col("total") - 1
    asked = F.array(*[F.struct(F.lit(i).alias("i"), (last * float(p)).alias("place")) for i, p in enumerate(shares)])
    ranked = lots.withColumn("ask", F.explode(asked)).select("*", "ask.*")
    floor = F.floor("place")
    ends = F.array_distinct(F.array(floor, F.least(floor + 1, last)))
    ranked = ranked.withColumn("rank", F.explode(ends))
    here = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    wanted = ranked.where(here).select("g", "lot", "i", "place", "rank", "before")

    in_lot = Window.partitionBy("g", "lot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.join(wanted.select("g", "lot").distinct(), ["g", "lot"], "left_semi")
    run = held.select("g", "lot", "v", "n", F.sum("n").over(in_lot).alias("upto"))
    at = F.col("rank") - F.col("before")
    met = run.join(wanted, ["g", "lot"]).where((at < F.col("upto")) & (at >= F.col("upto") - F.col("n")))
    pairs = met.groupBy("g", "i").agg(F.first("place").alias("place"), F.min("v").alias("low"), F.max("v").alias("high"))
    one = F.struct("i", _steps(F.col("place"), F.col("low"), F.col("high")).alias("p"))
    out = pairs.groupBy("g").agg(F.sort_array(F.collect_list(one)).alias("ps"))
    names = [F.col("g")[k].alias(k) for k in keys]
    return out.select(*names, F.transform("ps", lambda s: s["p"]).alias("p"))
