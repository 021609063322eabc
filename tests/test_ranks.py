"""Exact percentiles against numpy, over groups that range partitioning splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import metrics
from pulsegrid.operators.ranks import percentiles_of

SHARES = [0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0]


def counted(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    return df.groupBy("k", "v").agg(F.count("*").alias("n"))


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_numpy(spark, seed):
    r = random.Random(seed)
    rows = [("big", float(r.randrange(40_000))) for _ in range(30_000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0)]
    rows += [("same", 7.0)] * 3000 + [(None, float(i)) for i in range(10)] + [("none", None), ("big", None)]
    out = {x.k: x.p for x in percentiles_of(counted(spark, rows), ["k"], "v", "n", SHARES).collect()}
    assert set(out) == {"big", "one", "two", "same", None}
    for k, p in out.items():
        assert p == pytest.approx(np.quantile([v for g, v in rows if g == k and v is not None], SHARES).tolist(), rel=1e-12)


def test_one_group_without_keys_is_spread_over_ranges(spark):
    rows = [("x", float(i * 7919 % 50_021)) for i in range(50_000)]
    assert percentiles_of(counted(spark, rows), [], "v", "n", [0.25]).first().p == pytest.approx([np.quantile([v for _, v in rows], 0.25)])
    assert percentiles_of(counted(spark, rows).limit(0), [], "v", "n", [0.5]).collect() == []


def test_no_plan_holds_a_group_in_one_buffer(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0, 5.0, 5.0, 0.0)], "g string, report_s double, first_dispatch_s double, first_arrival_s double, all_arrival_s double, queue_delay_s double")
    for df in (metrics.compliance(rows, ["g"]), metrics.latency_stats(rows.selectExpr("g", "first_arrival_s AS elapsed_ns"), ["g"])):
        assert "percentile" not in df._jdf.queryExecution().toString().replace("percentiles", "")


def test_null_groups_keep_their_percentiles(spark):
    rows = spark.createDataFrame([(None, 0.0, 0.0, t, t, 0.0) for t in (1.0, 2.0, 4.0)], "g string, report_s double, first_dispatch_s double, first_arrival_s double, all_arrival_s double, queue_delay_s double")
    (out,) = metrics.compliance(rows, ["g"]).collect()
    assert (out.g, out.total_incidents, out.median_first) == (None, 3, 2.0)
