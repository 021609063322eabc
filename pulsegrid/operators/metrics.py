"""Response-time metrics as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import geo
from pulsegrid.operators.ranks import percentiles_of
from pulsegrid.plans.lineage import cut


def _interval(start: Column, end: Column) -> Column:
    return F.when(end >= start, end - start)


def response_intervals(responses: DataFrame) -> DataFrame:
    """``responses`` with turnout_s and the travel and total times of the first and the full alarm; null if missing or negative."""
    report, dispatch = F.col("report_s"), F.col("first_dispatch_s")
    return responses.select(
        "*",
        _interval(report, dispatch).alias("turnout_s"),
        _interval(dispatch, F.col("first_arrival_s")).alias("first_travel_s"),
        _interval(report, F.col("first_arrival_s")).alias("first_total_s"),
        _interval(dispatch, F.col("all_arrival_s")).alias("full_travel_s"),
        _interval(report, F.col("all_arrival_s")).alias("full_total_s"),
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a group at most); null keys meet."""
    if not keys:
        return left.join(F.broadcast(right), how="left")  # one row at most
    names = {k: f"_r_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()]
    return left.join(right.withColumnsRenamed(names), same, "left").drop(*names.values())


def compliance(
    responses: DataFrame,
    by: list[str] | None = None,
    first_s: float = 240.0,
    full_s: float = 480.0,
    target: float = 0.90,
    use_total: bool = False,
) -> DataFrame:
    """Response-time compliance, one row per group (one row in all if there is none, even of an empty table).

    Rates are shares of serviced incidents. Without full-alarm times the full rate is 1 if nothing was serviced
    and else 0, and the full flag follows the first. Incidents are first added up for each first-alarm time; sums
    and exact percentiles follow from that table, which is written once and whatever a group's size is read in ranges.
    """
    first, full = (F.col(f"{k}_{'total' if use_total else 'travel'}_s") for k in ("first", "full"))
    keys = by or []
    counted = cut(
        response_intervals(responses)
        .groupBy(*keys, first.alias("_v"))
        .agg(
            F.count("*").alias("_n"),
            F.count(full).alias("_m"),
            F.count_if(full <= full_s).alias("_in_full"),
            F.sum("queue_delay_s").alias("_queue"),
            F.count("queue_delay_s").alias("_queued"),
            F.max("queue_delay_s").alias("_longest"),
        )
    )
    served = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda total, n: F.coalesce(total / F.when(n > 0, n), F.lit(0.0))
    base = counted.groupBy(*keys).agg(
        whole("_n").alias("total_incidents"),
        whole(served).alias("serviced_incidents"),
        whole("_m").alias("_full"),
        whole(F.when(F.col("_v") <= first_s, F.col("_n"))).alias("first_compliant"),
        whole("_in_full").alias("full_compliant"),
        mean(F.sum(F.col("_v") * F.col("_n")), F.sum(served)).alias("mean_first"),
        F.coalesce(F.max("_v"), F.lit(0.0)).alias("max_first"),
        mean(F.sum("_queue"), F.sum("_queued")).alias("mean_queue"),
        F.coalesce(F.max("_longest"), F.lit(0.0)).alias("max_queue"),
    )
    base = _joined(base, percentiles_of(counted, keys, "_v", "_n", [0.5, 0.9, 0.95]), keys)
    n, m = F.col("serviced_incidents"), F.col("_full")
    first_rate = F.when(n > 0, F.col("first_compliant") / n).otherwise(0.0)
    full_rate = F.when(m > 0, F.col("full_compliant") / m).when(n == 0, 1.0).otherwise(0.0)
    first_ok = (n > 0) & (first_rate >= target)
    full_ok = F.when(m > 0, full_rate >= target).otherwise(first_ok)
    at = lambda i: F.coalesce(F.col("p")[i], F.lit(0.0))
    return base.select(
        *keys,
        "total_incidents",
        "serviced_incidents",
        "first_compliant",
        first_rate.alias("first_rate"),
        "full_compliant",
        full_rate.alias("full_rate"),
        first_ok.alias("first_ok"),
        full_ok.alias("full_ok"),
        (first_ok & full_ok).alias("overall_ok"),
        "mean_first",
        at(0).alias("median_first"),
        at(1).alias("p90_first"),
        at(2).alias("p95_first"),
        "max_first",
        "mean_queue",
        "max_queue",
    )


def latency_stats(measurements: DataFrame, by: list[str], unit: str = "us") -> DataFrame:
    """Statistics of ``elapsed_ns`` in microseconds or milliseconds; the deviation of one value is 0.

    The percentiles are exact and of bounded memory, whatever a group's size (see ``ranks.percentiles_of``).
    """
    x = F.col("elapsed_ns") / {"us": 1e3, "ms": 1e6}[unit]
    rows = measurements.select(*by, x.alias("_v"))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("_v").alias("mean"),
        F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("stddev"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    counted = cut(rows.groupBy(*by, "_v").agg(F.count("*").alias("_n")))
    out = _joined(base, percentiles_of(counted, by, "_v", "_n", [0.5, 0.9, 0.95, 0.99]), by)
    points = [F.col("p")[i].alias(k) for i, k in enumerate(("p50", "p90", "p95", "p99"))]
    return out.select(*by, "n", "mean", "stddev", "min", *points, "max")


def dispatch_plan(assignments: DataFrame) -> DataFrame:
    """One row per incident: whether all is fulfilled, the largest and mean ETA of what is, and what is lacking."""
    eta = F.when(F.col("fulfilled") & (F.col("eta_s") < float("inf")), F.col("eta_s"))
    return assignments.groupBy("incident_id").agg(
        F.bool_and("fulfilled").alias("all_fulfilled"),
        F.coalesce(F.max(eta), F.lit(0.0)).alias("max_eta_s"),
        F.coalesce(F.avg(eta), F.lit(0.0)).alias("avg_eta_s"),
        F.sort_array(F.collect_list(F.when(~F.col("fulfilled"), F.col("required_type")))).alias("unfulfilled"),
    )


def scenario_summary(responses: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Per scenario: serviced and queued incidents, response and queue times, reroutes and distance of vehicles."""
    r = response_intervals(responses)
    queued = F.when(F.col("queue_delay_s") > 0, F.col("queue_delay_s"))
    calls = r.groupBy("scenario").agg(F.count("*").alias("incidents"), F.count("first_total_s").alias("serviced"), F.count(queued).alias("queued"), F.coalesce(F.avg("first_total_s"), F.lit(0.0)).alias("mean_response_s"), F.coalesce(F.max("first_total_s"), F.lit(0.0)).alias("max_response_s"), F.coalesce(F.avg(queued), F.lit(0.0)).alias("mean_queue_s"), F.coalesce(F.max(queued), F.lit(0.0)).alias("max_queue_s"))
    cars = vehicles.groupBy("scenario").agg(F.count("*").alias("vehicles"), F.sum("reroute_count").alias("reroutes"), F.sum("distance_m").alias("distance_m"))
    zero = ["vehicles", "reroutes", "distance_m"]
    return calls.join(cars, "scenario", "left").fillna(0, zero)


def strategy_comparison(results: DataFrame) -> DataFrame:
    """Per scenario: travel time of each strategy and what the event-driven one saves against the others.

    Savings are 0 at least, and null where either time is infinite or missing.
    """
    names = ["static", "polling", "event_driven"]
    wide = results.groupBy("scenario").pivot("strategy", names).agg(F.first("travel_time_s"))
    own = F.col("event_driven")
    saving = lambda c: F.when((F.col(c) < float("inf")) & (own < float("inf")), F.greatest(F.lit(0.0), F.col(c) - own))
    return wide.select("*", saving("static").alias("saved_vs_static_s"), saving("polling").alias("saved_vs_polling_s"))


def path_stability(missions: DataFrame) -> DataFrame:
    """``missions`` with stability: the Jaccard similarity of the directed steps of initial_path and executed_path.

    Paths without steps are as stable as they are equal; if only one has none it is 0.
    """
    a, b = F.array_distinct(geo.path_pairs(F.col("initial_path"))), F.array_distinct(geo.path_pairs(F.col("executed_path")))
    none = F.when(F.coalesce(F.col("initial_path") == F.col("executed_path"), F.lit(False)), 1.0).otherwise(0.0)
    shared = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return missions.withColumn("stability", F.when((F.size(a) <= 0) & (F.size(b) <= 0), none).when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(shared))


def detour_delay(missions: DataFrame) -> DataFrame:
    """``missions`` with detour_delay (share of the initial time lost, 0 at least), detour_ratio (actual / initial) and excess_s."""
    a, b = F.col("initial_s"), F.col("actual_s")
    return missions.select("*", F.when(a > 0, F.greatest(F.lit(0.0), (b - a) / a)).otherwise(0.0).alias("detour_delay"), F.when(a > 0, b / a).alias("detour_ratio"), F.greatest(F.lit(0.0), b - a).alias("excess_s"))


def elevation_delay_factor(routes: DataFrame) -> DataFrame:
    """``routes`` with elevation_delay: time with slopes over flat time, 1 if there is no flat time."""
    return routes.withColumn("elevation_delay", F.when(F.col("flat_s") > 0, F.col("sloped_s") / F.col("flat_s")).otherwise(1.0))


def elevation_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes and edges with elevations, and the extremes of height and grade."""
    high = nodes.agg(F.count("elevation_m").alias("nodes_enriched"), F.min("elevation_m").alias("min_elevation_m"), F.max("elevation_m").alias("max_elevation_m"))
    steep = edges.agg(F.count("grade_percent").alias("edges_enriched"), F.greatest(F.coalesce(F.max("grade_percent"), F.lit(0.0)), F.lit(0.0)).alias("max_up_percent"), F.least(F.coalesce(F.min("grade_percent"), F.lit(0.0)), F.lit(0.0)).alias("max_down_percent"))
    return high.join(steep)


def board_counts(rows: DataFrame, col: str) -> DataFrame:
    """How many rows have each value, for boards of urgencies or unit states."""
    return rows.groupBy(col).agg(F.count("*").alias("n"))
