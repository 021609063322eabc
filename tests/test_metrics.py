"""Response metrics on known cases."""

import pytest

from pulsegrid.operators import metrics

R = "g string, report_s double, first_dispatch_s double, first_arrival_s double, all_arrival_s double, queue_delay_s double"


def test_intervals(spark):
    out = metrics.response_intervals(spark.createDataFrame([("a", 0.0, 10.0, 70.0, 130.0, 0.0), ("b", 5.0, 1.0, None, 3.0, 0.0)], R)).collect()
    assert (out[0].turnout_s, out[0].first_travel_s, out[0].first_total_s, out[0].full_travel_s, out[0].full_total_s) == (10, 60, 70, 120, 130)
    assert (out[1].turnout_s, out[1].first_travel_s, out[1].full_travel_s, out[1].full_total_s) == (None, None, 2, None)


def test_compliance_and_its_edges(spark):
    rows = [("a", 0.0, 0.0, t, 2 * t, t / 10) for t in (100.0, 200.0, 250.0, 300.0)] + [("b", 0.0, None, None, None, 5.0), ("c", 0.0, 0.0, 60.0, None, 0.0)]
    df = spark.createDataFrame(rows, R)
    out = {r.g: r for r in metrics.compliance(df, ["g"]).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert (a.serviced_incidents, a.first_compliant, a.first_rate, a.first_ok, a.median_first, a.max_first) == (4, 2, 0.5, False, 225, 300)
    assert a.p90_first == pytest.approx(285) and a.mean_queue == pytest.approx(21.25) and a.full_compliant == 2
    assert (b.serviced_incidents, b.first_rate, b.full_rate, b.first_ok, b.full_ok, b.mean_first, b.p95_first) == (0, 0, 1, False, False, 0, 0)
    assert (c.first_ok, c.full_rate, c.full_ok, c.overall_ok) == (True, 0, True, True)
    (none,) = metrics.compliance(df.limit(0)).collect()
    assert (none.total_incidents, none.first_rate, none.max_first, none.overall_ok) == (0, 0, 0, False)
    assert metrics.compliance(df.where("g = 'a'"), use_total=True).first().median_first == 225


def test_latency(spark):
    df = spark.createDataFrame([("x", 1000.0), ("x", 3000.0), ("y", 5000.0)], "k string, elapsed_ns double")
    out = {r.k: r for r in metrics.latency_stats(df, ["k"]).collect()}
    assert (out["x"].n, out["x"].mean, out["x"].p50) == (2, 2, 2) and out["x"].stddev == pytest.approx(2**0.5) and out["y"].stddev == 0
    assert metrics.latency_stats(df, ["k"], "ms").where("k = 'y'").first().max == pytest.approx(0.005)


def test_plans_and_strategies(spark):
    inf = float("inf")
    given = spark.createDataFrame([("i", "fire_engine", True, 30.0), ("i", "ladder_truck", False, inf), ("j", "x", False, inf)], "incident_id string, required_type string, fulfilled boolean, eta_s double")
    out = {r.incident_id: r for r in metrics.dispatch_plan(given).collect()}
    assert (out["i"].all_fulfilled, out["i"].max_eta_s, out["i"].unfulfilled) == (False, 30, ["ladder_truck"]) and out["j"].avg_eta_s == 0
    results = spark.createDataFrame([("s", "static", 100.0), ("s", "polling", 80.0), ("s", "event_driven", 90.0), ("t", "static", inf), ("t", "event_driven", 5.0)], "scenario string, strategy string, travel_time_s double")
    saved = {r.scenario: (r.saved_vs_static_s, r.saved_vs_polling_s) for r in metrics.strategy_comparison(results).collect()}
    assert saved == {"s": (10, 0), "t": (None, None)}


def test_stability_and_detours(spark):
    cases = [(list("abc"), list("abc"), 1), (list("abc"), list("axc"), 0), (list("abcd"), list("abcx"), 0.5), (["a"], ["a"], 1), (["a"], ["b"], 0), ([], [], 1), (["a"], list("ab"), 0)]
    out = metrics.path_stability(spark.createDataFrame([(a, b) for a, b, _ in cases], "initial_path array<string>, executed_path array<string>")).collect()
    assert [r.stability for r in out] == [x for _, _, x in cases]
    times = metrics.detour_delay(spark.createDataFrame([(100.0, 150.0), (100.0, 50.0), (0.0, 5.0)], "initial_s double, actual_s double")).collect()
    assert [(r.detour_delay, r.detour_ratio, r.excess_s) for r in times] == [(0.5, 1.5, 50), (0, 0.5, 0), (0, None, 5)]


def test_scenarios_and_elevations(spark):
    r = spark.createDataFrame([("s", 0.0, 5.0, 65.0, 90.0, 0.0), ("s", 0.0, None, None, None, 8.0)], R).withColumnRenamed("g", "scenario")
    v = spark.createDataFrame([("s", 1, 500.0), ("z", 1, 1.0)], "scenario string, reroute_count int, distance_m double")
    (x,) = metrics.scenario_summary(r, v).collect()
    assert (x.incidents, x.serviced, x.queued, x.mean_response_s, x.mean_queue_s, x.vehicles, x.reroutes) == (2, 1, 1, 65, 8, 1, 1)
    nodes = spark.createDataFrame([("a", 10.0), ("b", None)], "node_id string, elevation_m double")
    edges = spark.createDataFrame([(5.0,), (-2.0,), (None,)], "grade_percent double")
    assert tuple(metrics.elevation_summary(edges, nodes).first()) == (1, 10.0, 10.0, 2, 5.0, -2.0)
    assert [q.elevation_delay for q in metrics.elevation_delay_factor(spark.createDataFrame([(10.0, 12.0), (0.0, 3.0)], "flat_s double, sloped_s double")).collect()] == [1.2, 1.0]
