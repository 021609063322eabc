"""Exports: GeoJSON features, CSV tables and JSON documents, each a projection that any text writer can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.metrics import response_intervals


def _pair(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def network_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature): a Point for each node, with its out-degree, and a LineString for each edge."""
    degree = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    points = nodes.where("lon IS NOT NULL AND lat IS NOT NULL").join(degree, "node_id", "left").select(_feature("Point", F.array("lon", "lat"), F.struct("node_id", *[c for c in ("label",) if c in nodes.columns], F.coalesce("out_degree", F.lit(0)).alias("out_degree"))).alias("feature"))
    at = nodes.select("node_id", F.array("lon", "lat").alias("at"))
    lines = edges.join(at.select(F.col("node_id").alias("src"), F.col("at").alias("a")), "src").join(at.select(F.col("node_id").alias("dst"), F.col("at").alias("b")), "dst")
    return points.union(lines.select(_feature("LineString", F.array("a", "b"), F.struct(F.col("src").alias("source"), F.col("dst").alias("destination"), "cost"))))


def network_bounds(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def street_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature): one LineString for each pair of joined nodes, severed if every road between them is blocked."""
    shut = F.coalesce(F.col("blocked"), F.lit(False)) if "blocked" in edges.columns else F.lit(False)
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bool_and(shut).alias("severed"))
    at = nodes.select("node_id", F.array("lon", "lat").alias("at"))
    met = pairs.join(at.select(F.col("node_id").alias("a"), F.col("at").alias("p")), "a").join(at.select(F.col("node_id").alias("b"), F.col("at").alias("q")), "b")
    return met.select(_feature("LineString", F.array("p", "q"), F.struct("a", "b", "severed")).alias("feature"))


def route_features(routes: DataFrame, nodes: DataFrame, key: str = "route_id") -> DataFrame:
    """(key, collection): the route's LineString and its waypoints with roles; without a way an empty collection."""
    at = nodes.select(F.col("node_id").alias("node"), "lon", "lat")
    steps = routes.select(key, F.size("path").alias("n"), F.posexplode("path").alias("pos", "node")).join(at, "node")
    role = F.when(F.col("pos") == 0, "origin").when(F.col("pos") == F.col("n") - 1, "destination").otherwise("waypoint")
    way = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "lon", "lat", role.alias("role")))).alias("w"))
    geometry = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry("LineString", F.transform("w", _pair)).alias("geometry"), F.struct(F.lit("route").alias("kind")).alias("properties")))
    dots = F.transform("w", lambda p: F.to_json(F.struct(F.lit("Feature").alias("type"), geometry("Point", _pair(p)).alias("geometry"), F.struct(p["node"].alias("node_id"), p["pos"].alias("order"), p["role"].alias("role")).alias("properties"))))
    features = F.when(F.size("w") > 0, F.concat(F.array(line), dots)).otherwise(F.array().cast("array<string>"))
    out = routes.select(key).join(way, key, "left")
    return out.select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.coalesce(F.array_join(features, ","), F.lit("")), F.lit("]}")).alias("collection"))


def hazard_features(hazards: DataFrame) -> DataFrame:
    """(feature): a Polygon with a closed ring for each hazard."""
    closed = F.concat(F.transform("ring", _pair), F.slice(F.transform("ring", _pair), 1, 1))
    return hazards.select(_feature("Polygon", F.array(closed), F.struct("hazard_id", "hazard_type", "severity", "speed_multiplier", "active")).alias("feature"))


def incident_rows(responses: DataFrame) -> DataFrame:
    """The fifteen columns of the incident export as text: two decimals, blanks for nulls, units joined by semicolons."""
    r = response_intervals(responses)
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).otherwise("")
    names = [("report_s", "report_time_s"), ("first_dispatch_s", "first_dispatch_time_s"), ("first_arrival_s", "first_arrival_time_s"), ("all_arrival_s", "all_arrival_time_s"), ("cleared_s", "cleared_time_s"), ("queue_delay_s", "queue_delay_s"), ("turnout_s", "turnout_time_s"), ("first_travel_s", "first_travel_time_s"), ("first_total_s", "first_total_response_time_s"), ("full_travel_s", "full_alarm_travel_time_s")]
    units = F.coalesce("assigned_units", F.array().cast("array<string>"))
    return r.select("incident_id", "emergency_type", "urgency", *[number(c).alias(n) for c, n in names], F.size(units).alias("units_count"), F.array_join(units, ";").alias("assigned_units"))


def strategy_rows(results: DataFrame) -> DataFrame:
    """The ten columns of the strategy export as text; an infinite time is STALLED."""
    fixed = lambda c, d: F.format_string(f"%.{d}f", F.col(c))
    return results.select(
        F.col("scenario").alias("scenario_name"), "strategy", F.col("arrived").cast("string").alias("arrived"), F.when(F.col("travel_time_s") < float("inf"), fixed("travel_time_s", 2)).otherwise("STALLED").alias("travel_time_seconds"), fixed("distance_m", 2).alias("total_distance_meters"),
        "reroute_count", F.col("stalled").cast("string").alias("stalled"), F.when(F.col("polling_interval_s").isNotNull(), fixed("polling_interval_s", 1)).otherwise("").alias("polling_interval_seconds"), fixed("stability", 4).alias("path_stability_index"), fixed("detour_delay", 4).alias("detour_delay_factor"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """A one-column frame as text, a feature or document a line."""
    rows.write.mode("overwrite").text(path)


def telemetry_documents(summary: DataFrame, incidents: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(scenario, document): one JSON document per scenario with its summary, incidents and vehicles."""
    pack = lambda df, name: df.groupBy("scenario").agg(F.sort_array(F.collect_list(F.to_json(F.struct(*[c for c in df.columns if c != "scenario"])))).alias(name))
    head = summary.select("scenario", F.to_json(F.struct(*[c for c in summary.columns if c != "scenario"])).alias("s"))
    met = head.join(pack(incidents, "i"), "scenario", "left").join(pack(vehicles, "v"), "scenario", "left")
    part = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return met.select("scenario", F.concat(F.lit('{"summary":'), "s", F.lit(',"incidents":['), part("i"), F.lit('],"vehicles":['), part("v"), F.lit("]}")).alias("document"))


def replay_features(nodes: DataFrame, edges: DataFrame, stations: DataFrame, incidents: DataFrame, hazards: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(layer, feature): network, stations, incidents, hazards and trajectories in one table."""
    layer = lambda df, name: df.select(F.lit(name).alias("layer"), "feature")
    at = nodes.select("node_id", "lon", "lat")
    station = stations.join(at, "node_id").select(_feature("Point", F.array("lon", "lat"), F.struct("station_id", "name", "station_type")).alias("feature"))
    incident = incidents.select(_feature("Point", F.array("lon", "lat"), F.struct("incident_id", "emergency_type", "urgency")).alias("feature"))
    path = trajectories.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("tick_s", "lon", "lat"))).alias("p"))
    track = path.select(_feature("LineString", F.transform("p", _pair), F.struct("unit_id", F.transform("p", lambda x: x["tick_s"]).alias("times_s"))).alias("feature"))
    parts = [layer(network_features(nodes, edges), "network"), layer(station, "stations"), layer(incident, "incidents"), layer(hazard_features(hazards), "hazards"), layer(track, "trajectories")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_digests(spark, paths: str | list[str]) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))
