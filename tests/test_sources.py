"""Readers and exports on small documents."""

import csv
import json
import struct

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.network import shortest_paths
from pulsegrid.sources import exports, feeds, maps

OSM = {
    "elements": [
        *[{"type": "node", "id": i, "lat": 47.0 + i / 1000, "lon": -122.0, "tags": {"name": f"corner {i}"} if i == 1 else {}} for i in range(1, 8)],
        {"type": "way", "id": 10, "nodes": [1, 2, 3], "tags": {"highway": "primary", "maxspeed": "30 mph", "name": "Main"}},
        {"type": "way", "id": 11, "nodes": [3, 4], "tags": {"highway": "secondary", "oneway": "yes"}},
        {"type": "way", "id": 12, "nodes": [4, 5], "tags": {"highway": "residential", "access": "private"}},
        {"type": "way", "id": 13, "nodes": [4, 6, 99], "tags": {"highway": "service", "oneway": "-1"}},
        {"type": "way", "id": 14, "nodes": [1, 7], "tags": {"building": "yes"}},
        {"type": "relation", "id": 20},
    ]
}
EDGES = {("1", "2"), ("2", "1"), ("2", "3"), ("3", "2"), ("3", "4"), ("6", "4")}


def put(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def test_osm_json(spark, tmp_path):
    nodes, edges = maps.read_osm_json(spark, put(tmp_path / "m.json", OSM), "travel_time")
    assert {r.node_id for r in nodes.collect()} == {"1", "2", "3", "4", "6"}
    assert nodes.where("node_id = '1'").first().label == "corner 1"
    rows = {(r.src, r.dst): r for r in edges.collect()}
    assert set(rows) == EDGES
    r = rows["1", "2"]
    assert r.maxspeed_kmh == pytest.approx(48.28032) and r.distance_m == pytest.approx(111.19, abs=0.01) and r.cost == r.travel_time_s == pytest.approx(r.distance_m / (48.28032 / 3.6))
    assert r.emergency_time_s == pytest.approx(r.travel_time_s / 1.15) and (r.name, r.highway) == ("Main", "primary")
    assert {(r.src, r.dst) for r in maps.read_osm_json(spark, str(tmp_path / "m.json"), highways=["secondary"])[1].collect()} == {("3", "4")}


def test_osm_xml(spark, tmp_path):
    tags = lambda e: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in {**e.get("tags", {}), "": "x", "empty": ""}.items())
    body = "".join(f'<node id="{e["id"]}" lat="{e["lat"]}" lon="{e["lon"]}">{tags(e)}</node>' if e["type"] == "node" else f'<way id="{e["id"]}">' + "".join(f'<nd ref="{n}"/>' for n in e["nodes"]) + tags(e) + "</way>" for e in OSM["elements"] if e["type"] != "relation")
    nodes, edges = maps.read_osm_xml(spark, put(tmp_path / "m.osm", f'<osm version="0.6">{body}</osm>'))
    assert {(r.src, r.dst) for r in edges.collect()} == EDGES and nodes.count() == 5
    assert edges.where("src = '1'").first().maxspeed_kmh == pytest.approx(48.28032)


def test_geojson_network(spark, tmp_path):
    f = lambda kind, c, i=None, **p: {"type": "Feature", "id": i, "geometry": {"type": kind, "coordinates": c}, "properties": p}
    doc = {"type": "FeatureCollection", "features": [f("Point", [0, 0], node_id="a", label="A"), f("Point", [0, 1], "b"), f("Point", [200, 1], "far"), f("LineString", [[0, 0], [0, 1]], source="a", destination="b", cost=7), f("LineString", [[0, 1], [0, 2]], source="b", destination="c"), f("LineString", [[1, 0], [1, 1], [1, 2]])]}
    nodes, edges, rejects = maps.read_geojson_network(spark, put(tmp_path / "n.geojson", doc))
    got = {r.node_id: (r.label, r.lon, r.lat) for r in nodes.collect()}
    assert got["a"] == ("A", 0, 0) and got["b"] == ("Node b", 0, 1) and got["c"] == (None, 0, 2) and got["line_5_seg_2"] == (None, 1, 2)
    assert [r.code for r in rejects.collect()] == ["invalid_coordinates"]
    cost = {(r.src, r.dst): r.cost for r in edges.collect()}
    assert cost["a", "b"] == 7 and cost["b", "c"] == pytest.approx(111194.9, abs=0.1) and ("line_5_seg_0", "line_5_seg_1") in cost and len(cost) == 4


CAP = """<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>W1</identifier><sender>nws</sender><sent>2026-01-01T10:00:00+00:00</sent><msgType>Alert</msgType>
<info><event>Flash Flood Warning</event><urgency>Immediate</urgency><severity>Severe</severity><certainty>Odd</certainty><expires>not a date</expires><description>Water</description>
<area><areaDesc>x</areaDesc><polygon>47.1,-122.1 47.2,-122.1 bad 47.2,-122.2 47.1,-122.1</polygon><polygon>1,2 3,4</polygon></area></info></alert>"""


def test_cap_alerts(spark, tmp_path):
    put(tmp_path / "a.xml", CAP)
    put(tmp_path / "b.xml", "<alert><identifier>E2</identifier></alert>")
    alerts = feeds.read_cap_alerts(spark, str(tmp_path), "2026-02-02 00:00:00")
    out = {r.identifier: r for r in alerts.collect()}
    a, b = out["W1"], out["E2"]
    assert (a.event, a.severity, a.certainty, a.expires_at, str(a.sent_at)) == ("Flash Flood Warning", "Severe", "Observed", None, "2026-01-01 10:00:00")
    assert [[(p.lon, p.lat) for p in ring] for ring in a.polygons] == [[(-122.1, 47.1), (-122.1, 47.2), (-122.2, 47.2)]]
    assert (b.sender, b.event, b.urgency, b.severity, b.polygons) == ("UNKNOWN_AGENCY", "General Emergency", "Immediate", "Severe", [])
    (h,) = feeds.alerts_to_hazards(alerts).collect()
    assert (h.hazard_id, h.hazard_type, h.severity, h.speed_multiplier, h.description) == ("cap_W1_1", "flash_flood", "severe", 0.0, "Flash Flood Warning: Water")


def test_geojson_alerts(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"event": "Wild Fire", "severity": "low"}}, {"type": "Feature", "id": "s", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"hazard_type": "smoke", "speed_multiplier": 0.4}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {}}]}
    out = {r.hazard_id: r for r in feeds.read_geojson_alerts(spark, put(tmp_path / "g.json", doc)).collect()}
    assert (out["geojson_alert_1"].hazard_type, out["geojson_alert_1"].speed_multiplier, len(out["geojson_alert_1"].ring)) == ("wildfire_perimeter", 0.0, 3)
    assert (out["s"].hazard_type, out["s"].speed_multiplier) == ("toxic_gas_plume", 0.4)


def test_pois(spark, tmp_path):
    e = lambda i, tags, kind="node", **more: {"type": kind, "id": i, "tags": tags, **({"lat": 47.6, "lon": -122.3} if kind == "node" else {"center": {"lat": 47.6, "lon": -122.3}}), **more}
    doc = {"elements": [
        e(1, {"amenity": "hospital", "name": "H", "emergency:trauma_level": "1", "healthcare:speciality": "cardiology;burn;pediatrics", "emergency:helipad": "yes", "addr:street": "9th Ave", "addr:housenumber": "325", "addr:city": "Seattle"}),
        e(2, {"amenity": "fire_station", "fire_station:engine_bays": "3", "hazmat": "yes"}, "way"), e(3, {"aeroway": "helipad"}, "relation"), e(4, {"emergency": "ambulance_station"}), e(5, {"amenity": "police"}), e(6, {"amenity": "clinic"}), e(7, {"emergency": "control_centre"}),
        e(8, {"amenity": "hospital", "healthcare:speciality": "stroke"}), e(9, {"amenity": "restaurant"}), {"type": "node", "id": 10, "tags": {"amenity": "hospital"}},
    ]}
    out = {r.osm_id: r for r in feeds.read_pois(spark, put(tmp_path / "p.json", doc)).collect()}
    assert {i: r.poi_type for i, r in out.items()} == {1: "hospital", 2: "fire_station", 3: "helipad", 4: "ambulance_station", 5: "police", 6: "urgent_care", 7: "dispatch_center", 8: "hospital"}
    assert out[1].capabilities == ["burn_center", "cardiac_care", "helipad", "pediatric_care", "trauma_level_1"] and out[1].address == "325, 9th Ave, Seattle" and out[1].trauma_level == 1
    assert out[2].apparatus_bays == 3 and "hazmat_decon" in out[2].capabilities and "Unnamed Hospital" in out[8].name and "stroke_center" in out[8].capabilities


def test_gauges_and_weather(spark, tmp_path):
    series = lambda site, code, *v: {"sourceInfo": {"siteName": f"River {site}", "siteCode": [{"value": site}], "geoLocation": {"geogLocation": {"latitude": "47.5", "longitude": "-122.0"}}}, "variable": {"variableCode": [{"value": code}]}, "values": [{"value": [{"value": x, "dateTime": t} for x, t in v]}]}
    doc = {"value": {"timeSeries": [series("A", "00065", ("10.0", "2026-01-01T00:00:00"), ("16.5", "2026-01-01T01:00:00")), series("A", "00060", ("300", "2026-01-01T01:00:00")), series("B", "00060", ("5", "2026-01-01T01:00:00")), series("C", "00065", ("bad", "x"))]}}
    steps = spark.createDataFrame([("A", 12.0, 15.0, 18.0, 22.0)], "site_id string, action_ft double, minor_ft double, moderate_ft double, major_ft double")
    gauges = feeds.read_gauges(spark, put(tmp_path / "g.json", doc), steps)
    (g,) = gauges.collect()
    assert (g.site_id, g.gage_height_ft, g.streamflow_cfs, g.flood_stage) == ("A", 16.5, 300, "minor") and g.gage_height_m == pytest.approx(5.0292)
    (h,) = feeds.gauges_to_hazards(gauges).collect()
    assert (h.severity, h.speed_multiplier, len(h.ring)) == ("moderate", 0.5, 12) and feeds.gauges_to_hazards(gauges, 750.0).first().speed_multiplier == 0.25
    now = lambda t, c, w, r, x=14.0: json.dumps({"latitude": 47.6, "longitude": -122.3, "current": {"time": t, "weather_code": c, "temperature_2m": x, "wind_speed_10m": w, "precipitation": r}})
    for k, text in enumerate([now("2026-01-01T10:30", 3, 12, 0), now("odd", 0, 92, 2), now("2026-01-01T10:30", 65, 35, 20), now("2026-01-01T10:30", 65, 40, 0, 41.0)]):
        put(tmp_path / f"w{k}.json", text)
    weather = feeds.read_weather(spark, [str(tmp_path / f"w{k}.json") for k in range(4)], "2026-02-02 00:00:00")
    assert sorted(r.alert_level for r in weather.collect()) == ["none", "warning", "watch", "watch"]
    out = sorted((r.severity, r.speed_multiplier, r.hazard_type) for r in feeds.weather_to_hazards(weather).collect())
    assert out == [("critical_blocked", 0.0, "flood_inundation"), ("severe", 0.35, "flood_inundation"), ("severe", 0.35, "wildfire_perimeter")]
    s = feeds.environmental_summary(gauges, weather).first()
    assert (s.gauges, s.flooding, s.weather_points, s.weather_alerts) == (1, 1, 4, 3)


def test_dem(spark, tmp_path):
    (tmp_path / "N37W123.hgt").write_bytes(struct.pack(">9h", *range(9)))
    (tmp_path / "S01E010.hgt").write_bytes(struct.pack(">4h", -5, 6, 7, -32768))
    (tmp_path / "notes.hgt").write_bytes(b"\0" * 8)
    rows = sorted((r.lat0, r.lon0, r.n, r.row, list(r.z)) for r in feeds.read_dem(spark, str(tmp_path)).collect())
    assert rows == [(-1, 10, 2, 0, [-5, 6]), (-1, 10, 2, 1, [7, -32768]), (37, -123, 3, 0, [0, 1, 2]), (37, -123, 3, 1, [3, 4, 5]), (37, -123, 3, 2, [6, 7, 8])]


def small(spark):
    nodes = spark.createDataFrame([("a", "A", 0.0, 0.0), ("b", "B", 1.0, 0.0)], "node_id string, label string, lon double, lat double")
    return nodes, spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0)], "src string, dst string, cost double")


def test_compiled_network(spark, tmp_path):
    nodes, edges = small(spark)
    folder = str(tmp_path / "net")
    maps.write_network(nodes, edges, folder)
    back = maps.read_network(spark, folder)
    assert sorted(map(tuple, back[1].collect())) == sorted(map(tuple, edges.collect()))
    assert maps.table_checksum(edges).first() == maps.table_checksum(edges.orderBy("src", ascending=False).repartition(3)).first()
    edges.limit(1).write.mode("overwrite").parquet(f"{folder}/edges")
    with pytest.raises(ValueError, match="checksum"):
        maps.read_network(spark, folder)
    assert maps.read_network(spark, folder, verify=False)[1].count() == 1


def test_features(spark):
    nodes, edges = small(spark)
    kinds = [json.loads(r.feature)["geometry"]["type"] for r in exports.network_features(nodes, edges).collect()]
    assert sorted(kinds) == ["LineString", "LineString", "Point", "Point"]
    assert [json.loads(r.feature)["properties"]["severed"] for r in exports.street_features(nodes, edges.withColumn("blocked", F.lit(True))).collect()] == [True]
    routes = spark.createDataFrame([("r", ["a", "b"]), ("none", [])], "route_id string, path array<string>")
    got = {r.route_id: json.loads(r.collection) for r in exports.route_features(routes, nodes).collect()}
    assert [f["properties"].get("role") for f in got["r"]["features"]] == [None, "origin", "destination"] and got["none"]["features"] == []
    ring = [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}]
    zones = spark.createDataFrame([("h", "flash_flood", "low", 0.5, True, ring)], "hazard_id string, hazard_type string, severity string, speed_multiplier double, active boolean, ring array<struct<lon:double,lat:double>>")
    assert json.loads(exports.hazard_features(zones).first().feature)["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    stations = spark.createDataFrame([("s", "S", "a", "fire_station")], "station_id string, name string, node_id string, station_type string")
    calls = spark.createDataFrame([("i", "flash_flood", "priority_1_echo", 0.5, 0.5)], "incident_id string, emergency_type string, urgency string, lon double, lat double")
    track = spark.createDataFrame([("u", 1.0, 1.0, 0.0), ("u", 0.0, 0.0, 0.0)], "unit_id string, tick_s double, lon double, lat double")
    layers = exports.replay_features(nodes, edges, stations, calls, zones, track).collect()
    assert {r.layer for r in layers} == {"network", "stations", "incidents", "hazards", "trajectories"}
    assert [json.loads(r.feature)["properties"]["times_s"] for r in layers if r.layer == "trajectories"] == [[0.0, 1.0]]


def test_tables(spark, tmp_path):
    r = spark.createDataFrame([("i1", "flash_flood", "priority_1_echo", 0.0, 5.0, 65.0, None, None, 1.5, ["u1", "u2"])], "incident_id string, emergency_type string, urgency string, report_s double, first_dispatch_s double, first_arrival_s double, all_arrival_s double, cleared_s double, queue_delay_s double, assigned_units array<string>")
    exports.write_csv(exports.incident_rows(r).coalesce(1), str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*.csv")
    head, row = csv.reader(part.open())
    assert len(head) == 15 and row == ["i1", "flash_flood", "priority_1_echo", "0.00", "5.00", "65.00", "", "", "1.50", "5.00", "60.00", "65.00", "", "2", "u1;u2"]
    s = spark.createDataFrame([("x", "static", False, float("inf"), 10.0, 0, True, None, 1.0, 0.0)], "scenario string, strategy string, arrived boolean, travel_time_s double, distance_m double, reroute_count int, stalled boolean, polling_interval_s double, stability double, detour_delay double")
    assert tuple(exports.strategy_rows(s).first()) == ("x", "static", "false", "STALLED", "10.00", 0, "true", "", "1.0000", "0.0000")
    one = spark.createDataFrame([("x", 1)], "scenario string, n int")
    doc = json.loads(exports.telemetry_documents(one, one, one.limit(0)).first().document)
    assert doc == {"summary": {"n": 1}, "incidents": [{"n": 1}], "vehicles": []}


def test_read_then_route(spark, tmp_path):
    _, edges = maps.read_osm_json(spark, put(tmp_path / "m.json", OSM))
    found = shortest_paths(edges, spark.createDataFrame([("1",)], "source string")).collect()
    assert {r.node for r in found} == {"1", "2", "3", "4"}


def test_digests_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_bytes(b'{"x": 1}')
    (tmp_path / "b.bin").write_bytes(bytes(range(256)) * 100)
    out = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in exports.file_digests(spark, str(tmp_path)).collect()}
    assert out == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir() if f.suffix in (".json", ".bin")}


def test_faulty_elements_spoil_themselves_alone(spark, tmp_path):
    elements = [
        '"text"', '{"id": 1}', '{"type": "node", "lat": 1, "lon": 2}', '{"type": "node", "id": 2, "lat": "x", "lon": 2}', '{"type": "node", "id": 3, "lat": 1}',
        '{"type": "way", "id": 4}', '{"type": "node", "id": 5, "lat": 1.0, "lon": 2.0}', '{"type": "node", "id": 6, "lat": 1.0, "lon": 2.001}',
        '{"type": "way", "id": 7, "nodes": [5, 6], "tags": {"highway": "residential"}}', '{"type": "node", "id": 8, "lat": 1, "lon": 2, "tags": "none"}',
    ]
    (tmp_path / "d.json").write_text('{"elements": [' + ",\n".join(elements) + "]}")
    rows = maps.osm_elements(spark, str(tmp_path))
    told = sorted((r.code, r.record) for r in maps.osm_rejects(rows).collect())
    assert told == [("invalid_coordinates", "node/2"), ("malformed_record", ""), ("malformed_record", "1"), ("missing_coordinates", "node/3"), ("missing_id", "node"), ("missing_nodes", "way/4")]
    nodes, edges = maps.osm_network(rows)
    assert sorted(r.node_id for r in nodes.collect()) == ["5", "6"] and edges.count() == 2


def test_documents_in_other_encodings(spark, tmp_path):
    text = json.dumps({"elements": [{"type": "node", "id": 7, "lat": 1.5, "lon": 2.5, "tags": {"name": "Café"}}]}, ensure_ascii=False)
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32"):
        (tmp_path / f"{name}.json").write_bytes(text.encode(name))
    out = maps.osm_elements(spark, str(tmp_path)).collect()
    assert [(r.id, r.lat, r.tags["name"]) for r in out] == [(7, 1.5, "Café")] * 6
