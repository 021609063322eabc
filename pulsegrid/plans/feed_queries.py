"""Registered queries over documents that Spark writes from the given tables and the readers read back, over exports read back, changes and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import feeds as feed_words
from pulsegrid.functions import geo
from pulsegrid.operators import metrics, network, overlay, spatial, tracking
from pulsegrid.plans.lineage import cut, shared_folder
from pulsegrid.plans.more_queries import _PATH_SQL, _drained, _event_stream, _paths
from pulsegrid.plans.queries import SQL, _apart, _at, query
from pulsegrid.plans.views import hazards, table, view
from pulsegrid.sources import exports, feeds, maps
from pulsegrid.streaming import live


def _documents(rows: DataFrame) -> str:
    """A folder of text files, one document (column doc) in each, in the shared folder."""
    folder = f"{shared_folder(rows.sparkSession)}/documents-{uuid.uuid4().hex}"
    rows.select("name", "doc").write.partitionBy("name").text(folder)
    return folder


# --- extracts: each row of the grid has a way along it, and LOT_ROWS rows are one document

#: Rows of the grid in one document at most: a folder and a file for each row take longer to make and to list than to read.
LOT_ROWS = 100

_WAYS = """way AS (SELECT a.k AS a, b.k AS b, CAST(floor(a.k / 50) AS BIGINT) AS r, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM nodes a JOIN nodes b ON b.k = a.k + 1 WHERE a.k % 50 <> 49),
kept AS (SELECT *, r % 5 <> 3 AS fore, r % 5 <> 1 AS back FROM way WHERE r % 7 <> 5 AND r % 11 <> 6),
steps AS (SELECT a AS src, b AS dst, r, x0, y0, x1, y1 FROM kept WHERE fore UNION ALL SELECT b, a, r, x0, y0, x1, y1 FROM kept WHERE back)"""


def _tags() -> Column:
    oneway = F.when(F.col("r") % 5 == 1, "yes").when(F.col("r") % 5 == 3, "-1").otherwise("no")
    tags = {
        "highway": F.when(F.col("r") % 7 == 5, "footway").otherwise("residential"),
        "oneway": oneway,
        "access": F.when(F.col("r") % 11 == 6, "private").otherwise("yes"),
        "name": F.concat(F.lit("Row "), F.col("r").cast("string")),
    }
    return F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)])


def _rows_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, members sorted by k): the nodes of each row of the grid."""
    nodes = view(spark, sf_dir, "nodes").withColumn("r", F.floor(F.col("k") / 50).cast("long"))
    return nodes.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("m"))


def _in_lots(rows: DataFrame, text: Column, head: str, tail: str, between: str = "") -> DataFrame:
    """One document for each lot of rows of the grid: their texts in order of r between head and tail."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("x")))), lambda p: p["x"])
    return rows.groupBy(F.floor(F.col("r") / LOT_ROWS).alias("name")).agg(F.concat(F.lit(head), F.array_join(texts, between), F.lit(tail)).alias("doc"))


def _osm_json(spark: SparkSession, sf_dir: str) -> str:
    points = F.transform("m", lambda p: F.struct(F.lit("node").alias("type"), p["k"].alias("id"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    way = F.struct(F.lit("way").alias("type"), (F.col("r") + 1_000_000).alias("id"), F.transform("m", lambda p: p["k"]).alias("nodes"), _tags().alias("tags"))
    dots = F.array_join(F.transform(points, lambda p: F.to_json(p)), ",")
    return _documents(_in_lots(_rows_of_grid(spark, sf_dir), F.concat(dots, F.lit(","), F.to_json(way)), '{"elements":[', "]}", ","))


def _osm_xml(spark: SparkSession, sf_dir: str) -> str:
    dots = F.array_join(F.transform("m", lambda p: F.format_string('<node id="%d" lat="%s" lon="%s"/>', p["k"], p["lat"].cast("string"), p["lon"].cast("string"))), "")
    refs = F.array_join(F.transform("m", lambda p: F.format_string('<nd ref="%d"/>', p["k"])), "")
    tags = F.array_join(F.transform(F.map_entries(_tags()), lambda t: F.format_string('<tag k="%s" v="%s"/>', t["key"], t["value"])), "")
    text = F.concat(dots, F.format_string('<way id="%d">', F.col("r") + 1_000_000), refs, tags, F.lit('<tag k="" v="x"/></way>'))
    return _documents(_in_lots(_rows_of_grid(spark, sf_dir), text, '<osm version="0.6">', "</osm>"))


_EXTRACT_SQL = f"WITH {_WAYS} SELECT CAST(src AS STRING) AS src, CAST(dst AS STRING) AS dst, CONCAT('Row ', CAST(r AS STRING)) AS name, 'residential' AS highway, round({_apart('a', 'b')}, 4) AS cost FROM (SELECT src, dst, r, x0 AS lon, y0 AS lat, x1, y1 FROM steps) a CROSS JOIN LATERAL (SELECT a.x1 AS lon, a.y1 AS lat) b"


def _extract(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "name", "highway", F.round("cost", 4).alias("cost"))


@query(_EXTRACT_SQL)
def extract_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(maps.read_osm_json(spark, _osm_json(spark, sf_dir))[1])


@query(_EXTRACT_SQL)
def extract_roads_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(maps.read_osm_xml(spark, _osm_xml(spark, sf_dir))[1])


@query("SELECT node_id, lon, lat FROM nodes WHERE CAST(floor(k / 50) AS BIGINT) % 7 <> 5 AND CAST(floor(k / 50) AS BIGINT) % 11 <> 6")
def extract_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of kept ways alone; those of footways and private ways are orphans."""
    return maps.read_osm_json(spark, _osm_json(spark, sf_dir))[0].select("node_id", "lon", "lat")


@query(f"""SELECT e.src, e.dst, round(CASE WHEN e.cost > 9 THEN e.cost ELSE {_apart('a', 'b')} END, 4) AS cost FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst""")
def drawn_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with both ends named, in documents by source; those of cost 9 or less come without it and get their length."""
    nodes, edges = _at(spark, sf_dir, "nodes", "edges")
    at = lambda k: nodes.select(F.col("node_id").alias(k), F.array("lon", "lat").alias(f"{k}_at"), F.col("k").alias(f"{k}_k"))
    met = edges.join(at("src"), "src").join(at("dst"), "dst")
    line = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array("src_at", "dst_at").alias("coordinates")).alias("geometry"), F.struct(F.col("src").alias("source"), F.col("dst").alias("destination"), F.when(F.col("cost") > 9, F.col("cost")).alias("cost")).alias("properties"))
    docs = met.groupBy(F.floor(F.col("src_k") / (50 * LOT_ROWS)).alias("name")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(line).alias("features"))).alias("doc"))
    return maps.read_geojson_network(spark, _documents(docs))[1].select("src", "dst", F.round("cost", 4).alias("cost"))


# --- alerts, facilities, gauges and weather as documents, a day of events in each, or a lot of them

_EVENT = "CASE event_id % 5 WHEN 0 THEN 'Flash Flood Warning' WHEN 1 THEN 'Wildfire near town' WHEN 2 THEN 'Chemical plume' WHEN 3 THEN 'Earthquake' ELSE 'Civil unrest' END"
_SEVERITY = "CASE user_id % 4 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Minor' WHEN 2 THEN 'Odd' ELSE 'Moderate' END"


#: Events of one document at most: a document is read by one task.
LOT = 20_000


def _daily(rows: DataFrame, item: str, head: str, tail: str, between: str = "") -> DataFrame:
    """One document a day and lot of event ids: the items in order of event_id between head and tail."""
    name = F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), F.floor(F.col("event_id") / LOT))
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.expr(item).alias("x")))), lambda p: p["x"])
    return rows.groupBy(name.alias("name")).agg(F.concat(F.lit(head), F.array_join(items, between), F.lit(tail)).alias("doc"))


@query(f"""SELECT CAST(event_id AS STRING) AS identifier, {_EVENT} AS event, CASE {_SEVERITY} WHEN 'Odd' THEN 'Severe' ELSE {_SEVERITY} END AS severity, 'Immediate' AS urgency,
CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS polygons, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 90 AS DOUBLE) END AS first_lat FROM events""", plain=True)
def cap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = "CASE WHEN event_id % 3 = 0 THEN '1,2 3,4' ELSE concat(event_id % 90, ',5 6,7 8,9 ', event_id % 90, ',5') END"
    item = f"""concat('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>', event_id, '</identifier><sender>desk</sender><sent>2024-01-01T00:00:00+00:00</sent><msgType>Alert</msgType><info><event>', {_EVENT},
        '</event><severity>', {_SEVERITY}, '</severity><area><areaDesc>x</areaDesc><polygon>', {ring}, '</polygon></area></info></alert>')"""
    folder = _documents(_daily(table(spark, sf_dir, "events"), item, "<alerts>", "</alerts>"))
    alerts = feeds.read_cap_alerts(spark, folder, "1999-06-01 00:00:00")
    return alerts.select("identifier", "event", "severity", "urgency", F.size("polygons").alias("polygons"), F.try_element_at(F.try_element_at("polygons", F.lit(1)), F.lit(1))["lat"].alias("first_lat"))


@query("""SELECT CONCAT('g', CAST(event_id AS STRING)) AS hazard_id, CASE event_id % 3 WHEN 0 THEN 'wildfire_perimeter' ELSE 'flood_inundation' END AS hazard_type,
CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS speed_multiplier, 3 AS vertices FROM events""", plain=True)
def alert_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon features; without a multiplier they block, whatever their severity."""
    item = """to_json(named_struct('type', 'Feature', 'id', concat('g', event_id), 'geometry', named_struct('type', 'Polygon', 'coordinates', array(array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 0D)))),
        'properties', named_struct('hazard_type', CASE event_id % 3 WHEN 0 THEN 'wildfire' ELSE 'flood' END, 'severity', 'low', 'speed_multiplier', CASE WHEN event_id % 2 = 0 THEN 0.5D END)))"""
    folder = _documents(_daily(table(spark, sf_dir, "events"), item, '{"type":"FeatureCollection","features":[', "]}", ","))
    return feeds.read_geojson_alerts(spark, folder).select("hazard_id", "hazard_type", "speed_multiplier", F.size("ring").alias("vertices"))


@query("""SELECT CONCAT(CASE event_id % 2 WHEN 0 THEN 'node/' ELSE 'way/' END, CAST(event_id AS STRING)) AS poi_id, CASE event_id % 4 WHEN 0 THEN 'hospital' WHEN 1 THEN 'fire_station' WHEN 2 THEN 'police' ELSE 'urgent_care' END AS poi_type,
CASE WHEN event_id % 7 = 0 THEN CONCAT('Unnamed ', CASE event_id % 4 WHEN 0 THEN 'Hospital' WHEN 1 THEN 'Fire Station' WHEN 2 THEN 'Police' ELSE 'Urgent Care' END, ' ', CAST(event_id AS STRING)) ELSE CONCAT('Site ', CAST(event_id AS STRING)) END AS name,
CASE WHEN event_id % 6 = 0 THEN 'burn_center,helipad,trauma_level_2' ELSE '' END AS capabilities, CASE WHEN event_id % 6 = 0 THEN 2 END AS trauma_level, CAST(event_id % 180 AS DOUBLE) AS lon FROM events WHERE event_id % 5 <> 4""", plain=True)
def facility_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overpass facilities; ways stand at their centre, a fifth have a tag of no kind and are left out."""
    kind = "CASE WHEN event_id % 5 = 4 THEN 'bench' WHEN event_id % 4 = 0 THEN 'hospital' WHEN event_id % 4 = 1 THEN 'fire_station' WHEN event_id % 4 = 2 THEN 'police' ELSE 'clinic' END"
    item = f"""to_json(named_struct('type', CASE event_id % 2 WHEN 0 THEN 'node' ELSE 'way' END, 'id', event_id, 'lon', CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 180 AS DOUBLE) END, 'lat', CASE WHEN event_id % 2 = 0 THEN 10D END,
        'center', CASE WHEN event_id % 2 = 1 THEN named_struct('lat', 10D, 'lon', CAST(event_id % 180 AS DOUBLE)) END,
        'tags', map_filter(map('amenity', {kind}, 'name', CASE WHEN event_id % 7 <> 0 THEN concat(' Site ', event_id) ELSE ' ' END, 'trauma_level', CASE WHEN event_id % 6 = 0 THEN 'Level 2' END, 'helipad', CASE WHEN event_id % 6 = 0 THEN 'yes' END, 'healthcare:speciality', CASE WHEN event_id % 6 = 0 THEN 'Burns;x' END), (k, v) -> v IS NOT NULL)))"""
    folder = _documents(_daily(table(spark, sf_dir, "events"), item, '{"elements":[', "]}", ","))
    return feeds.read_pois(spark, folder).select("poi_id", "poi_type", "name", F.array_join("capabilities", ",").alias("capabilities"), "trauma_level", "lon")


@query("""WITH s AS (SELECT CAST(user_id AS STRING) AS site_id, CAST(event_id % 50 AS DOUBLE) AS h, event_id FROM events WHERE user_id % 3 <> 0)
SELECT site_id, arg_max(h, event_id) AS gage_height_ft, CASE WHEN arg_max(h, event_id) >= 40 THEN 'major' WHEN arg_max(h, event_id) >= 30 THEN 'moderate' WHEN arg_max(h, event_id) >= 20 THEN 'minor' WHEN arg_max(h, event_id) >= 10 THEN 'action' ELSE 'normal' END AS flood_stage,
CONCAT('USGS-', site_id) AS site_name FROM s GROUP BY site_id""", plain=True)
def gauge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge series: a third of the sites report flow alone and are dropped; the latest height counts."""
    item = """to_json(named_struct('sourceInfo', named_struct('siteName', '', 'siteCode', array(named_struct('value', CAST(user_id AS STRING))), 'geoLocation', named_struct('geogLocation', named_struct('latitude', '47.5', 'longitude', '-122'))),
        'variable', named_struct('variableCode', array(named_struct('value', CASE WHEN user_id % 3 = 0 THEN '00060' ELSE '00065' END))),
        'values', array(named_struct('value', array(named_struct('value', CAST(event_id % 50 AS STRING), 'dateTime', date_format(timestamp_seconds(1700000000 + event_id), "yyyy-MM-dd'T'HH:mm:ss")))))))"""
    rows = table(spark, sf_dir, "events")
    folder = _documents(_daily(rows, item, '{"value":{"timeSeries":[', "]}}", ","))
    limits = rows.select(F.col("user_id").cast("string").alias("site_id")).distinct().select("site_id", *[F.lit(v).alias(f"{k}_ft") for k, v in (("action", 10.0), ("minor", 20.0), ("moderate", 30.0), ("major", 40.0))])
    return feeds.read_gauges(spark, folder, limits).select("site_id", "gage_height_ft", "flood_stage", "site_name")


@query("""SELECT 'osm' AS source, code, count(*) AS n FROM (SELECT CASE event_id % 9 WHEN 0 THEN 'malformed_record' WHEN 1 THEN 'malformed_record' WHEN 2 THEN 'missing_id' WHEN 3 THEN 'invalid_coordinates' WHEN 4 THEN 'missing_coordinates' WHEN 5 THEN 'missing_nodes' END AS code FROM events) WHERE code IS NOT NULL GROUP BY code
UNION ALL SELECT 'pois', code, count(*) FROM (SELECT CASE event_id % 9 WHEN 0 THEN 'malformed_record' WHEN 1 THEN 'malformed_record' WHEN 2 THEN 'missing_id' WHEN 3 THEN 'invalid_coordinates' WHEN 4 THEN 'missing_coordinates' WHEN 5 THEN 'missing_coordinates' WHEN 6 THEN 'invalid_coordinates' END AS code FROM events) WHERE code IS NOT NULL GROUP BY code
UNION ALL SELECT 'cap', code, count(*) FROM (SELECT unnest(CASE event_id % 4 WHEN 0 THEN ['missing_id', 'invalid_time'] WHEN 1 THEN ['invalid_polygon'] WHEN 2 THEN ['invalid_time', 'invalid_polygon', 'invalid_polygon'] ELSE [] END) AS code FROM events) GROUP BY code
UNION ALL SELECT 'gauges', code, count(*) FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'invalid_value' WHEN 1 THEN 'missing_value' WHEN 2 THEN 'invalid_coordinates' WHEN 3 THEN 'missing_id' END AS code FROM events) WHERE code IS NOT NULL GROUP BY code""", plain=True)
def reader_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers refuse: a document a day in which most records have a fault."""
    events = table(spark, sf_dir, "events")
    tags = "'tags', map('amenity', 'hospital')"
    element = f"""CASE event_id % 9 WHEN 0 THEN '"no object"' WHEN 1 THEN concat('{{"id":', event_id, '}}')
        WHEN 2 THEN to_json(named_struct('type', 'node', 'lat', 1D, 'lon', 2D, {tags})) WHEN 3 THEN to_json(named_struct('type', 'node', 'id', event_id, 'lat', 'north', 'lon', 2D, {tags}))
        WHEN 4 THEN to_json(named_struct('type', 'node', 'id', event_id, 'lat', 1D, {tags})) WHEN 5 THEN to_json(named_struct('type', 'way', 'id', event_id, {tags}))
        WHEN 6 THEN to_json(named_struct('type', 'node', 'id', event_id, 'lat', 95D, 'lon', 2D, {tags})) WHEN 7 THEN to_json(named_struct('type', 'relation', 'lat', 5D, 'lon', 2D, 'tags', map('a', 'b')))
        ELSE to_json(named_struct('type', 'node', 'id', event_id, 'lat', 5D, 'lon', 2D, {tags})) END"""
    elements = maps.osm_elements(spark, _documents(_daily(events, element, '{"elements":[', "]}", ",")))
    alert = """concat('<alert><identifier>', CASE WHEN event_id % 4 = 0 THEN ' ' ELSE CAST(event_id AS STRING) END, '</identifier><sender>desk</sender><sent>', CASE WHEN event_id % 4 IN (0, 2) THEN 'noon' ELSE '2024-01-01T00:00:00+00:00' END,
        '</sent><info><event>Flood</event><area><areaDesc>x</areaDesc>', CASE event_id % 4 WHEN 1 THEN '<polygon>1,2 3,4</polygon><polygon>1,2 3,4 5,6</polygon>' WHEN 2 THEN '<polygon>1,2 x,y 3 4,5</polygon><polygon>none</polygon>' ELSE '<polygon>1,2 3,4 5,6</polygon>' END, '</area></info></alert>')"""
    records = feeds.cap_records(spark, _documents(_daily(events, alert, "<alerts>", "</alerts>")))
    series = """to_json(named_struct('sourceInfo', named_struct('siteName', 'x', 'siteCode', CASE WHEN event_id % 5 <> 3 THEN array(named_struct('value', CAST(user_id AS STRING))) END, 'geoLocation', named_struct('geogLocation', named_struct('latitude', CASE WHEN event_id % 5 = 2 THEN '95' ELSE '5' END, 'longitude', '7'))),
        'variable', named_struct('variableCode', array(named_struct('value', '00065'))), 'values', array(named_struct('value', array(named_struct('value', CASE event_id % 5 WHEN 0 THEN 'Ice' WHEN 1 THEN '-999999' ELSE '3' END, 'dateTime', '2024-01-01T00:00:00'))))))"""
    values = feeds.gauge_values(spark, _documents(_daily(events, series, '{"value":{"timeSeries":[', "]}}", ",")))
    told = [("osm", maps.osm_rejects(elements)), ("pois", feeds.poi_rejects(elements)), ("cap", feeds.cap_rejects(records)), ("gauges", feeds.gauge_rejects(values))]
    counts = [rows.groupBy("code").agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "code", "n") for name, rows in told]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("""WITH w AS (SELECT CAST(event_id % 120 AS DOUBLE) AS wind, CAST(event_id % 45 AS DOUBLE) AS hot FROM events)
SELECT CASE WHEN hot > 38 THEN 'wildfire_perimeter' ELSE 'flood_inundation' END AS hazard_type, CASE WHEN wind >= 85 THEN 'critical_blocked' ELSE 'severe' END AS severity, CASE WHEN wind >= 85 THEN 0 ELSE 0.35 END::DOUBLE AS speed_multiplier, count(*) AS n
FROM w WHERE wind >= 75 GROUP BY 1, 2, 3""", plain=True)
def weather_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather documents, one for each event, in clear skies (code 0): wind alone decides."""
    item = "to_json(named_struct('latitude', 10D, 'longitude', CAST(event_id % 180 AS DOUBLE), 'current', named_struct('time', '2024-01-01T00:00', 'weather_code', 0, 'temperature_2m', CAST(event_id % 45 AS DOUBLE), 'wind_speed_10m', CAST(event_id % 120 AS DOUBLE), 'precipitation', 0D)))"
    folder = _documents(_daily(table(spark, sf_dir, "events"), item, "[", "]", ","))
    found = feeds.weather_to_hazards(feeds.read_weather(spark, folder, "1999-06-01 00:00:00"))
    return found.groupBy("hazard_type", "severity", "speed_multiplier").agg(F.count("*").alias("n"))


# --- an operator's words

_SAID = "CASE event_id % 7 WHEN 0 THEN ' Flash_Flood ' WHEN 1 THEN 'bush FIRE' WHEN 2 THEN 'toxic cloud' WHEN 3 THEN 'bridge collapse' WHEN 4 THEN 'civil_unrest' WHEN 5 THEN 'fire and gas' ELSE 'nothing known' END"
_HOW = "CASE user_id % 5 WHEN 0 THEN 'CRITICAL!' WHEN 1 THEN 'quite severe' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'low' ELSE 'unclear' END"


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'flood_inundation' WHEN 1 THEN 'wildfire_perimeter' WHEN 2 THEN 'toxic_gas_plume' WHEN 3 THEN 'structural_debris' WHEN 4 THEN 'civil_unrest' WHEN 5 THEN 'wildfire_perimeter' ELSE 'flood_inundation' END AS hazard_type,
CASE user_id % 5 WHEN 1 THEN 'severe' WHEN 2 THEN 'moderate' WHEN 3 THEN 'low' ELSE 'critical_blocked' END AS severity FROM events""", plain=True)
def hazard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "events").select("event_id", F.expr(_SAID).alias("said"), F.expr(_HOW).alias("how"))
    return said.select("event_id", feed_words.hazard_from_text(F.col("said")).alias("hazard_type"), feed_words.severity_from_text(F.col("how")).alias("severity"))


# --- facilities bound to roads

@query("""SELECT s_suppkey, s_suppkey % 3 <> 0 AS bound, CASE WHEN s_suppkey % 3 <> 0 THEN node_id END AS nearest_node_id FROM supplier CROSS JOIN size JOIN nodes ON k = 1 + (s_suppkey * 37) % (n - 1)""")
def bound_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds stand at nodes, the others far east of all; the grid grows northward alone."""
    nodes, edges, size = _at(spark, sf_dir, "nodes", "edges", "size")
    pois = spark.sql("SELECT s_suppkey, CAST(s_suppkey AS STRING) AS poi_id, CASE WHEN s_suppkey % 3 = 0 THEN lon + 90 ELSE lon END AS lon, lat FROM {supplier} CROSS JOIN {size} JOIN {nodes} ON k = 1 + (s_suppkey * 37) % (n - 1)", supplier=table(spark, sf_dir, "supplier"), size=size, nodes=nodes)
    bound, unbound = spatial.bind_pois(pois, nodes, edges)
    return bound.select("s_suppkey", F.lit(True).alias("bound"), "nearest_node_id").union(unbound.select("s_suppkey", F.lit(False), F.lit(None).cast("string")))


# --- exports read back

_POINT, _LINE = "geometry struct<type:string,coordinates:array<double>>", "geometry struct<type:string,coordinates:array<array<double>>>"


@query("""SELECT 'Point' AS kind, node_id AS a, NULL::STRING AS b, NULL::DOUBLE AS cost, (SELECT count(*) FROM edges e WHERE e.src = node_id) AS out_degree, lon, lat FROM nodes
UNION ALL SELECT 'LineString', src, dst, cost, NULL, y.lon, y.lat FROM edges JOIN nodes y ON y.node_id = dst""")
def network_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _at(spark, sf_dir, "nodes", "edges")
    f = exports.network_features(nodes, edges).withColumn("kind", F.get_json_object("feature", "$.geometry.type"))
    p = F.from_json("feature", f"{_POINT}, properties struct<node_id:string,out_degree:long>")
    line = F.from_json("feature", f"{_LINE}, properties struct<source:string,destination:string,cost:double>")
    dots = f.where("kind = 'Point'").withColumn("p", p).select("kind", F.col("p.properties.node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("cost"), F.col("p.properties.out_degree").alias("out_degree"), F.col("p.geometry.coordinates")[0].alias("lon"), F.col("p.geometry.coordinates")[1].alias("lat"))
    end = F.element_at("l.geometry.coordinates", -1)
    return dots.union(f.where("kind = 'LineString'").withColumn("l", line).select("kind", "l.properties.source", "l.properties.destination", "l.properties.cost", F.lit(None).cast("long"), end[0], end[1]))


@query("SELECT hazard_id, severity, active, 5 AS vertices, true AS closed, x0 AS lon, y0 AS lat FROM boxes")
def hazard_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = exports.hazard_features(hazards(spark, sf_dir)).select(F.from_json("feature", "geometry struct<coordinates:array<array<array<double>>>>, properties struct<hazard_id:string,severity:string,active:boolean>").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return f.select("f.properties.*", F.size(ring).alias("vertices"), (ring[0] == F.element_at(ring, -1)).alias("closed"), ring[0][0].alias("lon"), ring[0][1].alias("lat"))


@query(f"WITH {_PATH_SQL} SELECT k AS route_id, 7 AS features, CAST(k AS STRING) AS origin, 'origin,waypoint,waypoint,waypoint,waypoint,destination' AS roles FROM leg WHERE pos = 0")
def route_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = exports.route_features(_paths(spark, sf_dir), view(spark, sf_dir, "nodes"))
    read = made.select("route_id", F.from_json("collection", "features array<struct<properties:struct<node_id:string,role:string>>>")["features"].alias("f"))
    return read.select("route_id", F.size("f").alias("features"), F.col("f")[1]["properties"]["node_id"].alias("origin"), F.array_join(F.transform("f", lambda x: x["properties"]["role"]), ",").alias("roles"))


@query("""SELECT CAST(o_orderkey AS STRING) AS scenario_name, CASE o_orderkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'polling' ELSE 'event_driven' END AS strategy, CASE WHEN o_orderkey % 4 = 0 THEN 'false' ELSE 'true' END AS arrived,
CASE WHEN o_orderkey % 4 = 0 THEN 'STALLED' ELSE printf('%d.25', o_orderkey % 900) END AS travel_time_seconds, printf('%d.50', o_custkey % 7000) AS total_distance_meters, o_orderkey % 5 AS reroute_count, CASE WHEN o_orderkey % 4 = 0 THEN 'true' ELSE 'false' END AS stalled,
CASE WHEN o_orderkey % 3 = 1 THEN '5.0' ELSE '' END AS polling_interval_seconds, '0.7500' AS path_stability_index, '0.1250' AS detour_delay_factor FROM orders""", plain=True)
def strategy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS scenario", "CASE o_orderkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'polling' ELSE 'event_driven' END AS strategy", "o_orderkey % 4 <> 0 AS arrived", "CASE WHEN o_orderkey % 4 = 0 THEN double('Infinity') ELSE o_orderkey % 900 + 0.25D END AS travel_time_s",
        "o_custkey % 7000 + 0.5D AS distance_m", "o_orderkey % 5 AS reroute_count", "o_orderkey % 4 = 0 AS stalled", "CASE WHEN o_orderkey % 3 = 1 THEN 5D END AS polling_interval_s", "0.75D AS stability", "0.125D AS detour_delay",
    )
    return exports.strategy_rows(rows)


@query("""SELECT o_orderpriority AS scenario, count(*) AS incidents, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS vehicles, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_orderpriority""", plain=True)
def scenario_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS scenario", "o_orderkey AS id")
    made = exports.telemetry_documents(rows.groupBy("scenario").agg(F.sum("id").alias("total")), rows, rows.where("id % 10 = 0"))
    d = made.select("scenario", F.from_json("document", "summary struct<total:long>, incidents array<struct<id:long>>, vehicles array<struct<id:long>>").alias("d"))
    return d.select("scenario", F.size("d.incidents").cast("long").alias("incidents"), F.size("d.vehicles").cast("long").alias("vehicles"), F.col("d.summary.total").alias("total"))


@query("""SELECT 'network' AS layer, node_id AS id, 1 AS points, lon, lat FROM nodes
UNION ALL SELECT 'network', CONCAT(src, '>', dst), 2, y.lon, y.lat FROM edges JOIN nodes y ON y.node_id = dst
UNION ALL SELECT 'hazards', hazard_id, 5, x0, y0 FROM boxes UNION ALL SELECT 'incidents', point_id, 1, lon, lat FROM points
UNION ALL SELECT 'stations', station_id, 1, lon, lat FROM units JOIN nodes ON node_id = current_node_id WHERE unit_id LIKE '%a'
UNION ALL SELECT 'trajectories', CAST(k % 9 AS STRING), CAST(count(*) AS INT), arg_max(lon, k), arg_max(lat, k) FROM nodes GROUP BY k % 9""")
def replay_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of a replay read back: its layer, its id, its points and the last of them."""
    nodes, edges, units, points = _at(spark, sf_dir, "nodes", "edges", "units", "points")
    stations = units.where("unit_id LIKE '%a'").selectExpr("station_id", "current_node_id AS node_id", "station_id AS name", "'fire_station' AS station_type")
    incidents = points.selectExpr("point_id AS incident_id", "'fire' AS emergency_type", "'other' AS urgency", "lon", "lat")
    tracks = nodes.selectExpr("CAST(k % 9 AS STRING) AS unit_id", "CAST(k AS DOUBLE) AS tick_s", "lon", "lat")
    made = exports.replay_features(nodes, edges, stations, incidents, hazards(spark, sf_dir), tracks)
    names = ("node_id", "source", "destination", "hazard_id", "incident_id", "station_id", "unit_id")
    read = f"geometry struct<type:string,coordinates:string>, properties struct<{','.join(n + ':string' for n in names)}>"
    f = made.withColumn("f", F.from_json("feature", read)).select("layer", "f.geometry.*", "f.properties.*")
    parsed = lambda depth: F.from_json("coordinates", "array<" * depth + "double" + ">" * depth)
    line = F.when(F.col("type") == "Point", F.array(parsed(1))).when(F.col("type") == "LineString", parsed(2)).otherwise(F.element_at(parsed(3), 1))
    known = F.coalesce("node_id", "hazard_id", "incident_id", "station_id", "unit_id", F.concat_ws(">", "source", "destination"))
    end = F.element_at("line", -1)
    return f.withColumn("line", line).select("layer", known.alias("id"), F.size("line").alias("points"), end[0].alias("lon"), end[1].alias("lat"))


# --- changes, checks and logs

@query("SELECT mutation_id, txn_id FROM mutations WHERE txn_id <> 't7'")
def cleared_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "mutations").withColumn("txn_id", F.when(F.col("txn_id") == "t7", "hazard_9").otherwise(F.col("txn_id")))
    return overlay.clear_hazard(rows, "9").select("mutation_id", "txn_id")


@query("SELECT mutation_id, CASE txn_id WHEN 't3' THEN 't4' WHEN 't5' THEN NULL ELSE txn_id END AS txn_id FROM mutations")
def committed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.commit_nested(overlay.commit_nested(view(spark, sf_dir, "mutations"), "t3", "t4"), "t5", None).select("mutation_id", "txn_id")


@query("SELECT mutation_id FROM mutations m WHERE NOT EXISTS (SELECT 1 FROM mutations x WHERE x.src = m.src AND x.dst = m.dst AND x.blocked)")
def restored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of roads without any closure, from a snapshot written and read again."""
    rows, folder = view(spark, sf_dir, "mutations"), f"{shared_folder(spark)}/overlay-{uuid.uuid4().hex}"
    overlay.snapshot(overlay.remove(rows, rows.where("blocked")), folder, 1)
    return overlay.restore(spark, folder, 1).select("mutation_id")


@query("""SELECT event_id, value BETWEEN -180 AND 180 AND NOT isnan(value) AND user_id BETWEEN -90 AND 90 AS valid, CASE WHEN abs(value) <= 90 THEN CAST(user_id AS DOUBLE) ELSE value END AS lon,
CASE WHEN abs(value) <= 90 THEN value ELSE CAST(user_id AS DOUBLE) END AS lat FROM events""", plain=True)
def coordinate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("y", F.col("user_id").cast("double"))
    return e.select("event_id", geo.valid_wgs84(F.col("value"), F.col("y")).alias("valid"), geo.guess_lon_lat(F.col("value"), F.col("y")).alias("g")).select("event_id", "valid", "g.*")


_TILE_Y = "floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 4096)"


@query(f"""WITH t AS (SELECT k, floor((lon + 180.0) / 360.0 * 4096) AS x0, floor((lon + 0.1 + 180.0) / 360.0 * 4096) AS x1, {_TILE_Y.format(lat="(lat + 0.07)")} AS y0, {_TILE_Y.format(lat="lat")} AS y1 FROM nodes)
SELECT k, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 - x0 + 1 AS BIGINT) AS columns, CAST(y1 - y0 + 1 AS BIGINT) AS rows, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS tiles, round(x0 / 4096 * 360.0 - 180.0, 9) AS corner_lon,
round(degrees(atan(sinh(pi() * (1 - 2 * y0 / 4096)))), 9) AS corner_lat FROM t""")
def covered_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles at zoom 12 of a box a tenth of a degree wide, north-east of every node, its corners given swapped."""
    zoom, tiles = F.lit(12), F.col("t")
    t = view(spark, sf_dir, "nodes").withColumn("t", geo.covering_tiles(F.col("lon") + 0.1, F.col("lat"), F.col("lon"), F.col("lat") + 0.07, zoom))
    several = lambda c: F.size(F.array_distinct(F.transform(tiles, lambda x: x[c]))).cast("long")
    low = F.array_min(F.transform(tiles, lambda x: x["y"]))
    corner = geo.tile_corner(tiles[0]["x"], low, zoom)
    return t.select(
        "k", tiles[0]["x"].alias("x0"), low.alias("y0"), several("x").alias("columns"), several("y").alias("rows"), F.size("t").cast("long").alias("tiles"),
        F.round(corner["lon"], 9).alias("corner_lon"), F.round(corner["lat"], 9).alias("corner_lat"),
    )


@query("SELECT event_id, row_number() OVER (ORDER BY ts, priority, seq) AS place FROM log l WHERE NOT EXISTS (SELECT 1 FROM log c WHERE c.event_id = l.event_id AND c.event_type = 'unit_cleared')")
def log_without_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered log; places are counted within the ranges that ordering leaves, and run on over them."""
    log = view(spark, sf_dir, "log")
    ordered = tracking.ordered_log(log, log.where("event_type = 'unit_cleared'").select("event_id"))
    # sorted once and written; row ids rise within a partition, and partitions are ranges
    ranged = cut(ordered.select("event_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    first = Window.partitionBy("part")
    ranged = ranged.withColumn("own", F.col("at") - F.min("at").over(first))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").select("event_id", (F.col("own") + F.col("before") + 1).alias("place"))


@query(f"""WITH h AS (SELECT node_id, lon, lat, CASE WHEN k % 10 <> 3 THEN CAST((k * 17) % 29 AS DOUBLE) END AS z FROM nodes), s AS (SELECT {_apart('a', 'b')} AS d, b.z - a.z AS rise FROM edges e JOIN h a ON a.node_id = e.src JOIN h b ON b.node_id = e.dst)
SELECT (SELECT count(z) FROM h) AS nodes_enriched, (SELECT min(z) FROM h) AS min_elevation_m, (SELECT max(z) FROM h) AS max_elevation_m, count(rise) AS edges_enriched, round(greatest(max(rise / d * 100), 0), 6) AS max_up_percent, round(least(min(rise / d * 100), 0), 6) AS max_down_percent FROM s""")
def slope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _at(spark, sf_dir, "nodes", "edges")
    high = nodes.withColumn("elevation_m", F.when(F.col("k") % 10 != 3, ((F.col("k") * 17) % 29).cast("double")))
    out = metrics.elevation_summary(network.with_slopes(edges, high), high)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("percent") else c for c in out.columns])


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE (100.0 + o_orderkey % 50) / (o_custkey % 10) END::DOUBLE AS elevation_delay FROM orders", plain=True)
def slope_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey % 10 AS DOUBLE) AS flat_s", "100D + o_orderkey % 50 AS sloped_s")
    return metrics.elevation_delay_factor(rows).select("o_orderkey", "elevation_delay")


# --- streams, run to completion over the given table

@query()
def stream_incidents_in_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "points")
    arriving = _event_stream(spark, sf_dir).select(F.col("event_id").cast("string").alias("point_id")).join(points, "point_id")
    return _drained(spark, live.incidents_in_hazards(arriving, hazards(spark, sf_dir)))


SQL["stream_incidents_in_hazards"] = SQL["incidents_in_hazards"] + " WHERE h.active"


@query("""WITH r AS (SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) AS w, event_id, ts FROM events)
SELECT CAST(user_id AS STRING) AS site_id, CAST(max(event_id) AS DOUBLE) AS value, max(ts) AS ts FROM r GROUP BY user_id, w HAVING w + INTERVAL '15 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""", plain=True)
def stream_latest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reading of each site in each window that the watermark has closed; event ids rise with time."""
    readings = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("site_id"), F.col("event_id").cast("double").alias("value"), "ts")
    return _drained(spark, live.latest_readings(readings)).select("site_id", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH r AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS w, CAST(100 + event_id % 300 AS DOUBLE) AS t FROM events)
SELECT w AS start, count(*) AS incidents, count(*) AS serviced, CAST(count(*) FILTER (t <= 240) AS DOUBLE) / count(*) AS first_rate FROM r GROUP BY w HAVING w + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '30 minutes' FROM events)""", plain=True)
def stream_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_stream(spark, sf_dir)
    zero = F.lit(0.0)
    rows = e.select(F.col("event_id").cast("string").alias("incident_id"), F.col("ts").alias("reported_at"), zero.alias("report_s"), zero.alias("first_dispatch_s"), (F.col("event_id") % 300 + 100).cast("double").alias("first_arrival_s"), F.lit(None).cast("double").alias("all_arrival_s"), zero.alias("queue_delay_s"))
    out = live.rolling_compliance(rows).select(F.col("window.start").alias("start"), "incidents", "serviced", "first_rate")
    return _drained(spark, out).withColumn("start", F.col("start").cast("timestamp_ntz"))
