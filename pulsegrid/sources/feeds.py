"""Alert, facility, gauge, weather and terrain feeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import feeds, geo
from pulsegrid.sources.maps import TAGS, _told, osm_elements, read_features

# Domains of alert fields and their defaults.
CAP_DOMAINS = {
    "msgType": (["Alert", "Update", "Cancel", "Ack", "Error"], "Alert"),
    "urgency": (["Immediate", "Expected", "Future", "Past", "Unknown"], "Immediate"),
    "severity": (["Extreme", "Severe", "Moderate", "Minor", "Unknown"], "Severe"),
    "certainty": (["Observed", "Likely", "Possible", "Unlikely", "Unknown"], "Observed"),
}
_INFO = "struct<event:string,urgency:string,severity:string,certainty:string,expires:string,description:string,area:array<struct<areaDesc:string,polygon:array<string>>>>"
CAP = f"identifier string, sender string, sent string, msgType string, info array<{_INFO}>"


def _within(value: Column, field: str) -> Column:
    values, default = CAP_DOMAINS[field]
    clean = F.trim(value)
    return F.when(clean.isin(values), clean).otherwise(default)


def cap_ring(text: Column) -> Column:
    """Ring of a polygon's text, pairs of lat,lon parted by white space; unreadable pairs are left out."""
    pairs = F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.struct(F.trim(F.split(p, ",")[1]).try_cast("double").alias("lon"), F.trim(F.split(p, ",")[0]).try_cast("double").alias("lat")))
    return geo.ring_of(F.filter(F.when(F.length(F.trim(text)) > 0, pairs), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()))


def parse_alerts(raw: DataFrame, now: str) -> DataFrame:
    """Alerts with defaults from rows of CAP's fields; polygons of fewer than three points are dropped.

    A missing or bad sending time is ``now``, a bad expiry is none. Times with an offset are brought to UTC.
    """
    info = F.try_element_at("info", F.lit(1))
    # splitting before the filter keeps pairs without a comma out: their second part is null
    safe = lambda t: F.array_join(F.filter(F.split(F.trim(t), r"\s+"), lambda p: p.contains(",")), " ")
    rings = F.transform(F.flatten(F.transform(F.coalesce(info["area"], F.array().cast("array<struct<areaDesc:string,polygon:array<string>>>")), lambda a: F.coalesce(a["polygon"], F.array().cast("array<string>")))), lambda t: cap_ring(safe(t)))
    has = info.isNotNull()
    text = lambda c, default: F.coalesce(F.trim(c), F.lit(default))
    stamp = lambda c: F.try_to_timestamp(F.regexp_replace(F.trim(c), "^$", "x"))
    return raw.select(
        text(F.col("identifier"), "ALERT-UNKNOWN").alias("identifier"), text(F.col("sender"), "UNKNOWN_AGENCY").alias("sender"), F.coalesce(stamp(F.col("sent")), F.lit(now).cast("timestamp")).alias("sent_at"), _within(F.col("msgType"), "msgType").alias("msg_type"),
        F.when(has, text(info["event"], "Emergency Incident")).otherwise("General Emergency").alias("event"), *[F.when(has, _within(info[c], c)).otherwise(CAP_DOMAINS[c][1]).alias(c) for c in ("urgency", "severity", "certainty")],
        F.when(has, text(info["description"], "")).otherwise("").alias("description"), F.filter(rings, lambda r: F.size(r) >= 3).alias("polygons"), stamp(info["expires"]).alias("expires_at"),
    )


def read_cap_alerts(spark: SparkSession, paths: str | list[str], now: str) -> DataFrame:
    """CAP 1.2 XML documents as alerts, whatever their namespaces."""
    return parse_alerts(cap_records(spark, paths), now)


def cap_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The fields of CAP 1.2 XML documents as they are."""
    return spark.read.format("xml").option("rowTag", "alert").option("ignoreNamespace", True).schema(CAP).load(paths)


def cap_rejects(records: DataFrame) -> DataFrame:
    """(record, code, message) of what ``parse_alerts`` replaces or drops, from ``cap_records``.

    Codes: missing_id and invalid_time (of sent or expires) of alerts that stay with defaults, invalid_polygon of each
    polygon of fewer than three readable points, which is dropped. An alert may have several.
    """
    info = F.try_element_at("info", F.lit(1))
    stamp = lambda c: F.try_to_timestamp(F.regexp_replace(F.trim(c), "^$", "x"))
    wrong = lambda c: (F.length(F.trim(c)) > 0) & stamp(c).isNull()
    fault = lambda test, code, text: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.coalesce(text, F.lit("")).alias("text")))
    alone = F.array(
        fault(F.coalesce(F.length(F.trim("identifier")), F.lit(0)) == 0, "missing_id", F.col("sender")),
        fault(wrong(F.col("sent")), "invalid_time", F.col("sent")),
        fault(wrong(info["expires"]), "invalid_time", info["expires"]),
    )
    areas = F.coalesce(info["area"], F.array().cast("array<struct<areaDesc:string,polygon:array<string>>>"))
    texts = F.flatten(F.transform(areas, lambda a: F.coalesce(a["polygon"], F.array().cast("array<string>"))))
    safe = lambda t: F.array_join(F.filter(F.split(F.trim(t), r"\s+"), lambda p: p.contains(",")), " ")
    small = F.filter(texts, lambda t: F.coalesce(F.size(cap_ring(safe(t))), F.lit(0)) < 3)
    shapes = F.transform(small, lambda t: fault(F.lit(True), "invalid_polygon", t))
    rows = records.select("identifier", F.explode(F.filter(F.concat(alone, shapes), lambda f: f.isNotNull())).alias("f"))
    return _told(rows, F.col("identifier"), F.col("f.code"), F.col("f.text"))


HAZARD_METADATA = "map<string,string>"


def alerts_to_hazards(alerts: DataFrame) -> DataFrame:
    """One hazard for each polygon of each alert, with severity, type and multiplier by severity and keyword."""
    rows = alerts.select("*", F.posexplode("polygons").alias("_n", "ring"))
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in feeds.CAP_SEVERITIES.items() for x in kv]), F.col("severity")), F.lit("severe"))
    meta = F.create_map(*[x for k, c in (("cap_identifier", "identifier"), ("sender", "sender"), ("urgency", "urgency"), ("severity", "severity"), ("certainty", "certainty")) for x in (F.lit(k), F.col(c))])
    return rows.select(
        F.concat(F.lit("cap_"), "identifier", F.lit("_"), F.col("_n") + 1).alias("hazard_id"), feeds.keyword_type(F.col("event"), feeds.ALERT_KEYWORDS).alias("hazard_type"), severity.alias("severity"), "ring",
        feeds.alert_multiplier(F.col("event"), F.col("severity")).alias("speed_multiplier"), F.concat("event", F.lit(": "), F.substring("description", 1, 120)).alias("description"), F.col("sent_at").alias("created_at"), "expires_at", F.lit(True).alias("active"), meta.alias("metadata"),
    )


def read_geojson_alerts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Polygon features as hazards; without speed_multiplier a feature blocks roads, whatever its severity."""
    f = read_features(spark, paths).where("kind = 'Polygon'").withColumn("_ring", F.try_element_at(F.from_json("coordinates", "array<array<array<double>>>"), F.lit(1))).where("size(_ring) >= 3")
    prop = lambda n: F.try_element_at("properties", F.lit(n))
    ring = geo.ring_of(F.transform("_ring", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return f.select(
        F.coalesce("id", prop("id"), F.concat(F.lit("geojson_alert_"), F.col("idx") + 1)).alias("hazard_id"), feeds.keyword_type(F.coalesce(prop("hazard_type"), prop("event"), F.lit("flood")), feeds.FEATURE_KEYWORDS).alias("hazard_type"), F.coalesce(prop("severity"), F.lit("severe")).alias("severity"), ring.alias("ring"),
        F.coalesce(prop("speed_multiplier").try_cast("double"), F.lit(0.0)).alias("speed_multiplier"), F.coalesce(prop("description"), prop("event"), F.lit("")).alias("description"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(True).alias("active"), F.col("properties").alias("metadata"),
    )


# Facility types by tags, in order, and capabilities by speciality.
POI_TYPES = [("amenity", "hospital", "hospital"), ("healthcare", "hospital", "hospital"), ("amenity", "fire_station", "fire_station"), ("emergency", "ambulance_station", "ambulance_station"), ("amenity", "police", "police"), ("aeroway", "helipad", "helipad"), ("emergency", "control_centre", "dispatch_center"), ("amenity", "clinic", "urgent_care"), ("healthcare", "centre", "urgent_care")]
SPECIALITIES = [("cardio", "cardiac_care"), ("stroke", "stroke_center"), ("neurolog", "stroke_center"), ("burn", "burn_center"), ("pediatric", "pediatric_care"), ("paediatric", "pediatric_care")]


def _poi_kind() -> Column:
    """The kind of facility that an element's tags name, null if none."""
    kind = F.lit(None).cast("string")
    for key, value, name in reversed(POI_TYPES):
        kind = F.when(F.try_element_at("tags", F.lit(key)) == value, name).otherwise(kind)
    return kind


def poi_rejects(elements: DataFrame) -> DataFrame:
    """(record, code, message) of the facilities that ``read_pois`` leaves out, from ``osm_elements``.

    Codes: malformed_record (no object, or without a type), and for elements with the tags of a facility missing_id,
    missing_coordinates and invalid_coordinates (no number, or outside WGS84). Other elements are no rejects.
    """
    place = F.col("lon").isNull() | F.col("lat").isNull()
    code = F.when(F.col("type").isNull(), "malformed_record").when(
        _poi_kind().isNotNull(),
        F.when(F.col("id").isNull(), "missing_id")
        .when(F.col("bad_number"), "invalid_coordinates")
        .when(place, "missing_coordinates")
        .when(~geo.valid_wgs84(F.col("lon"), F.col("lat")), "invalid_coordinates"),
    )
    return _told(elements, F.concat_ws("/", "type", "id"), code, F.col("raw"))


def read_pois(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Facilities of Overpass documents; ways and relations stand at their centre, other elements and places are left out."""
    return pois_of(osm_elements(spark, paths))


def pois_of(elements: DataFrame) -> DataFrame:
    """The facilities among ``osm_elements``; those left out for a fault are what ``poi_rejects`` tells of."""
    e = elements.withColumn("tags", F.coalesce("tags", F.create_map().cast(TAGS)))
    tag = lambda n: F.try_element_at("tags", F.lit(n))
    level = F.regexp_extract(F.coalesce(tag("emergency:trauma_level"), tag("trauma_level"), F.lit("")), r"([1-5])", 1).try_cast("int")
    special = F.lower(F.coalesce(tag("healthcare:speciality"), F.lit("")))
    yes = lambda n: F.coalesce(F.lower(tag(n)).isin("yes", "true", "1"), F.lit(False))
    having = [F.when(level.isNotNull(), F.concat(F.lit("trauma_level_"), level)), *[F.when(special.contains(w), c) for w, c in SPECIALITIES], F.when(yes("emergency:helipad") | yes("helipad") | (tag("aeroway") == "helipad"), "helipad"), F.when(yes("hazmat"), "hazmat_decon")]
    bays = F.coalesce(tag("fire_station:engine_bays"), tag("engine_bays")).try_cast("int")
    address = F.array_join(F.filter(F.array(tag("addr:housenumber"), tag("addr:street"), tag("addr:city")), lambda x: x.isNotNull()), ", ")
    title = F.initcap(F.replace(F.col("poi_type"), F.lit("_"), F.lit(" ")))
    out = e.withColumn("poi_type", _poi_kind()).where(~F.col("bad_number")).where(F.col("poi_type").isNotNull() & F.col("id").isNotNull() & geo.valid_wgs84(F.col("lon"), F.col("lat")))
    return out.select(
        F.concat_ws("/", "type", "id").alias("poi_id"), F.col("id").alias("osm_id"), F.col("type").alias("osm_type"), "poi_type", F.coalesce(F.when(F.length(F.trim(tag("name"))) > 0, F.trim(tag("name"))), F.concat(F.lit("Unnamed "), title, F.lit(" "), F.col("id"))).alias("name"), "lon", "lat",
        F.array_sort(F.array_distinct(F.filter(F.array(*having), lambda c: c.isNotNull()))).alias("capabilities"), level.alias("trauma_level"), bays.alias("apparatus_bays"), F.when(F.length(address) > 0, address).alias("address"), tag("phone").alias("phone"), tag("operator").alias("operator"),
    )


_VALUE = "array<struct<value:string>>"
GAUGES = f"value struct<timeSeries:array<struct<sourceInfo:struct<siteName:string,siteCode:{_VALUE},geoLocation:struct<geogLocation:struct<latitude:string,longitude:string>>>,variable:struct<variableCode:{_VALUE}>,values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>"
HEIGHT, FLOW = "00065", "00060"


def gauge_values(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every value of gauge documents: site_id, site_name, lat, lon, code, value and time as they are, x and ts if readable."""
    s = spark.read.schema(GAUGES).json(paths, multiLine=True).select(F.explode("value.timeSeries").alias("s"))
    place = F.col("s.sourceInfo.geoLocation.geogLocation")
    rows = s.select(
        F.try_element_at("s.sourceInfo.siteCode", F.lit(1))["value"].alias("site_id"),
        F.col("s.sourceInfo.siteName").alias("site_name"),
        place["latitude"].try_cast("double").alias("lat"),
        place["longitude"].try_cast("double").alias("lon"),
        F.try_element_at("s.variable.variableCode", F.lit(1))["value"].alias("code"),
        F.explode(F.flatten(F.transform("s.values", lambda v: v["value"]))).alias("v"),
    )
    return rows.withColumn("x", F.col("v.value").try_cast("double")).withColumn("ts", F.try_to_timestamp("v.dateTime"))


#: Values at or below this stand for none.
NO_VALUE = -999998


def gauge_rejects(values: DataFrame) -> DataFrame:
    """(record, code, message) of the values that ``read_gauges`` leaves out, from ``gauge_values``.

    Codes: missing_id, invalid_value (no number), missing_value (the mark for none), invalid_coordinates.
    """
    code = (
        F.when(F.col("site_id").isNull(), "missing_id")
        .when(F.col("x").isNull(), "invalid_value")
        .when(F.col("x") <= NO_VALUE, "missing_value")
        .when(~geo.valid_wgs84(F.col("lon"), F.col("lat")), "invalid_coordinates")
    )
    return _told(values, F.concat_ws("/", "site_id", "code"), code, F.to_json("v"))


def read_gauges(spark: SparkSession, paths: str | list[str], thresholds: DataFrame | None = None) -> DataFrame:
    """The latest height and flow of each site; sites without height or place are dropped.

    ``thresholds``: (site_id, action_ft, minor_ft, moderate_ft, major_ft); sites without any are normal.
    """
    rows = gauge_values(spark, paths).where(f"site_id IS NOT NULL AND x IS NOT NULL AND x > {NO_VALUE}").where(geo.valid_wgs84(F.col("lon"), F.col("lat")))
    order = F.struct(F.coalesce("ts", F.lit("1970-01-01").cast("timestamp")), "x")
    wide = rows.groupBy("site_id").agg(F.max("site_name").alias("site_name"), F.max("lon").alias("lon"), F.max("lat").alias("lat"), F.max("ts").alias("ts"), F.max_by(F.when(F.col("code") == HEIGHT, F.col("x")), F.when(F.col("code") == HEIGHT, order)).alias("gage_height_ft"), F.max_by(F.when(F.col("code") == FLOW, F.col("x")), F.when(F.col("code") == FLOW, order)).alias("streamflow_cfs")).where("gage_height_ft IS NOT NULL")
    stage = F.lit("normal")
    if thresholds is not None:
        wide = wide.join(thresholds, "site_id", "left")
        stage = feeds.flood_stage(F.col("gage_height_ft"), *[F.col(f"{k}_ft") for k in ("action", "minor", "moderate", "major")])
    return wide.select("site_id", F.coalesce(F.when(F.length("site_name") > 0, F.col("site_name")), F.concat(F.lit("USGS-"), "site_id")).alias("site_name"), "lon", "lat", "ts", "gage_height_ft", (F.col("gage_height_ft") * feeds.METERS_PER_FOOT).alias("gage_height_m"), "streamflow_cfs", stage.alias("flood_stage"))


WEATHER = "latitude double, longitude double, current struct<time:string,weather_code:int,temperature_2m:double,wind_speed_10m:double,precipitation:double>"


def read_weather(spark: SparkSession, paths: str | list[str], now: str) -> DataFrame:
    """Current conditions with their alert level; a bad time is ``now``."""
    w = spark.read.schema(WEATHER).json(paths, multiLine=True).where(geo.valid_wgs84(F.col("longitude"), F.col("latitude")))
    code, wind, rain = F.coalesce("current.weather_code", F.lit(0)), F.coalesce("current.wind_speed_10m", F.lit(0.0)), F.coalesce("current.precipitation", F.lit(0.0))
    return w.select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.coalesce(F.try_to_timestamp("current.time"), F.lit(now).cast("timestamp")).alias("ts"), code.alias("weather_code"), F.col("current.temperature_2m").alias("temperature_c"), wind.alias("wind_speed_kmh"), rain.alias("precipitation_mm"), feeds.weather_alert(code, wind, rain).alias("alert_level"))


# Ring radius in metres, severity and multiplier by flood stage. The action stage is published without
# values; it takes those of normal.
FLOODS = {"major": (1000.0, "critical_blocked", 0.0), "moderate": (500.0, "severe", 0.20), "minor": (250.0, "moderate", 0.50), "action": (100.0, "low", 0.75), "normal": (100.0, "low", 0.75)}
#: A minor flood widened to this radius or more is passed at this multiplier.
WIDE_MINOR = (750.0, 0.25)
WEATHER_RADIUS_M = 2000.0


def _by_stage(index: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in FLOODS.items() for x in (k, v[index])])[F.col("flood_stage")]


def gauges_to_hazards(gauges: DataFrame, radius_m: float | None = None) -> DataFrame:
    """A twelve-sided hazard around each gauge, by its stage or with a given radius."""
    radius = F.lit(radius_m) if radius_m is not None else _by_stage(0)
    multiplier = _by_stage(2)
    if radius_m is not None and radius_m >= WIDE_MINOR[0]:
        multiplier = F.when(F.col("flood_stage") == "minor", WIDE_MINOR[1]).otherwise(multiplier)
    return gauges.select(
        F.concat(F.lit("flood_"), "site_id").alias("hazard_id"), F.lit("flood_inundation").alias("hazard_type"), _by_stage(1).alias("severity"), geo.circle(F.col("lon"), F.col("lat"), radius).alias("ring"), multiplier.alias("speed_multiplier"),
        F.concat("site_name", F.lit(": "), "flood_stage").alias("description"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(True).alias("active"),
    )


def weather_to_hazards(weather: DataFrame, radius_m: float = WEATHER_RADIUS_M) -> DataFrame:
    """Hazards of watches and warnings; a warning with wind of 85 km/h or more blocks roads, heat over 38 degrees is a fire risk.

    Warnings with less wind are published without values; they take those of a watch.
    """
    blocks = (F.col("alert_level") == "warning") & (F.col("wind_speed_kmh") >= 85)
    return weather.where(F.col("alert_level").isin("watch", "warning")).select(
        F.concat_ws("_", F.lit("weather"), F.round("lon", 4), F.round("lat", 4)).alias("hazard_id"), F.when(F.col("temperature_c") > 38, "wildfire_perimeter").otherwise("flood_inundation").alias("hazard_type"), F.when(blocks, "critical_blocked").otherwise("severe").alias("severity"),
        geo.circle(F.col("lon"), F.col("lat"), F.lit(radius_m)).alias("ring"), F.when(blocks, 0.0).otherwise(0.35).alias("speed_multiplier"), F.concat(F.lit("weather "), "alert_level").alias("description"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(True).alias("active"),
    )


def environmental_summary(gauges: DataFrame, weather: DataFrame) -> DataFrame:
    """One row: gauges, how many of them flood, weather points, and how many carry alerts."""
    g = gauges.agg(F.count("*").alias("gauges"), F.count_if(feeds.is_flooding(F.col("flood_stage"))).alias("flooding"))
    return g.join(weather.agg(F.count("*").alias("weather_points"), F.count_if(F.col("alert_level").isin("watch", "warning")).alias("weather_alerts")))


def read_dem(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(tile, lat0, lon0, n, row, z): one row for each raster row of SRTM tiles named like N47W123.hgt.

    Tiles of another name or whose size is no square are left out.
    """
    files = spark.read.format("binaryFile").load(paths)

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = re.search(r"([NS])(\d{2})([EW])(\d{3})\.hgt$", path, re.IGNORECASE)
                n = int(round((len(content) / 2) ** 0.5))
                if not name or n < 2 or n * n * 2 != len(content):
                    continue
                lat, lon = int(name[2]) * (1 if name[1].upper() == "N" else -1), int(name[4]) * (1 if name[3].upper() == "E" else -1)
                z = np.frombuffer(content, ">i2").reshape(n, n).astype(np.int16)
                for lo in range(0, n, 256):
                    part = range(lo, min(lo + 256, n))
                    yield pd.DataFrame({"tile": name[0][:-4], "lat0": lat, "lon0": lon, "n": n, "row": list(part), "z": [z[r].tolist() for r in part]})

    return files.select("path", "content").mapInPandas(rows, "tile string, lat0 long, lon0 long, n int, row int, z array<smallint>")
