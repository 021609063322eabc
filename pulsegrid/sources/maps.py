"""Road networks from OSM JSON, OSM XML and GeoJSON, and compiled network tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import geo, roads
from pulsegrid.operators.network import prune_orphans, with_reverse

TAGS = "map<string,string>"
#: An element as its document has it; what must be a number is read as text, so that a bad one spoils itself alone.
_ELEMENT = f"type string, id string, lat string, lon string, nodes array<string>, center struct<lat:string,lon:string>, tags {TAGS}"
REJECTS = ("record", "code", "message")


def json_documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """(document, d): the name of each file and its whole text parsed by ``schema``: UTF-8, or UTF-16 or UTF-32 told by the first bytes.

    Spark's multi-line JSON reader opens a file anew for each object or array that is taken as text, so its time grows
    with such values times the opening of a file; of a text in memory they are taken as slices.
    """
    text = spark.read.text(paths, wholetext=True)
    raw = F.col("value").cast("binary")
    head, read = F.hex(F.substring(raw, 1, 4)), F.ltrim("value", F.lit("\ufeff"))
    for pattern, charset in (("^..00", "UTF-16LE"), ("^00", "UTF-16BE"), ("^(FEFF|FFFE)", "UTF-16"), ("^(0000FEFF|FFFE0000|000000)", "UTF-32")):
        read = F.when(head.rlike(pattern), F.decode(raw, charset)).otherwise(read)
    parsed = F.from_json(read, schema)
    return text.select(F.input_file_name().alias("document"), F.explode(F.array(parsed)).alias("d"))  # parsed once, however many fields are taken


def osm_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every element of OSM JSON documents: raw (its JSON text), type, id, lon, lat, nodes, tags and bad_number.

    Elements stand where they are or at their centre. Each is parsed on its own: one that is no object has nulls.
    bad_number says that a coordinate is there but is no number.
    """
    raw = json_documents(spark, paths, "elements array<string>").select(F.explode("d.elements").alias("raw"))
    e = raw.withColumn("e", F.from_json("raw", _ELEMENT))
    number = lambda c: F.coalesce(F.col(f"e.{c}"), F.col(f"e.center.{c}"))
    lon, lat = (number(c).try_cast("double") for c in ("lon", "lat"))
    bad = (number("lon").isNotNull() & lon.isNull()) | (number("lat").isNotNull() & lat.isNull())
    nodes = F.transform("e.nodes", lambda n: n.try_cast("long"))
    return e.select(
        "raw",
        F.col("e.type").alias("type"),
        F.col("e.id").try_cast("long").alias("id"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.col("e.lon").try_cast("double").alias("own_lon"),
        F.col("e.lat").try_cast("double").alias("own_lat"),
        nodes.alias("nodes"),
        F.col("e.tags").alias("tags"),
        bad.alias("bad_number"),
    )


def _told(rows: DataFrame, record: Column, code: Column, message: Column) -> DataFrame:
    """(record, code, message) of the rows that have a code; messages are the first 200 characters."""
    told = rows.select(record.alias("record"), code.alias("code"), F.substring(message, 1, 200).alias("message"))
    return told.where("code IS NOT NULL")


def osm_rejects(elements: DataFrame) -> DataFrame:
    """(record, code, message) of the elements that no network can take, from ``osm_elements``.

    Codes: malformed_record (no object, or without a type), missing_id, missing_coordinates and invalid_coordinates
    of nodes, missing_nodes of ways. Other types are no part of a network, and no rejects.
    """
    is_node, is_way = F.col("type") == "node", F.col("type") == "way"
    code = (
        F.when(F.col("type").isNull(), "malformed_record")
        .when((is_node | is_way) & F.col("id").isNull(), "missing_id")
        .when(is_node & F.col("bad_number"), "invalid_coordinates")
        .when(is_node & (F.col("own_lat").isNull() | F.col("own_lon").isNull()), "missing_coordinates")
        .when(is_way & F.col("nodes").isNull(), "missing_nodes")
    )
    return _told(elements, F.concat_ws("/", "type", "id"), code, F.col("raw"))


def _network(points: DataFrame, ways: DataFrame, profile: str, allow_emergency: bool, highways: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """points: (id, lon, lat, tags); ways: (way_id, refs, tags)."""
    highway = roads.tag(F.col("tags"), "highway")
    kept = ways.where(roads.road_class_kept(highway, highways) & roads.way_accessible(F.col("tags"), allow_emergency))
    refs = kept.select(F.explode(F.transform("refs", lambda r: r.cast("string"))).alias("node_id"))
    first = F.coalesce(F.when(F.length(roads.tag(F.col("tags"), "name")) > 0, roads.tag(F.col("tags"), "name")), roads.tag(F.col("tags"), "ref"))
    nodes = prune_orphans(points.dropDuplicates(["id"]).select(F.col("id").cast("string").alias("node_id"), first.alias("label"), "lon", "lat"), refs)
    pairs = geo.path_pairs(F.transform("refs", lambda r: r.cast("string")))
    steps = kept.select(F.col("way_id"), "tags", F.posexplode(pairs).alias("pos", "s")).select("way_id", "pos", "tags", F.col("s.src").alias("src"), F.col("s.dst").alias("dst"))
    at = nodes.select("node_id", "lon", "lat")
    both = steps.join(at.select(F.col("node_id").alias("src"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat")), "src").join(at.select(F.col("node_id").alias("dst"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat")), "dst")
    distance = geo.haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    tag = lambda name: roads.tag(F.col("tags"), name)
    costed = both.withColumn("c", roads.edge_cost(distance, tag("highway"), tag("maxspeed"), profile)).withColumn("d", roads.directions(F.col("tags")))
    edges = costed.select("src", "dst", "c.*", tag("highway").alias("highway"), *[tag(n).alias(n) for n in ("name", "oneway", "surface", "lanes")], roads.way_accessible(F.col("tags")).alias("emergency_accessible"), "d.*")
    return nodes, with_reverse(edges)


def read_osm_json(spark: SparkSession, paths: str | list[str], profile: str = "distance", allow_emergency: bool = True, highways: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of OSM JSON documents; elements without what they need are left out."""
    return osm_network(osm_elements(spark, paths), profile, allow_emergency, highways)


def osm_network(elements: DataFrame, profile: str = "distance", allow_emergency: bool = True, highways: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``osm_elements``; what is left out for a fault is what ``osm_rejects`` tells of."""
    points = elements.where("type = 'node' AND id IS NOT NULL AND own_lat IS NOT NULL AND own_lon IS NOT NULL").select("id", F.col("own_lon").alias("lon"), F.col("own_lat").alias("lat"), "tags")
    ways = elements.where("type = 'way' AND id IS NOT NULL AND nodes IS NOT NULL").select(F.col("id").alias("way_id"), F.col("nodes").alias("refs"), F.coalesce("tags", F.create_map().cast(TAGS)).alias("tags"))
    return _network(points, ways, profile, allow_emergency, highways)


def _xml_tags(col: str) -> Column:
    good = F.filter(col, lambda t: (F.length(t["_k"]) > 0) & (F.length(t["_v"]) > 0))
    unique = F.array_distinct(F.transform(good, lambda t: t["_k"]))
    last = F.transform(unique, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(good, lambda t: t["_k"] == k), -1)["_v"].alias("v")))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast(TAGS))


def read_osm_xml(spark: SparkSession, paths: str | list[str], profile: str = "distance", allow_emergency: bool = True, highways: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of OSM XML documents, whatever their namespaces; tags with an empty key or value are dropped."""
    tag = "tag array<struct<_k:string,_v:string,_VALUE:string>>"
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", True).option("mode", "PERMISSIVE").schema(schema).load(paths)
    points = read("node", f"_id long, _lat double, _lon double, {tag}").where("_id IS NOT NULL AND _lat IS NOT NULL AND _lon IS NOT NULL").select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _xml_tags("tag").alias("tags"))
    ways = read("way", f"_id long, nd array<struct<_ref:long,_VALUE:string>>, {tag}").where("nd IS NOT NULL").select(F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _xml_tags("tag").alias("tags"))
    return _network(points, ways, profile, allow_emergency, highways)


FEATURES = "type string, features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(document, idx, id, kind, coordinates as JSON text, properties) of GeoJSON feature collections."""
    docs = json_documents(spark, paths, FEATURES).where("d.type = 'FeatureCollection'").select("document", "d.features")
    rows = docs.select("document", F.posexplode("features").alias("idx", "f"))
    return rows.select("document", "idx", F.col("f.id").alias("id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.coalesce("f.properties", F.create_map().cast(TAGS)).alias("properties"))


def _point(pair: Column) -> Column:
    return F.struct(pair[0].alias("lon"), pair[1].alias("lat"))


def read_geojson_network(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of GeoJSON points and lines.

    Points are nodes; lines with source and destination are edges whose missing cost is the distance of their ends;
    other lines are split in segments. Points outside WGS84 are rejected. Ends that are no nodes become nodes.
    """
    f = read_features(spark, paths)
    prop = lambda n: F.when(F.length(roads.tag(F.col("properties"), n)) > 0, roads.tag(F.col("properties"), n))
    points = f.where("kind = 'Point'").withColumn("c", F.from_json("coordinates", "array<double>")).where("size(c) >= 2")
    points = points.withColumn("node_id", F.coalesce(prop("node_id"), F.col("id"), F.concat(F.lit("pt_"), F.col("idx")))).withColumn("ok", geo.valid_wgs84(F.col("c")[0], F.col("c")[1]))
    rejects = points.where("NOT ok").select(F.col("node_id").alias("record"), F.lit("invalid_coordinates").alias("code"), F.col("coordinates").alias("message"))
    own = points.where("ok").select("node_id", F.coalesce(prop("label"), F.concat(F.lit("Node "), F.col("node_id"))).alias("label"), F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"), F.struct(F.lit(0).alias("pass"), "document", "idx", F.lit(0).alias("seg")).alias("rank"))
    lines = f.where("kind = 'LineString'").withColumn("c", F.from_json("coordinates", "array<array<double>>")).where("size(c) >= 2").withColumn("line", F.transform("c", _point))
    whole = prop("source").isNotNull() & prop("destination").isNotNull()
    named = lines.where(whole).select("document", "idx", prop("source").alias("src"), prop("destination").alias("dst"), prop("cost").try_cast("double").alias("given"), F.col("line")[0].alias("a"), F.element_at("line", -1).alias("b"), F.lit(0).alias("seg"))
    split = lines.where(~whole).select("document", "idx", F.posexplode(geo.path_pairs(F.col("line"))).alias("seg", "s"))
    name = lambda k: F.concat(F.lit("line_"), F.col("idx"), F.lit("_seg_"), F.col("seg") + k)
    split = split.select("document", "idx", name(0).alias("src"), name(1).alias("dst"), F.lit(None).cast("double").alias("given"), F.col("s.src").alias("a"), F.col("s.dst").alias("b"), "seg")
    every = named.unionByName(split)
    edges = every.select("src", "dst", F.coalesce("given", geo.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))).alias("cost"))
    ends = every.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("a").alias("at"), "seg"), F.struct(F.col("dst").alias("node_id"), F.col("b").alias("at"), "seg"))).alias("e"), "document", "idx")
    implied = ends.select("e.node_id", F.lit(None).cast("string").alias("label"), "e.at.lon", "e.at.lat", F.struct(F.lit(1).alias("pass"), "document", "idx", F.col("e.seg").alias("seg")).alias("rank"))
    nodes = own.unionByName(implied).groupBy("node_id").agg(F.min_by(F.struct("label", "lon", "lat"), "rank").alias("n")).select("node_id", "n.*")
    return nodes, edges, rejects


def table_checksum(df: DataFrame) -> DataFrame:
    """One row: rows and a checksum that does not depend on their order (sums and xors of each row's SHA-256)."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    h = F.sha2(text, 256)
    parts = [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    total = F.concat_ws("-", F.count("*"), *[F.coalesce(F.sum(p), F.lit(0)) for p in parts], *[F.coalesce(F.bit_xor(p.cast("long")), F.lit(0)) for p in parts])
    return df.agg(F.count("*").alias("rows"), F.sha2(total, 256).alias("checksum"))


NETWORK_VERSION = "1"


def write_network(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Compiled network tables with their checksums."""
    sums = []
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        sums.append(table_checksum(df.sparkSession.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("table"), "rows", "checksum", F.lit(NETWORK_VERSION).alias("version")))
    sums[0].union(sums[1]).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def read_network(spark: SparkSession, folder: str, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a compiled network; another version or a wrong checksum raises ValueError."""
    meta = {r["table"]: r for r in spark.read.json(f"{folder}/meta").collect()}
    out = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{folder}/{name}")
        if name not in meta or str(meta[name]["version"]) != NETWORK_VERSION:
            raise ValueError(f"{folder}: version of {name} is not {NETWORK_VERSION}")
        if verify and table_checksum(df).first()["checksum"] != meta[name]["checksum"]:
            raise ValueError(f"{folder}: checksum of {name} does not match")
        out.append(df)
    return out[0], out[1]
