"""Registered queries over whole network searches, with SQL that relaxes a keyed table until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import dispatch, network
from pulsegrid.plans.more_queries import METRES
from pulsegrid.plans.queries import SQL, _at, _blocks, query
from pulsegrid.plans.views import oracle, table, view

#: The least cost from every start to every node it reaches.
WHOLE = """WITH RECURSIVE road AS (SELECT {a} AS src, {b} AS dst, min(cost) AS cost FROM edges GROUP BY 1, 2),
w(source, node, cost) USING KEY (source, node) AS (SELECT {start}, {start}, CAST(0 AS DOUBLE) FROM {of}
  UNION SELECT w.source, road.dst, min(w.cost + road.cost) FROM w JOIN road ON road.src = w.node LEFT JOIN recurring.w AS known ON known.source = w.source AND known.node = road.dst
  WHERE known.cost IS NULL OR w.cost + road.cost < known.cost GROUP BY w.source, road.dst)"""
_FROM_DEPOTS = WHOLE.format(a="src", b="dst", start="depot", of="depots JOIN nodes ON node_id = depot")
_FROM_UNITS = WHOLE.format(a="src", b="dst", start="current_node_id", of="(SELECT DISTINCT current_node_id FROM units WHERE status = 'available') AS s JOIN nodes ON node_id = current_node_id")

SQL["depot_paths"] = oracle(f"{_FROM_DEPOTS} SELECT source, node, cost FROM w")
SQL["eta_table"] = oracle(f"""{_FROM_DEPOTS} SELECT a.depot AS source, b.depot AS node, coalesce(w.cost, CAST('Infinity' AS DOUBLE)) AS cost
FROM depots a CROSS JOIN depots b LEFT JOIN w ON w.source = a.depot AND w.node = b.depot""")

_NEAREST = "near AS (SELECT node, source AS depot, cost, row_number() OVER (PARTITION BY node ORDER BY cost, source) AS rank FROM w)"
SQL["whole_catchments"] = oracle(f"{_FROM_DEPOTS}, {_NEAREST} SELECT node, depot, cost FROM near WHERE rank = 1")

SQL["bounded_paths"] = oracle(f"{_FROM_DEPOTS} SELECT source, node, cost FROM w WHERE cost <= 60")
SQL["depot_catchments"] = oracle(f"""{_FROM_DEPOTS}, {_NEAREST}
SELECT node_id AS node, near.depot, near.cost FROM nodes LEFT JOIN near ON near.node = node_id AND rank = 1 AND near.cost <= 40""")
SQL["route_paths"] = oracle(f"{_FROM_DEPOTS} SELECT source, node, cost, true AS valid FROM w")

#: Cost and metres in one number: whole costs in millions, so of equal costs the shortest way counts.
_MEASURED = _FROM_UNITS.replace("min(cost) AS cost FROM edges", f"min(cost * 1000000 + {METRES}) AS cost FROM edges", 1)
_SPLIT = "m AS (SELECT source, node, floor(cost / 1000000) AS cost, cost % 1000000 AS metres FROM w)"
_METRES = "CASE WHEN metres = 0 THEN cost ELSE metres END"

SQL["nearest_units"] = oracle(f"""{_FROM_UNITS},
ranked AS (SELECT w.node, u.apparatus_type, u.unit_id, w.cost / u.speed_factor AS eta_s, row_number() OVER (PARTITION BY w.node, u.apparatus_type ORDER BY w.cost / u.speed_factor, u.unit_id) AS rank
  FROM w JOIN units u ON u.current_node_id = w.source WHERE u.status = 'available')
SELECT i.incident_id, r.apparatus_type, r.unit_id, r.eta_s, CAST(r.rank AS INT) AS rank FROM incidents i LEFT JOIN ranked r ON r.node = i.node_id AND r.rank <= 2""")

SQL["ranked_units"] = oracle(f"""{_MEASURED}, {_SPLIT},
ranked AS (SELECT i.node_id, u.apparatus_type, u.unit_id, coalesce(m.cost / u.speed_factor, CAST('Infinity' AS DOUBLE)) AS eta_s, coalesce({_METRES}, 0) AS distance_m, m.cost IS NOT NULL AS reachable,
  row_number() OVER (PARTITION BY i.node_id, u.apparatus_type ORDER BY coalesce(m.cost / u.speed_factor, CAST('Infinity' AS DOUBLE)), u.unit_id) AS rank
  FROM (SELECT DISTINCT node_id FROM incidents) i CROSS JOIN units u LEFT JOIN m ON m.source = u.current_node_id AND m.node = i.node_id WHERE u.status = 'available')
SELECT i.incident_id, r.apparatus_type, r.unit_id, r.eta_s, r.distance_m, r.reachable, CAST(r.rank AS INT) AS rank, CASE WHEN r.rank IS NOT NULL THEN true END AS valid
FROM incidents i LEFT JOIN ranked r ON r.node_id = i.node_id AND r.rank <= 2""")

SQL["allocations"] = oracle(f"""{_MEASURED}, {_SPLIT},
need AS (SELECT incident_id, node_id, ord AS req_ordinal, kind AS required_type, v.k FROM incidents CROSS JOIN (VALUES (0, 'fire_engine', 1), (1, 'ambulance_als', 1), (2, 'fire_engine', 2)) v(ord, kind, k) WHERE event_type = 'error'
  UNION ALL SELECT incident_id, node_id, 0, 'ambulance_als', 1 FROM incidents WHERE event_type <> 'error'),
ranked AS (SELECT m.node, u.apparatus_type, u.unit_id, m.cost / u.speed_factor AS eta_s, {_METRES} AS distance_m, row_number() OVER (PARTITION BY m.node, u.apparatus_type ORDER BY m.cost / u.speed_factor, u.unit_id) AS k
  FROM m JOIN units u ON u.current_node_id = m.source WHERE u.status = 'available')
SELECT n.incident_id, CAST(n.req_ordinal AS INT) AS req_ordinal, n.required_type, r.unit_id, coalesce(r.eta_s, CAST('Infinity' AS DOUBLE)) AS eta_s, coalesce(r.distance_m, 0) AS distance_m, r.unit_id IS NOT NULL AS fulfilled, true AS valid
FROM need n LEFT JOIN ranked r ON r.node = n.node_id AND r.apparatus_type = n.required_type AND r.k = n.k""")

#: Needs in the order of the queue take units one after another; taken holds those of the needs before.
SQL["exclusive_allocations"] = oracle(f"""{_MEASURED}, {_SPLIT},
q AS (SELECT incident_id, node_id, event_type, row_number() OVER (ORDER BY CASE urgency WHEN 'priority_1_echo' THEN 0 WHEN 'priority_2_delta' THEN 1 WHEN 'priority_3_bravo' THEN 2 WHEN 'priority_4_alpha' THEN 3 ELSE 4 END, reported_at, incident_id) AS turn FROM incidents),
need AS (SELECT *, row_number() OVER (PARTITION BY required_type ORDER BY turn) AS pos FROM (SELECT incident_id, node_id, turn, 0 AS req_ordinal, 'fire_engine' AS required_type FROM q WHERE event_type = 'error'
  UNION ALL SELECT incident_id, node_id, turn, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, 'ambulance_als' FROM q)),
option AS (SELECT n.required_type, n.pos, u.unit_id, m.cost / u.speed_factor AS eta_s, {_METRES} AS distance_m FROM need n JOIN units u ON u.apparatus_type = n.required_type AND u.status = 'available' JOIN m ON m.source = u.current_node_id AND m.node = n.node_id),
listed AS (SELECT required_type, pos, list(struct_pack(eta := eta_s, id := unit_id, d := distance_m) ORDER BY eta_s, unit_id) AS wishes FROM option GROUP BY required_type, pos),
turns AS (SELECT required_type, pos, wishes, row_number() OVER (PARTITION BY required_type ORDER BY pos) AS step FROM listed),
took(required_type, step, got, taken) AS (SELECT DISTINCT required_type, CAST(0 AS BIGINT), CAST(NULL AS STRUCT(eta DOUBLE, id VARCHAR, d DOUBLE)), CAST([] AS VARCHAR[]) FROM turns
  UNION ALL SELECT o.required_type, o.step, o.pick, CASE WHEN o.pick IS NULL THEN o.taken ELSE list_append(o.taken, o.pick.id) END
  FROM (SELECT t.required_type, t.step, k.taken, list_filter(t.wishes, lambda x: NOT list_contains(k.taken, x.id))[1] AS pick FROM took k JOIN turns t ON t.required_type = k.required_type AND t.step = k.step + 1) o)
SELECT n.incident_id, CAST(n.req_ordinal AS INT) AS req_ordinal, n.required_type, k.got.id AS unit_id, coalesce(k.got.eta, CAST('Infinity' AS DOUBLE)) AS eta_s, coalesce(k.got.d, 0) AS distance_m, k.got.id IS NOT NULL AS fulfilled, true AS valid
FROM need n LEFT JOIN turns t ON t.required_type = n.required_type AND t.pos = n.pos LEFT JOIN took k ON k.required_type = n.required_type AND k.step = t.step""")

#: Every node's component: the least node that it reaches and that reaches it.
_SCC = """WITH RECURSIVE reach AS (SELECT node_id AS a, node_id AS b FROM nodes UNION SELECT reach.a, edges.dst FROM reach JOIN edges ON edges.src = reach.b),
part AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"""
SQL["components"] = oracle(f"{_SCC} SELECT node, component FROM part")


@query(f"""{_SCC}, top AS (SELECT component FROM part GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT edges.src, edges.dst, edges.cost FROM edges JOIN part x ON x.node = edges.src JOIN part y ON y.node = edges.dst WHERE x.component IN (FROM top) AND y.component IN (FROM top)""")
def main_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _at(spark, sf_dir, "nodes", "edges")
    return network.largest_component(nodes, edges, _blocks(nodes, 25))[1].select("src", "dst", "cost")


@query(f"{_FROM_DEPOTS}, {_NEAREST} SELECT depot, count(*) AS n, md5(string_agg(node, ',' ORDER BY node)) AS members FROM near WHERE rank = 1 GROUP BY depot")
def catchment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, depots = _at(spark, sf_dir, "nodes", "edges", "depots")
    lists = network.catchment_lists(network.catchment(edges, depots, nodes, blocks=_blocks(nodes, 25)))
    return lists.select("depot", F.size("nodes").cast("long").alias("n"), F.md5(F.array_join("nodes", ",")).alias("members"))


@query(f"{_FROM_DEPOTS}, {_NEAREST} SELECT node, depot, cost FROM near WHERE rank = 1 AND node IN (SELECT node_id FROM incidents)")
def incident_depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, depots, incidents = _at(spark, sf_dir, "nodes", "edges", "depots", "incidents")
    found = network.catchment(edges, depots, nodes, blocks=_blocks(nodes, 25))
    return network.closest_depot(found, incidents.select(F.col("node_id").alias("node")))


_POIS = """SELECT CONCAT('P', CAST(s_suppkey AS STRING)) AS poi_id, CAST((s_suppkey * 37) % n AS STRING) AS nearest_node_id, s_suppkey AS s,
CASE WHEN s_suppkey % 4 = 2 AND s_suppkey % 8 <> 2 THEN 1 END AS trauma_level FROM {supplier} CROSS JOIN {size}"""
_REVERSED = WHOLE.format(a="dst", b="src", start="nearest_node_id", of="(SELECT DISTINCT nearest_node_id FROM pois) AS s JOIN nodes ON node_id = nearest_node_id")


@query(_REVERSED.replace("WITH RECURSIVE road", f"WITH RECURSIVE pois AS ({_POIS.format(supplier='supplier', size='size')}), road") + """,
asked AS (SELECT incident_id, node_id, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 9 ELSE -1 END AS kind FROM incidents),
met AS (SELECT a.incident_id, w.cost, p.poi_id, row_number() OVER (PARTITION BY a.incident_id ORDER BY w.cost, p.poi_id) AS rank
  FROM asked a JOIN w ON w.node = a.node_id JOIN pois p ON p.nearest_node_id = w.source WHERE kind = -1 OR (kind = p.s % 4 AND (kind <> 2 OR p.trauma_level IS NOT NULL)))
SELECT a.incident_id, m.poi_id, m.cost FROM asked a LEFT JOIN met m ON m.incident_id = a.incident_id AND m.rank = 1""")
def capable_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest facility with what each incident needs; nobody has a stroke center, and half of the trauma sites have no level."""
    nodes, edges, incidents = _at(spark, sf_dir, "nodes", "edges", "incidents")
    pois = spark.sql(_POIS.format(supplier="{supplier}", size="{size}"), supplier=table(spark, sf_dir, "supplier"), size=view(spark, sf_dir, "size"))
    own = {1: ["burn_center"], 2: ["trauma_level_1", "helipad"], 3: ["cardiac_care"]}
    having = F.array().cast("array<string>")
    for k, names in own.items():
        having = F.when(F.col("s") % 4 == k, F.array(*map(F.lit, names))).otherwise(having)
    needs = F.when(F.col("event_type") == "error", F.array(F.lit("trauma_level_1"))).when(F.col("event_type") == "purchase", F.array(F.lit("burn_center"))).when(F.col("event_type") == "signup", F.array(F.lit("stroke_center")))
    asked = incidents.select("incident_id", "node_id", needs.alias("required"))
    return network.nearest_facility(edges, asked, pois.withColumn("capabilities", having), _blocks(nodes, 25))


@query("""SELECT incident_id, urgency IN ('priority_1_echo', 'priority_2_delta') AS life_threatening, event_type = 'error' AS needs_engine FROM incidents""")
def incident_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "incidents").withColumn("required", F.when(F.col("event_type") == "error", F.array(F.lit("fire_engine"), F.lit("ambulance_als"))).otherwise(F.array(F.lit("ambulance_als"))))
    return rows.select("incident_id", dispatch.life_threatening(F.col("urgency")).alias("life_threatening"), dispatch.requires(F.col("required"), "fire_engine").alias("needs_engine"))


@query("""SELECT p_partkey, string_agg(kind, ',' ORDER BY must DESC, kind) AS kinds FROM part CROSS JOIN (VALUES ('heavy_rescue', 0), ('fire_engine', 1), ('ambulance_als', 2), ('ladder_truck', 3)) v(kind, i)
CROSS JOIN LATERAL (SELECT (p_size + i) % 3 = 0 AS must) GROUP BY p_partkey""", plain=True)
def requirement_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["heavy_rescue", "fire_engine", "ambulance_als", "ladder_truck"]
    needs = F.array(*[F.struct(F.lit(k).alias("apparatus_type"), ((F.col("p_size") + i) % 3 == 0).alias("is_mandatory")) for i, k in enumerate(kinds)])
    ordered = dispatch.sorted_requirements(needs)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(ordered, lambda r: r["apparatus_type"]), ",").alias("kinds"))


@query("""WITH b AS (SELECT CONCAT('OSM-', CASE s_suppkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' ELSE 'R' END, '-', CAST(s_suppkey AS STRING)) AS station_id, CAST((s_suppkey * 37) % n AS STRING) AS node_id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'fire_station' ELSE 'hospital' END AS kind FROM supplier CROSS JOIN size),
p AS (SELECT * FROM (VALUES ('fire_station', 'fire_engine', 2, 1.0::DOUBLE), ('fire_station', 'ladder_truck', 1, 0.9::DOUBLE), ('hospital', 'ambulance_als', 3, 1.1::DOUBLE), ('hospital', 'hazmat_unit', 0, 1.0::DOUBLE)) v(kind, type, c, f))
SELECT CONCAT(b.station_id, '-', p.type, '-', CAST(i AS STRING)) AS unit_id, p.type AS apparatus_type, b.node_id AS current_node_id, b.station_id, 'available' AS status, p.f AS speed_factor
FROM b JOIN p ON p.kind = b.kind CROSS JOIN (VALUES (1), (2), (3)) t(i) WHERE i <= p.c""")
def fleet_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = spark.sql("""SELECT CASE s_suppkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type, s_suppkey AS osm_id, s_name AS name, CAST((s_suppkey * 37) % n AS STRING) AS nearest_node_id,
        CASE WHEN s_suppkey % 2 = 0 THEN 'fire_station' ELSE 'hospital' END AS poi_type, CAST(array() AS array<string>) AS capabilities FROM {supplier} CROSS JOIN {size}""", supplier=table(spark, sf_dir, "supplier"), size=view(spark, sf_dir, "size"))
    rows = [("fire_station", "fire_engine", 2, 1.0), ("fire_station", "ladder_truck", 1, 0.9), ("hospital", "ambulance_als", 3, 1.1), ("hospital", "hazmat_unit", 0, 1.0)]
    blueprint = spark.createDataFrame(rows, "poi_type string, apparatus_type string, count int, speed_factor double")
    return dispatch.facilities_to_fleet(bound, blueprint)[1].drop("capabilities")
