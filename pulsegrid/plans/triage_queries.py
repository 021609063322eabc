"""Registered queries over model answers, their validation and the policy, with SQL written from the rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans import rules, triage
from pulsegrid.plans.queries import query
from pulsegrid.plans.views import table


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _cases(column: str, values: list[str]) -> str:
    """A CASE over the remainders of ``column``."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# --- answers of a model

#: Answers: fenced, bare, with unknown members, and each kind that cannot be read; NUMBER stands for the event.
ANSWERS = [
    '```json {"emergency_type": " Cardiac_Arrest", "urgency": "PRIORITY_1_ECHO ", "confidence_score": 1.7, "suggested_apparatus": ["Ambulance_ALS", "tank", "fire_engine"]} ```',
    'I think {"emergency_type": "flash_flood", "urgency": "priority_2_delta", "confidence_score": -2, "hazards_detected": [{"hazard_type": "FLASH_FLOOD", "confidence": 9}, {"hazard_type": "dragon"}]} fits',
    '{"emergency_type": "medical_general", "location_text": "Pier NUMBER"}',
    '{"emergency_type": "alien_landing", "urgency": "priority_1_echo"}',
    '{"emergency_type": "structure_fire", "urgency": "soon"}',
    '{"emergency_type": "structure_fire", ',
    "no braces at all",
    '```json {"urgency": "priority_3_bravo"} ``` or ```json {"urgency": "priority_4_alpha"} ```',
    "{broken: NUMBER}",
]
_ERRORS = ["NULL", "NULL", "NULL", "'invalid_emergency_type'", "'invalid_urgency'", "'no_json'", "'no_json'", "'ambiguous_output'", "'malformed_json'"]


@query(f"""SELECT event_id, {_cases("event_id", _ERRORS)} AS error_code, {_cases("event_id", ["'cardiac_arrest'", "'flash_flood'", "'medical_general'"] + ["NULL"] * 6)} AS emergency_type,
{_cases("event_id", ["'priority_1_echo'", "'priority_2_delta'"] + ["NULL"] * 7)} AS urgency, CAST({_cases("event_id", ["1.0", "0.0", "0.5"] + ["NULL"] * 6)} AS DOUBLE) AS confidence_score,
{_cases("event_id", ["'ambulance_als,fire_engine'", "''", "''"] + ["NULL"] * 6)} AS apparatus, {_cases("event_id", ["''", "'flash_flood:1.0'", "''"] + ["NULL"] * 6)} AS hazards,
{_cases("event_id", ["NULL", "NULL", "CONCAT('Pier ', CAST(event_id AS STRING))"] + ["NULL"] * 6)} AS location_text FROM events""", plain=True)
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for each event: nine kinds of them, from fenced JSON to none."""
    answer = F.lit(ANSWERS[-1])
    for i, text in enumerate(ANSWERS[:-1]):
        answer = F.when(F.col("event_id") % len(ANSWERS) == i, text).otherwise(answer)
    outputs = table(spark, sf_dir, "events").select("event_id", F.replace(answer, F.lit("NUMBER"), F.col("event_id").cast("string")).alias("output"))
    p = triage.parse_proposals(outputs)
    hazards = F.transform("proposal.hazards_detected", lambda h: F.concat_ws(":", h["hazard_type"], h["confidence"].cast("string")))
    return p.select(
        "event_id",
        "error_code",
        *[F.col(f"proposal.{c}").alias(c) for c in ("emergency_type", "urgency", "confidence_score")],
        F.array_join("proposal.suggested_apparatus", ",").alias("apparatus"),
        F.array_join(hazards, ",").alias("hazards"),
        F.col("proposal.location_text").alias("location_text"),
    )


# --- validation: each event a proposal whose parts follow from its number

_REPORTS = ["'Patient unconscious'", "'a fender bender'", "' '", "'smoke seen'", "'heart attack downtown'"]
_KINDS = ["'cardiac_arrest'", "'Trauma_Major'", "'nonsense'", "NULL"]
_URGENT = ["'priority_1_echo'", "'PRIORITY_3_bravo'", "'whenever'", "NULL", "'priority_4_alpha'"]
_NODES = ["NULL", "'1'", "'no such node'"]
_SUGGESTED = [[], ["fire_engine"], ["Ambulance_BLS", "fire_engine"], ["tank", "ladder_truck"]]
_DETECTED = [[], ["flash_flood"], ["dragon", "Road_Collapse"]]
_PARTS = {"report": ("event_id", _REPORTS), "emergency_type": ("user_id", _KINDS), "urgency": ("event_id + user_id", _URGENT), "suggested_node_id": ("event_id", _NODES)}


@query(f"""WITH c AS (SELECT event_id, trim({_cases("event_id", _REPORTS)}) AS report, lower({_cases("user_id", _KINDS)}) AS kind, lower({_cases("(event_id + user_id)", _URGENT)}) AS urgency, {_cases("event_id", _NODES)} AS node,
  event_id % 7 IN (1, 2) AS given, event_id % 7 = 1 AS placed, {_cases("(user_id + 1)", [_listed([x.lower() for x in v]) if v else "CAST([] AS VARCHAR[])" for v in _SUGGESTED])} AS apparatus, {_cases("(event_id + 2 * user_id)", [_listed([x.lower() for x in v]) if v else "CAST([] AS VARCHAR[])" for v in _DETECTED])} AS hazards,
  CASE WHEN event_id % 2 = 0 THEN 'behind the mill' END AS described, CAST((event_id % 11) / 10.0 AS DOUBLE) AS score FROM events),
t AS (SELECT *, coalesce(kind IN {tuple(rules.EMERGENCY_TYPES)}, false) AS kind_ok, coalesce(urgency IN {tuple(rules.URGENCIES)}, false) AS urgency_ok, coalesce(node = '1', false) AS on_node,
  list_filter(apparatus, lambda a: a IN {tuple(rules.APPARATUS)}) AS able, regexp_matches(lower(report), 'unconscious|heart attack') AS grave, regexp_matches(lower(report), 'fender bender') AS light FROM c),
i AS (SELECT *, list_filter([CASE WHEN report = '' THEN 'empty_report:error' END, CASE WHEN kind IS NULL THEN 'missing_emergency_type:error' WHEN NOT kind_ok THEN 'invalid_emergency_type:error' END,
  CASE WHEN urgency IS NULL THEN 'missing_urgency:error' WHEN NOT urgency_ok THEN 'invalid_urgency:error' END, CASE WHEN given AND NOT placed THEN 'invalid_coordinates:error' END, CASE WHEN node IS NOT NULL AND NOT on_node THEN 'unknown_graph_node:warning' END,
  CASE WHEN NOT placed AND NOT on_node THEN 'missing_location:warning' END, CASE WHEN len(apparatus) > len(able) THEN 'invalid_apparatus_type:error' END, CASE WHEN list_contains(hazards, 'dragon') THEN 'invalid_hazard_type:warning' END,
  CASE WHEN grave AND urgency IN ('priority_3_bravo', 'priority_4_alpha') THEN 'contradictory_urgency_under_triage:error' END, CASE WHEN light AND urgency = 'priority_1_echo' THEN 'contradictory_urgency_over_triage:warning' END,
  CASE WHEN kind IN ('cardiac_arrest', 'trauma_major') AND len(able) > 0 AND NOT list_has_any(able, ['ambulance_als', 'ambulance_bls']) THEN 'contradictory_apparatus_mismatch:warning' END], lambda x: x IS NOT NULL) AS issues FROM t),
s AS (SELECT *, CASE WHEN score <> 0 THEN score END AS sure, NOT placed AND NOT on_node AND described IS NOT NULL AS told FROM i)
SELECT event_id, array_to_string(issues, ',') AS issues, CASE WHEN list_contains(issues, 'contradictory_urgency_under_triage:error') THEN 'invalid_contradictory' WHEN len(list_filter(issues, lambda x: x LIKE '%:error')) > 0 THEN 'invalid_insufficient_data' WHEN len(issues) > 0 THEN 'valid_with_warnings' ELSE 'valid' END AS status,
CASE WHEN kind_ok THEN kind END AS emergency_type, CASE WHEN urgency_ok THEN urgency END AS urgency, array_to_string(able, ',') AS required, len(list_filter(hazards, lambda h: h <> 'dragon')) AS hazards,
CASE WHEN placed THEN 'verified_coordinates' WHEN on_node THEN 'network_node_snapped' WHEN told THEN 'caller_description' ELSE 'unknown' END AS provenance,
CASE WHEN placed THEN least(greatest(coalesce(sure, 0.8), 0.5), 1) WHEN on_node THEN least(greatest(coalesce(sure, 0.8), 0.6), 1) WHEN told THEN least(greatest(coalesce(sure, 0.4), 0.2), 0.6) ELSE 0 END::DOUBLE AS confidence,
list_has_any([CASE WHEN kind_ok AND urgency_ok AND (placed OR on_node) AND NOT list_has_any(list_transform(issues, lambda x: split_part(x, ':', 2)), ['error']) THEN 1 ELSE 0 END], [1]) AS operable FROM s""", plain=True)
def judged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with every fault that validation knows, judged; and whether a unit could be routed on each."""
    words = {k: f"{_cases('(' + c + ')', v)} AS {k}" for k, (c, v) in _PARTS.items()}
    lists = lambda column, values, empty: _cases(column, [_array(v) if v else empty for v in values])
    none = "CAST(array() AS array<string>)"
    hazard = f"transform({lists('(event_id + 2 * user_id)', _DETECTED, none)}, h -> named_struct('hazard_type', h, 'description', '', 'severity', CAST(NULL AS STRING), 'location_text', CAST(NULL AS STRING), 'confidence', 0.5D))"
    proposals = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        *words.values(),
        "CASE event_id % 7 WHEN 1 THEN array(-122.3D, 47.5D) WHEN 2 THEN array(-122.3D, 147.5D) END AS suggested_coordinates",
        f"{lists('(user_id + 1)', _SUGGESTED, none)} AS suggested_apparatus",
        f"{hazard} AS hazards_detected",
        "CASE WHEN event_id % 2 = 0 THEN ' behind the mill ' END AS location_text",
        "CAST((event_id % 11) / 10.0 AS DOUBLE) AS confidence_score",
    )
    nodes = spark.range(1).select(F.lit("1").alias("node_id"))
    out = triage.validate_proposals(proposals, nodes)
    told = F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["severity"]))
    return out.select(
        "event_id",
        F.array_join(told, ",").alias("issues"),
        F.col("validation_status").alias("status"),
        "emergency_type",
        "urgency",
        F.array_join("required_apparatus", ",").alias("required"),
        F.size("identified_hazards").cast("long").alias("hazards"),
        F.col("location.provenance").alias("provenance"),
        F.col("location.confidence").alias("confidence"),
        triage.operable_for_routing(out).alias("operable"),
    )


# --- policy

_WISHES = [
    [],
    ["fire_engine"] * 3,
    ["ladder_truck", "hazmat_unit", "ambulance_als", "ambulance_als"],
    ["hazmat_unit", "ambulance_bls"],
    ["battalion_chief", "heavy_rescue", "battalion_chief"],
    ["ambulance_als", "hazmat_unit", "fire_engine", "hazmat_unit", "fire_engine", "ambulance_bls"],
]
_THREATS = [[], ["flash_flood"], ["flood_inundation", "road_collapse", " Flash_Flood"], ["civil_unrest"]]
_ACUTE = tuple(rules.URGENCIES[:2])
_needs = ", ".join(
    f"('{kind}', '{band}', [" + ", ".join(f"struct_pack(a := '{a}', n := {n})" for a, n in base) + f"], {_listed(limits)}, '{rule}')" for kind, band, base, limits, rule in rules.POLICY
)
_raises = ", ".join(f"('{kind}', '{when}', '{to}', {repr(why) if why else 'NULL'})" for kind, (when, to, why) in rules.ESCALATION.items())
_fits = ", ".join(f"('{kind}', {_listed(names)})" for kind, names in rules.COMPATIBLE.items())
_POLICY_SQL = f"""WITH c AS (SELECT event_id, {_cases("event_id", [f"'{k}'" for k in rules.EMERGENCY_TYPES])} AS kind, {_cases("user_id", [f"'{u}'" for u in rules.URGENCIES])} AS urgency, event_id % 7 <> 0 AS valid,
  {_cases("(event_id + user_id)", [_listed(w) if w else "CAST([] AS VARCHAR[])" for w in _WISHES])} AS wishes, {_cases("(event_id + 3 * user_id)", [_listed([t.strip().lower() for t in w]) if w else "CAST([] AS VARCHAR[])" for w in _THREATS])} AS threats FROM events),
raises(kind, whence, raised_to, why) AS (VALUES {_raises}), needs(kind, band, base, limits, rule) AS (VALUES {_needs}), fits(kind, able) AS (VALUES {_fits}),
e AS (SELECT c.*, r.why, CASE WHEN r.whence = 'all' AND c.urgency <> r.raised_to THEN r.raised_to WHEN r.whence = 'routine' AND c.urgency NOT IN {_ACUTE} THEN r.raised_to END AS raised FROM c LEFT JOIN raises r ON r.kind = c.kind),
p AS (SELECT e.*, coalesce(raised, urgency) AS effective, n.base, n.limits, n.rule, f.able, list_transform(n.base, lambda b: b.a) AS names, list_filter(wishes, lambda x, i: list_position(wishes, x) = i) AS asked,
  len(list_filter(threats, lambda t: t IN ('flash_flood', 'flood_inundation'))) AS floods
  FROM e JOIN needs n ON n.kind = e.kind AND n.band IN ('both', CASE WHEN coalesce(e.raised, e.urgency) IN {_ACUTE} THEN 'acute' ELSE 'routine' END) JOIN fits f ON f.kind = e.kind),
q AS (SELECT *, list_transform(base, lambda b: concat(b.a, ':', greatest(b.n, len(list_filter(wishes, lambda w: w = b.a))), ':true')) AS must,
  list_transform(list_filter(asked, lambda a: NOT list_contains(names, a) AND list_contains(able, a)), lambda a: concat(a, ':', len(list_filter(wishes, lambda w: w = a)), ':false')) AS may,
  list_sort(list_distinct(list_concat(limits, CASE WHEN len(threats) > 0 THEN ['{rules.HAZARD_AVOIDING}'] ELSE [] END, CASE WHEN floods > 0 THEN ['{rules.FLOOD_AVOIDING}'] ELSE [] END))) AS ways,
  list_filter(list_concat([CASE WHEN raised IS NOT NULL THEN why END, rule], list_transform(asked, lambda a: CASE WHEN list_contains(names, a) THEN CASE WHEN len(list_filter(wishes, lambda w: w = a)) > list_filter(base, lambda b: b.a = a)[1].n THEN concat('RULE_AUGMENT_QUANTITY_', upper(a)) END
    WHEN list_contains(able, a) THEN concat('RULE_AUGMENT_TYPE_', upper(a)) ELSE concat('RULE_REJECT_INCOMPATIBLE_', upper(a)) END), [CASE WHEN len(threats) > 0 THEN 'RULE_ENFORCE_HAZARD_AVOIDANCE' END], list_transform(range(floods), lambda i: 'RULE_ENFORCE_FLOOD_ZONE_BYPASS')), lambda r: r IS NOT NULL) AS told FROM p)
SELECT event_id, valid AS is_dispatchable, CASE WHEN valid THEN effective ELSE urgency END AS effective_urgency, CASE WHEN valid THEN array_to_string(list_concat(list_sort(must), list_sort(may)), ',') ELSE '' END AS required,
CASE WHEN valid THEN array_to_string(ways, ',') ELSE '' END AS routing_constraints, CASE WHEN NOT valid THEN 'travel_time' WHEN list_contains(ways, '{rules.SIREN}') THEN 'emergency_time' WHEN effective = '{rules.URGENCIES[2]}' THEN 'travel_time' ELSE 'distance' END AS weighting_profile,
CASE WHEN NOT valid THEN 'balanced_travel' WHEN list_contains(ways, '{rules.SIREN}') THEN CASE WHEN kind IN {tuple(rules.SAFETY_FIRST)} THEN 'maximize_crew_safety' ELSE 'minimize_response_time' END WHEN effective = '{rules.URGENCIES[2]}' THEN 'balanced_travel' ELSE 'minimize_distance' END AS routing_objective,
CASE WHEN valid AND len(threats) > 0 THEN 'moderate' END AS threshold, CASE WHEN valid THEN array_to_string(told, ',') ELSE 'POLICY_REJECT_INVALID_CONTRACT' END AS policy_rules,
CASE WHEN NOT valid THEN 'missing_location,empty_report' ELSE array_to_string(list_transform(list_filter(asked, lambda a: NOT list_contains(names, a) AND NOT list_contains(able, a)), lambda a: concat('incompatible_', a)), ',') END AS policy_warnings FROM q"""


@query(_POLICY_SQL, plain=True)
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy for a contract of each event: every type at every urgency, with suggestions and hazards of all kinds."""
    none = "CAST(array() AS array<string>)"
    threats = _cases("(event_id + 3 * user_id)", [_array(w) if w else none for w in _THREATS])
    contracts = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        _cases("event_id", [f"'{k}'" for k in rules.EMERGENCY_TYPES]) + " AS emergency_type",
        _cases("user_id", [f"'{u}'" for u in rules.URGENCIES]) + " AS urgency",
        _cases("(event_id + user_id)", [_array(w) if w else none for w in _WISHES]) + " AS required_apparatus",
        f"transform({threats}, h -> named_struct('hazard_type', h)) AS identified_hazards",
        "array(named_struct('code', 'missing_location', 'field', 'location', 'severity', 'warning'), named_struct('code', 'empty_report', 'field', 'raw_report', 'severity', 'error')) AS issues",
        "CASE WHEN event_id % 7 = 0 THEN 'invalid_insufficient_data' WHEN event_id % 2 = 0 THEN 'valid' ELSE 'valid_with_warnings' END AS validation_status",
    )
    out = triage.apply_policy(contracts)
    needs = F.transform("required", lambda r: F.concat_ws(":", r["apparatus_type"], r["quantity"].cast("string"), r["is_mandatory"].cast("string")))
    joined = [F.array_join(c, ",").alias(c) for c in ("routing_constraints", "policy_rules", "policy_warnings")]
    threshold = F.col("hazard_avoidance_threshold").alias("threshold")
    return out.select("event_id", "is_dispatchable", "effective_urgency", F.array_join(needs, ",").alias("required"), "weighting_profile", "routing_objective", threshold, *joined)
