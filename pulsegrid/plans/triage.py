"""Call text to dispatch: reading, validation, policy and allocation as one chain of projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import text as words
from pulsegrid.functions.geo import valid_wgs84
from pulsegrid.plans import rules

STRINGS = "array<string>"
PROPOSAL = """emergency_type string, urgency string, location_text string, suggested_coordinates array<double>, suggested_node_id string,
suggested_apparatus array<string>, hazards_detected array<struct<hazard_type:string,description:string,severity:string,location_text:string,confidence:double>>,
reported_symptoms array<string>, reported_circumstances array<string>, confidence_score double, uncertainty_notes array<string>, clarification_questions array<string>"""
HAZARD = "array<struct<hazard_type:string,description:string,severity:string,location_text:string,confidence:double>>"


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast(STRINGS) if values else F.array().cast(STRINGS)


def _rule_table(table: list) -> Column:
    return F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("type"), F.lit(u).alias("urgency"), _list(a).alias("apparatus"), F.lit(c).alias("confidence"), F.lit(h and h[0]).cast("string").alias("hazard"), F.lit(h and h[1]).cast("string").alias("severity"), _list(s).alias("symptoms"), _list(r).alias("circumstances"))
        for p, t, u, a, c, h, s, r in table
    ])


def classify_reports(reports: DataFrame, table: list = rules.REPORT_RULES) -> DataFrame:
    """``reports`` (request_id, raw_text) with a proposal of what happened, by the first rule in the table that matches.

    Several types matched: the gravest of them, as an echo, at 0.6. Words of harmlessness beside critical ones: an
    echo at 0.45. No rule: refused unless emergency words occur, else a general call at 0.3. Without a location a
    rule's confidence falls by 0.25, to 0.2 at least. Text that is too short or too long is refused with a code.
    """
    clean = reports.withColumn("report", words.sanitize(F.col("raw_text"))).withColumn("error_code", words.sanitize_error(F.col("report")))
    low = F.lower("report")
    hits = F.filter(F.array(*[F.when(low.rlike(r[0]), F.lit(k)) for k, r in enumerate(table)]), lambda k: k.isNotNull())
    seen = clean.withColumn("hits", F.when(F.col("error_code").isNull(), hits)).withColumn("rule", F.try_element_at(_rule_table(table), F.try_element_at("hits", F.lit(1)) + 1))
    names = _list([r[1] for r in table])
    types = F.array_distinct(F.transform("hits", lambda k: F.element_at(names, k + 1)))
    many = F.size(types) > 1
    doubtful = low.rlike(rules.BENIGN) & low.rlike(rules.CRITICAL)
    rank = lambda t: F.array_position(_list(rules.TYPE_PRIORITY), t)
    gravest = F.array_min(F.transform(types, lambda t: F.struct(rank(t).alias("r"), t.alias("t"))))["t"]
    domain = low.rlike(r"\b(" + "|".join(rules.DOMAIN_WORDS) + r")\b")
    bad, unruled = F.col("error_code").isNotNull(), F.col("rule").isNull()
    kind = F.when(bad, "refused").when(many, "multiple").when(doubtful, "contradictory").when(~unruled, "matched").when(domain, "general").otherwise("unsupported")
    seen = seen.withColumn("types", types).withColumn("outcome", kind).withColumn("location_text", words.extract_location(F.col("report"))).withColumn("adversarial_flags", words.adversarial_flags(F.col("report")))
    outcome, placed = F.col("outcome"), F.col("location_text").isNotNull()
    matched = outcome == "matched"
    flags = F.col("adversarial_flags")
    noted = lambda condition, note: F.when(condition, note)
    notes = F.filter(F.array(
        noted(outcome == "multiple", F.concat(F.lit("multiple_simultaneous_incidents_detected: "), F.array_join("types", ", "))), noted(outcome == "multiple", F.lit("requires_incident_command_triage")),
        noted(outcome == "contradictory", F.lit("contradictory_caller_statements")), noted(outcome == "contradictory", F.lit("fail_safe_escalated_to_priority_1")),
        noted(outcome == "general", F.lit("unrecognized_specific_taxonomy")), noted((outcome == "general") & ~placed, F.lit("missing_location")),
        noted(matched & ~placed, F.lit("location_unspecified_in_report")), noted(matched & (F.size(flags) > 0), F.concat(F.lit("adversarial_instruction_attempts_detected: "), F.array_join(flags, ", "))),
    ), lambda n: n.isNotNull())
    first_type = F.try_element_at("types", F.lit(1))
    score = F.col("rule.confidence")
    hazard = F.struct(F.col("rule.hazard").alias("hazard_type"), F.lit("").alias("description"), F.col("rule.severity").alias("severity"), F.lit(None).cast("string").alias("location_text"), F.lit(0.5).alias("confidence"))
    none = F.array().cast(STRINGS)
    return seen.select(
        *[c for c in reports.columns],
        "report", "outcome", F.when(outcome == "unsupported", "unsupported_incident_type").otherwise(F.col("error_code")).alias("error_code"), "adversarial_flags", "types",
        F.when(outcome == "multiple", gravest).when(outcome == "contradictory", F.coalesce(first_type, F.lit("medical_general"))).when(outcome == "general", "medical_general").when(matched, F.col("rule.type")).alias("emergency_type"),
        F.when(outcome.isin("multiple", "contradictory"), "priority_1_echo").when(outcome == "general", "priority_3_bravo").when(matched, F.col("rule.urgency")).alias("urgency"),
        F.when(~outcome.isin("refused", "unsupported"), F.col("location_text")).alias("location_text"),
        F.when(matched, F.col("rule.apparatus")).otherwise(none).alias("suggested_apparatus"),
        F.when(matched & F.col("rule.hazard").isNotNull(), F.array(hazard)).otherwise(F.array()).cast(HAZARD).alias("hazards_detected"),
        F.when(matched, F.col("rule.symptoms")).otherwise(none).alias("reported_symptoms"), F.when(matched, F.col("rule.circumstances")).otherwise(none).alias("reported_circumstances"),
        F.when(outcome == "multiple", 0.6).when(outcome == "contradictory", 0.45).when(outcome == "general", 0.3).when(matched, F.when(placed, score).otherwise(F.greatest(F.lit(0.2), score - 0.25))).alias("confidence_score"),
        F.coalesce(notes, none).alias("uncertainty_notes"),
        (outcome.isin("multiple", "contradictory", "general", "unsupported") | (matched & ~placed)).alias("clarification_needed"),
    )


def parse_proposals(outputs: DataFrame, text_col: str = "output") -> DataFrame:
    """``outputs`` with a typed ``proposal`` read from a model's JSON answer, or an ``error_code``.

    A type or urgency outside its domain is an error; unknown apparatus and hazards are left out; confidences are
    brought into [0, 1].
    """
    read = outputs.withColumn("_x", words.extract_json(F.col(text_col))).withColumn("_p", F.from_json("_x.json", PROPOSAL)).withColumn("_valid", F.try_parse_json("_x.json").isNotNull())
    p, clean = F.col("_p"), lambda c: F.lower(F.trim(c))
    wrong = F.when(F.col("_x.error").isNotNull(), F.col("_x.error")).when(~F.col("_valid"), "malformed_json")
    wrong = wrong.when(p["emergency_type"].isNotNull() & ~clean(p["emergency_type"]).isin(rules.EMERGENCY_TYPES), "invalid_emergency_type").when(p["urgency"].isNotNull() & ~clean(p["urgency"]).isin(rules.URGENCIES), "invalid_urgency")
    unit = lambda c, other: F.least(F.greatest(F.coalesce(c, F.lit(other)), F.lit(0.0)), F.lit(1.0))
    hazards = F.transform(F.filter(p["hazards_detected"], lambda h: clean(h["hazard_type"]).isin(rules.HAZARDS)), lambda h: F.struct(clean(h["hazard_type"]).alias("hazard_type"), F.coalesce(h["description"], F.lit("")).alias("description"), F.when(clean(h["severity"]).isin(rules.SEVERITIES), clean(h["severity"])).alias("severity"), h["location_text"].alias("location_text"), unit(h["confidence"], 0.5).alias("confidence")))
    none = F.array().cast(STRINGS)
    fields = F.struct(
        clean(p["emergency_type"]).alias("emergency_type"), clean(p["urgency"]).alias("urgency"), p["location_text"].alias("location_text"), p["suggested_coordinates"].alias("suggested_coordinates"), p["suggested_node_id"].alias("suggested_node_id"),
        F.coalesce(F.transform(F.filter(p["suggested_apparatus"], lambda a: clean(a).isin(rules.APPARATUS)), clean), none).alias("suggested_apparatus"), F.coalesce(hazards, F.array().cast(HAZARD)).alias("hazards_detected"),
        F.coalesce(p["reported_symptoms"], none).alias("reported_symptoms"), F.coalesce(p["reported_circumstances"], none).alias("reported_circumstances"), unit(p["confidence_score"], 0.5).alias("confidence_score"), F.coalesce(p["uncertainty_notes"], none).alias("uncertainty_notes"), F.coalesce(p["clarification_questions"], none).alias("clarification_questions"),
    )
    return read.withColumn("error_code", wrong).withColumn("proposal", F.when(F.col("error_code").isNull(), fields)).drop("_x", "_p", "_valid")


def validate_proposals(proposals: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``proposals`` (one row each, in columns named as in PROPOSAL, plus report) judged: issues, status, location.

    Issues carry code, field and severity. Status: contradictory before insufficient before warnings before valid.
    ``nodes`` (node_id), if given, is what suggested nodes are looked up in.
    """
    p = proposals
    if "suggested_coordinates" not in p.columns:
        p = p.withColumn("suggested_coordinates", F.lit(None).cast("array<double>"))
    if "suggested_node_id" not in p.columns:
        p = p.withColumn("suggested_node_id", F.lit(None).cast("string"))
    p = p.withColumn("_node", F.trim("suggested_node_id"))
    if nodes is not None:
        p = p.join(nodes.select(F.col("node_id").alias("_node")).distinct().withColumn("_known", F.lit(True)), "_node", "left")
    else:
        p = p.withColumn("_known", F.lit(True))
    report = F.coalesce(F.trim("report"), F.lit(""))
    clean = lambda c: F.lower(F.trim(c))
    kind, urgency = clean(F.col("emergency_type")), clean(F.col("urgency"))
    kind_ok, urgency_ok = kind.isin(rules.EMERGENCY_TYPES), urgency.isin(rules.URGENCIES)
    lon, lat = F.try_element_at("suggested_coordinates", F.lit(1)), F.try_element_at("suggested_coordinates", F.lit(2))
    given = F.col("suggested_coordinates").isNotNull()
    placed = given & F.coalesce(valid_wgs84(lon, lat), F.lit(False))
    on_node = F.col("_node").isNotNull() & F.coalesce("_known", F.lit(False))
    apparatus = F.transform(F.coalesce("suggested_apparatus", F.array().cast(STRINGS)), clean)
    good_apparatus = F.filter(apparatus, lambda a: a.isin(rules.APPARATUS))
    hazards = F.coalesce("hazards_detected", F.array().cast(HAZARD))
    bad_hazards = F.filter(hazards, lambda h: ~clean(h["hazard_type"]).isin(rules.HAZARDS))
    low = F.lower(report)
    anywhere = lambda patterns: F.greatest(*[low.rlike(x) for x in patterns])
    unmoved = kind.isin("cardiac_arrest", "trauma_major") & (F.size(good_apparatus) > 0) & ~F.arrays_overlap(good_apparatus, _list(["ambulance_als", "ambulance_bls"]))
    issue = lambda when, code, field, severity: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))
    issues = F.filter(F.array(
        issue(report == "", "empty_report", "raw_report", "error"),
        issue(F.col("emergency_type").isNull(), "missing_emergency_type", "emergency_type", "error"), issue(~kind_ok, "invalid_emergency_type", "emergency_type", "error"),
        issue(F.col("urgency").isNull(), "missing_urgency", "urgency", "error"), issue(~urgency_ok, "invalid_urgency", "urgency", "error"),
        issue(given & ~placed, "invalid_coordinates", "suggested_coordinates", "error"),
        issue(F.col("_node").isNotNull() & ~on_node, "unknown_graph_node", "suggested_node_id", "warning"),
        issue(~placed & ~on_node, "missing_location", "location", "warning"),
        issue(F.size(apparatus) > F.size(good_apparatus), "invalid_apparatus_type", "suggested_apparatus", "error"),
        issue(F.size(bad_hazards) > 0, "invalid_hazard_type", "hazards_detected", "warning"),
        issue(anywhere(rules.LIFE_THREATS) & urgency.isin(rules.URGENCIES[2:]), "contradictory_urgency_under_triage", "urgency", "error"),
        issue(anywhere(rules.NON_EMERGENCIES) & (urgency == rules.URGENCIES[0]), "contradictory_urgency_over_triage", "urgency", "warning"),
        issue(unmoved, "contradictory_apparatus_mismatch", "required_apparatus", "warning"),
    ), lambda x: x.isNotNull())
    out = p.withColumn("issues", issues)
    codes, levels = F.transform("issues", lambda x: x["code"]), F.transform("issues", lambda x: x["severity"])
    status = F.when(F.array_contains(codes, "contradictory_urgency_under_triage"), "invalid_contradictory").when(F.array_contains(levels, "error"), "invalid_insufficient_data").when(F.array_contains(levels, "warning"), "valid_with_warnings").otherwise("valid")
    score, described = F.col("confidence_score"), F.length(F.trim("location_text")) > 0
    sure = lambda low_, high, other: F.least(F.greatest(F.when(score != 0, score).otherwise(F.lit(other)), F.lit(low_)), F.lit(high))
    only_text = ~placed & ~on_node & F.coalesce(described, F.lit(False))
    location = F.struct(
        F.when(placed, lon).alias("lon"), F.when(placed, lat).alias("lat"), F.when(on_node, F.col("_node")).alias("node_id"), F.trim("location_text").alias("raw_text"),
        F.when(placed, "verified_coordinates").when(on_node, "network_node_snapped").when(only_text, "caller_description").otherwise("unknown").alias("provenance"),
        F.when(placed, sure(0.5, 1.0, 0.8)).when(on_node, sure(0.6, 1.0, 0.8)).when(only_text, sure(0.2, 0.6, 0.4)).otherwise(0.0).alias("confidence"), (placed | on_node).alias("is_verified"),
    )
    return out.select(
        *[c for c in proposals.columns if c not in ("emergency_type", "urgency", "suggested_apparatus", "hazards_detected")],
        F.when(kind_ok, kind).alias("emergency_type"), F.when(urgency_ok, urgency).alias("urgency"), location.alias("location"), good_apparatus.alias("required_apparatus"),
        F.filter(hazards, lambda h: clean(h["hazard_type"]).isin(rules.HAZARDS)).alias("identified_hazards"), "issues", status.alias("validation_status"),
    )


def is_valid(status: Column) -> Column:
    return status.isin("valid", "valid_with_warnings")


def operable_for_routing(contracts: DataFrame) -> Column:
    """Valid, with a type, an urgency and coordinates or a node."""
    return is_valid(F.col("validation_status")) & (F.col("location.lon").isNotNull() | F.col("location.node_id").isNotNull()) & F.col("emergency_type").isNotNull() & F.col("urgency").isNotNull()


NEEDS = "array<struct<apparatus_type:string,quantity:int>>"
REQUIRED = "array<struct<apparatus_type:string,quantity:int,is_mandatory:boolean,source:string>>"


def _policy_table(spark: SparkSession) -> DataFrame:
    """What the policy says of each type at each urgency: one row for each pair of the two lists in ``rules``."""
    rows = []
    for kind in rules.EMERGENCY_TYPES:
        when, to, why = rules.ESCALATION.get(kind, (None, None, None))
        for given in rules.URGENCIES:
            acute = given in rules.URGENCIES[:2]
            raised = given != to if when == "all" else when == "routine" and not acute
            band = "acute" if raised or acute else "routine"
            base, constraints, rule = next(r[2:] for r in rules.POLICY if r[0] == kind and r[1] in ("both", band))
            needs = [F.struct(F.lit(x).alias("apparatus_type"), F.lit(n).alias("quantity")) for x, n in base]
            row = {
                "_type": F.lit(kind),
                "_given": F.lit(given),
                "_to": F.lit(to if raised else None).cast("string"),
                "_raised": F.lit(why if raised else None).cast("string"),
                "_base": F.array(*needs).cast(NEEDS),
                "_constraints": _list(constraints),
                "_rule": F.lit(rule),
                "_allowed": _list(rules.COMPATIBLE[kind]),
            }
            rows.append(F.struct(*[value.alias(name) for name, value in row.items()]))
    return spark.range(1).select(F.inline(F.array(*rows)))


def apply_policy(contracts: DataFrame, augment: bool = True) -> DataFrame:
    """``contracts`` with effective urgency, apparatus (with quantity, is_mandatory, source), constraints, profile, objective, rules and warnings.

    Contracts that are not valid are not dispatchable and get nothing. Suggestions raise quantities or add compatible
    types as optional; incompatible ones are refused with a warning. The policy is joined as a table of one row for
    each type and urgency, so it is broadcast whatever the contracts.
    """
    kind, given = F.col("emergency_type"), F.col("urgency")
    valid = F.col("is_dispatchable")
    has_type = kind.isNotNull() & given.isNotNull()
    known = F.when(given.isin(rules.URGENCIES), given).otherwise(rules.URGENCIES[-1])
    p = contracts.withColumn("is_dispatchable", is_valid(F.col("validation_status")) & has_type)
    table = F.broadcast(_policy_table(contracts.sparkSession))
    p = p.join(table, valid & (kind == F.col("_type")) & (known == F.col("_given")), "left")
    effective = F.when(valid, F.coalesce("_to", given)).otherwise(F.coalesce(given, F.lit(rules.URGENCIES[-1])))

    # how often each type is suggested, beside what the policy asks for
    suggested = F.col("required_apparatus") if augment else F.array().cast(STRINGS)
    base = F.coalesce("_base", F.array().cast(NEEDS))
    times = lambda a: F.size(F.filter(F.col("_suggested"), lambda s: s == a))
    p = p.withColumn("effective_urgency", effective).withColumn("_suggested", suggested)
    counted = F.transform(base, lambda b: F.struct(b.alias("b"), times(b["apparatus_type"]).alias("n")))
    based = F.transform(base, lambda b: b["apparatus_type"])
    p = p.withColumn("_counted", counted).withColumn("_extra", F.array_distinct(F.array_except("_suggested", based)))
    allowed = F.filter(F.col("_extra"), lambda a: F.array_contains("_allowed", a))
    refused = F.filter(F.col("_extra"), lambda a: ~F.array_contains("_allowed", a))

    def need(apparatus: Column, quantity: Column, mandatory: bool, source: Column) -> Column:
        return F.struct(
            apparatus.alias("apparatus_type"),
            quantity.alias("quantity"),
            F.lit(mandatory).alias("is_mandatory"),
            source.alias("source"),
        )

    def by_policy(c: Column) -> Column:
        least = c["b"]["quantity"]
        source = F.when(c["n"] > least, "model_augmented").otherwise("statutory_policy")
        return need(c["b"]["apparatus_type"], F.greatest(least, c["n"]), True, source)

    optional = F.transform(allowed, lambda a: need(a, times(a), False, F.lit("model_augmented")))
    p = p.withColumn("_needs", F.concat(F.transform("_counted", by_policy), optional))
    p = p.withColumn("_refused", F.when(valid, refused).otherwise(_list([])))

    # mandatory apparatus first, then by name
    keyed = F.transform("_needs", lambda r: F.struct((~r["is_mandatory"]).alias("a"), r["apparatus_type"].alias("b"), r.alias("r")))
    required = F.when(valid, F.transform(F.array_sort(keyed), lambda k: k["r"])).otherwise(F.array().cast(REQUIRED))
    flood_types = ["flash_flood", "flood_inundation"]
    floods = F.size(F.filter("identified_hazards", lambda h: F.lower(F.trim(h["hazard_type"])).isin(flood_types)))
    p = p.withColumn("required", required).withColumn("_floods", floods)
    any_hazard = F.size("identified_hazards") > 0
    constraints = F.concat(
        F.coalesce("_constraints", F.array().cast(STRINGS)),
        F.when(any_hazard, _list([rules.HAZARD_AVOIDING])).otherwise(_list([])),
        F.when(F.col("_floods") > 0, _list([rules.FLOOD_AVOIDING])).otherwise(_list([])),
    )
    constraints = F.array_sort(F.array_distinct(constraints))
    p = p.withColumn("routing_constraints", F.when(valid, constraints).otherwise(_list([])))

    siren = F.array_contains("routing_constraints", rules.SIREN)
    bravo = F.col("effective_urgency") == rules.URGENCIES[2]
    profile = F.when(~valid, "travel_time").when(siren, "emergency_time").when(bravo, "travel_time").otherwise("distance")
    objective = (
        F.when(~valid, "balanced_travel")
        .when(siren & kind.isin(rules.SAFETY_FIRST), "maximize_crew_safety")
        .when(siren, "minimize_response_time")
        .when(bravo, "balanced_travel")
        .otherwise("minimize_distance")
    )

    def told(a: Column) -> Column:
        """The rule that a suggested type calls for, if any."""
        least = F.try_element_at(F.filter(base, lambda b: b["apparatus_type"] == a), F.lit(1))["quantity"]
        code = F.when(least.isNotNull(), F.when(times(a) > least, "RULE_AUGMENT_QUANTITY_"))
        code = code.when(F.array_contains("_allowed", a), "RULE_AUGMENT_TYPE_").otherwise("RULE_REJECT_INCOMPATIBLE_")
        return F.concat(code, F.upper(a))

    # types in the order in which they were first suggested, then a rule for each flood
    applied = F.concat(
        F.array("_raised", "_rule"),
        F.transform(F.array_distinct("_suggested"), told),
        F.array(F.when(any_hazard, "RULE_ENFORCE_HAZARD_AVOIDANCE")),
        F.array_repeat(F.lit("RULE_ENFORCE_FLOOD_ZONE_BYPASS"), F.col("_floods")),
    )
    applied = F.filter(applied, lambda r: r.isNotNull())
    issues = F.transform("issues", lambda i: i["code"])
    refusals = F.transform("_refused", lambda a: F.concat(F.lit("incompatible_"), a))
    return p.select(
        *contracts.columns,
        "is_dispatchable",
        "effective_urgency",
        "required",
        "routing_constraints",
        profile.alias("weighting_profile"),
        objective.alias("routing_objective"),
        F.when(valid & any_hazard, "moderate").alias("hazard_avoidance_threshold"),
        F.when(valid, applied).otherwise(_list(["POLICY_REJECT_INVALID_CONTRACT"])).alias("policy_rules"),
        F.when(~valid, issues).otherwise(refusals).alias("policy_warnings"),
    )


def directives(reports: DataFrame, nodes: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Reports through reading, validation and policy; ``overrides`` (request_id, node_id, lon, lat) place them.

    Overriding coordinates count only if they are finite and in range.
    """
    read = classify_reports(reports)
    if overrides is not None:
        read = read.join(overrides.select("request_id", F.col("node_id").alias("suggested_node_id"), F.when(valid_wgs84(F.col("lon"), F.col("lat")), F.array("lon", "lat")).alias("suggested_coordinates")), "request_id", "left")
    return apply_policy(validate_proposals(read, nodes))


def triage_pipeline(reports: DataFrame, overrides: DataFrame, nodes: DataFrame, units: DataFrame, edges: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One row per report: status dispatch_optimized, staged, validation_failed or interpretation_failed, with the assignments."""
    from pulsegrid.operators.dispatch import allocate

    judged = directives(reports, nodes, overrides)
    ready = judged.where(F.col("is_dispatchable") & F.col("location.node_id").isNotNull())
    needs = F.flatten(F.transform("required", lambda r: F.array_repeat(r["apparatus_type"], r["quantity"])))
    incidents = ready.select(F.col("request_id").alias("incident_id"), F.col("location.node_id").alias("node_id"), needs.alias("required_apparatus"))
    given = allocate(edges, incidents, units, blocks)
    packed = given.groupBy(F.col("incident_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("req_ordinal", "required_type", "unit_id", "eta_s"))).alias("assignments"), F.bool_or("fulfilled").alias("_any"))
    out = judged.join(packed, "request_id", "left")
    status = F.when(F.col("outcome").isin("refused", "unsupported"), "interpretation_failed").when(~F.col("is_dispatchable"), "validation_failed").when(F.coalesce("_any", F.lit(False)), "dispatch_optimized").otherwise("staged")
    return out.withColumn("status", status).drop("_any")


def audit_digest(log: DataFrame) -> DataFrame:
    """(request_id, digest): SHA-256 of each request's stage lines (seq, line) in order, joined by line breaks."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    return log.groupBy("request_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
