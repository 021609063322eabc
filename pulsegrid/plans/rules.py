"""Triage and policy rules as data. All tables here are fixed values; callers may pass their own."""

from __future__ import annotations

# Report rules in order: pattern, type, urgency, apparatus, confidence, hazard (type, severity), symptoms, circumstances.
REPORT_RULES = [
    (r"\b(crash|crashed|collided|collision|car\s+accident|hit\s+a\s+barrier|rollover|vehicle\s+wreck)\b", "road_traffic_collision", "priority_1_echo", ["fire_engine", "heavy_rescue", "ambulance_als"], 0.92, ("structural_debris", "moderate"), ["possible_trauma", "potential_loss_of_consciousness"], ["vehicle_impact", "entrapment_risk"]),
    (r"\b(cardiac\s+arrest|heart\s+attack|chest\s+pain|collapsed|not\s+breathing|no\s+pulse)\b", "cardiac_arrest", "priority_1_echo", ["ambulance_als", "fire_engine"], 0.95, None, ["chest_pain", "unresponsive", "absence_of_pulse"], ["acute_medical_collapse"]),
    (r"\b(building\s+on\s+fire|structure\s+fire|apartment\s+burning|flames\s+from\s+roof|house\s+fire)\b", "structure_fire", "priority_1_echo", ["fire_engine", "ladder_truck", "heavy_rescue", "battalion_chief"], 0.94, ("toxic_gas_plume", "severe"), ["smoke_inhalation_risk", "burn_injury_risk"], ["structural_combustion", "thermal_exposure"]),
    (r"\b(brush\s+fire|wildfire|forest\s+fire|grass\s+fire|vegetation\s+fire)\b", "wildland_fire", "priority_1_echo", ["fire_engine", "battalion_chief"], 0.91, ("wildfire_perimeter", "critical_blocked"), ["respiratory_distress"], ["wildland_combustion", "rapid_perimeter_expansion"]),
    (r"\b(chemical\s+spill|hazmat|toxic\s+leak|chlorine\s+gas|acid\s+spill|chemical\s+plume)\b", "hazmat_spill", "priority_2_delta", ["hazmat_unit", "fire_engine", "ambulance_als"], 0.90, ("toxic_gas_plume", "severe"), ["chemical_burns", "dyspnea", "eye_irritation"], ["toxic_vapor_release", "environmental_contamination"]),
    (r"\b(flash\s+flood|rising\s+water|submerged\s+car|river\s+overflow|trapped\s+by\s+water)\b", "flash_flood", "priority_1_echo", ["heavy_rescue", "fire_engine", "ambulance_als"], 0.93, ("flash_flood", "critical_blocked"), ["hypothermia_risk", "submersion_drowning_risk"], ["rapid_water_inundation", "swift_current"]),
    (r"\b(building\s+collapse|roof\s+cave-in|collapsed\s+structure|buried\s+under\s+rubble)\b", "structural_collapse", "priority_1_echo", ["heavy_rescue", "ladder_truck", "fire_engine", "ambulance_als"], 0.92, ("structural_debris", "critical_blocked"), ["crush_injury", "asphyxiation_risk"], ["mass_structural_failure", "confined_space_rubble"]),
    (r"\b(gunshot|stabbing|severe\s+hemorrhage|fall\s+from\s+height|amputation)\b", "trauma_major", "priority_1_echo", ["ambulance_als", "fire_engine"], 0.94, None, ["severe_hemorrhage", "hypovolemic_shock_risk"], ["penetrating_blunt_trauma"]),
    (r"\b(fever|mild\s+nausea|sprained\s+ankle|minor\s+cut|dizziness)\b", "medical_general", "priority_3_bravo", ["ambulance_bls"], 0.85, None, ["mild_discomfort", "stable_vitals"], ["non_life_threatening_medical"]),
]
TYPE_PRIORITY = ["cardiac_arrest", "trauma_major", "structural_collapse", "structure_fire", "hazmat_spill", "flash_flood", "road_traffic_collision", "wildland_fire", "medical_general"]
BENIGN = r"\b(no\s+injur\w*|nobody\s+(is\s+)?hurt|every(one|thing)\s+(is\s+)?fine|minor|not\s+an\s+emergency)\b"
CRITICAL = r"\b(unconscious|unresponsive|cardiac|not\s+breathing|trapped|bleeding\s+heavily)\b"
DOMAIN_WORDS = ["help", "emergency", "fire", "smoke", "crash", "accident", "patient", "hurt", "injured", "pain", "bleeding", "collapse", "water", "flood", "chemical", "trapped", "danger", "hazard", "victim", "unconscious", "hospital", "ambulance"]
LIFE_THREATS = [
    r"\b(unconscious|unresponsive)\b",
    r"\b(cardiac\s+arrest|heart\s+attack|no\s+pulse|pulseless)\b",
    r"\b(not\s+breathing|stopped\s+breathing|respiratory\s+arrest)\b",
    r"\b(severe\s+bleeding|bleeding\s+heavily|arterial\s+bleed|hemorrhag\w*)\b",
    r"\b(trapped\s+in\s+fire|building\s+collapse|crushed)\b",
    r"\b(gunshot|stabbing|penetrating\s+wound)\b",
]
NON_EMERGENCIES = [r"\b(minor\s+scratch|fender\s+bender|no\s+injur\w*|non[\s-]emergency)\b", r"\b(routine\s+transfer|cold\s+symptoms|minor\s+cut)\b"]

EMERGENCY_TYPES = ["structure_fire", "wildland_fire", "cardiac_arrest", "trauma_major", "hazmat_spill", "flash_flood", "structural_collapse", "road_traffic_collision", "medical_general"]
URGENCIES = ["priority_1_echo", "priority_2_delta", "priority_3_bravo", "priority_4_alpha"]
APPARATUS = ["ambulance_als", "ambulance_bls", "fire_engine", "ladder_truck", "heavy_rescue", "hazmat_unit", "battalion_chief"]
HAZARDS = ["flood_inundation", "flash_flood", "wildfire_perimeter", "toxic_gas_plume", "structural_debris", "road_collapse", "civil_unrest"]
SEVERITIES = ["low", "moderate", "severe", "critical_blocked"]

# Policy by type and band (acute: echo or delta; routine: the rest): baseline (apparatus, quantity), constraints, rule.
# ``urgency`` is what the type is raised to, from any other ("all") or from routine ones only ("routine"), with the rule that says so.
SIREN, HAZARD_AVOIDING, FLOOD_AVOIDING, TUNNEL_AVOIDING, CIVILIAN = "emergency_siren_privilege", "avoid_active_hazards", "avoid_flood_zones", "avoid_bridges_tunnels", "standard_civilian_speeds"
POLICY = [
    ("structure_fire", "both", [("fire_engine", 2), ("ladder_truck", 1), ("battalion_chief", 1), ("ambulance_als", 1)], [SIREN, HAZARD_AVOIDING], "RULE_FIRE_STRUCTURE_FULL_ALARM"),
    ("wildland_fire", "both", [("fire_engine", 2), ("battalion_chief", 1)], [SIREN, HAZARD_AVOIDING], "RULE_WILDLAND_FIRE_ASSIGNMENT"),
    ("cardiac_arrest", "both", [("ambulance_als", 1), ("fire_engine", 1)], [SIREN], "RULE_CARDIAC_DUAL_RESPONSE_MANDATE"),
    ("trauma_major", "both", [("ambulance_als", 1)], [SIREN], "RULE_TRAUMA_ALS_RAPID_DISPATCH"),
    ("hazmat_spill", "both", [("hazmat_unit", 1), ("fire_engine", 1), ("ambulance_als", 1)], [SIREN, HAZARD_AVOIDING, TUNNEL_AVOIDING], "RULE_HAZMAT_CONTAINMENT_AND_TUNNEL_BAN"),
    ("flash_flood", "both", [("heavy_rescue", 1), ("fire_engine", 1), ("ambulance_als", 1)], [SIREN, HAZARD_AVOIDING, FLOOD_AVOIDING], "RULE_SWIFT_WATER_RESCUE_FLOOD_AVOIDANCE"),
    ("structural_collapse", "both", [("heavy_rescue", 1), ("ladder_truck", 1), ("fire_engine", 1), ("ambulance_als", 1)], [SIREN, HAZARD_AVOIDING], "RULE_COLLAPSE_USAR_RESPONSE"),
    ("road_traffic_collision", "acute", [("fire_engine", 1), ("ambulance_als", 1)], [SIREN], "RULE_MVA_EXTRICATION_RESPONSE"),
    ("road_traffic_collision", "routine", [("ambulance_bls", 1)], [CIVILIAN], "RULE_MVA_MINOR_EVALUATION"),
    ("medical_general", "acute", [("ambulance_als", 1)], [SIREN], "RULE_MEDICAL_ACUTE_ALS"),
    ("medical_general", "routine", [("ambulance_bls", 1)], [CIVILIAN], "RULE_MEDICAL_ROUTINE_BLS"),
]
ESCALATION = {
    "structure_fire": ("all", "priority_1_echo", "RULE_FIRE_URGENCY_ESCALATION"),
    "wildland_fire": ("routine", "priority_1_echo", "RULE_WILDLAND_URGENCY_ESCALATION"),
    "cardiac_arrest": ("all", "priority_1_echo", None),
    "trauma_major": ("all", "priority_1_echo", None),
    "hazmat_spill": ("routine", "priority_2_delta", "RULE_HAZMAT_URGENCY_DEFAULT"),
    "flash_flood": ("all", "priority_1_echo", None),
    "structural_collapse": ("all", "priority_1_echo", None),
}
_FIRE = ["fire_engine", "ladder_truck", "heavy_rescue", "battalion_chief", "ambulance_als", "ambulance_bls"]
_MEDICAL = ["ambulance_als", "ambulance_bls", "fire_engine", "heavy_rescue"]
COMPATIBLE = {
    "structure_fire": _FIRE,
    "wildland_fire": _FIRE,
    "structural_collapse": _FIRE,
    "cardiac_arrest": _MEDICAL,
    "trauma_major": _MEDICAL,
    "medical_general": _MEDICAL,
    "road_traffic_collision": _MEDICAL,
    "hazmat_spill": ["hazmat_unit", "fire_engine", "heavy_rescue", "battalion_chief", "ambulance_als"],
    "flash_flood": ["heavy_rescue", "fire_engine", "ambulance_als"],
}
SAFETY_FIRST = ["hazmat_spill", "wildland_fire"]
