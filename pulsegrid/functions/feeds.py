"""Classes of hydrology, weather and free-text feeds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_FOOT = 0.3048

# WMO weather codes to alert levels; codes that are not listed are no alert.
WMO_ALERTS = {
    "warning": [75, 86, 95, 96, 99],
    "watch": [65, 67, 71, 73, 82, 85],
    "advisory": [45, 48, 56, 57, 61, 63, 66, 77, 80, 81],
}
#: Keywords of hazard types in alert titles, in order, and their speed multipliers; None: 0 if extreme or severe, else 0.3.
ALERT_KEYWORDS = [
    (["flash"], "flash_flood", None),
    (["flood"], "flood_inundation", None),
    (["fire"], "wildfire_perimeter", 0.0),
    (["smoke", "gas", "chemical", "hazmat"], "toxic_gas_plume", 0.4),
    (["collapse", "quake"], "road_collapse", 0.0),
    (["debris", "downed"], "structural_debris", 0.2),
    (["unrest"], "civil_unrest", 0.3),
]
#: The same of GeoJSON alert features.
FEATURE_KEYWORDS = [
    (["fire"], "wildfire_perimeter"),
    (["smoke", "gas"], "toxic_gas_plume"),
    (["collapse"], "road_collapse"),
    (["flash"], "flash_flood"),
    (["debris"], "structural_debris"),
]
#: The same of an operator's free text.
TEXT_KEYWORDS = [
    (["flood"], "flood_inundation"),
    (["fire"], "wildfire_perimeter"),
    (["gas", "toxic"], "toxic_gas_plume"),
    (["debris", "collapse"], "structural_debris"),
]
SEVERITY_WORDS = [("critical", "critical_blocked"), ("severe", "severe"), ("mod", "moderate"), ("low", "low")]
HAZARD_TYPES = ["flood_inundation", "flash_flood", "wildfire_perimeter", "toxic_gas_plume", "structural_debris", "road_collapse", "civil_unrest"]
CAP_SEVERITIES = {"Extreme": "critical_blocked", "Severe": "severe", "Moderate": "moderate", "Minor": "low", "Unknown": "moderate"}


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def keyword_type(text: Column, table: list, otherwise: str = "flood_inundation") -> Column:
    low = F.lower(text)
    out = F.lit(otherwise)
    for words, kind, *_ in reversed(table):
        out = F.when(_any(low, words), kind).otherwise(out)
    return out


def alert_multiplier(event: Column, severity: Column) -> Column:
    """Speed multiplier that an alert's title implies."""
    low = F.lower(event)
    out = F.when(severity == "Extreme", 0.0).otherwise(0.5)
    for words, _, value in reversed(ALERT_KEYWORDS):
        own = F.when(severity.isin("Extreme", "Severe"), 0.0).otherwise(0.3) if value is None else F.lit(value)
        out = F.when(_any(low, words), own).otherwise(out)
    return out


def hazard_from_text(kind: Column) -> Column:
    """Hazard type of an operator's words; an exact type name stands, anything else is a flood."""
    low = F.lower(F.trim(kind))
    exact = F.when(low.isin(HAZARD_TYPES), low).otherwise("flood_inundation")
    out = exact
    for words, name in reversed(TEXT_KEYWORDS):
        out = F.when(_any(low, words), name).otherwise(out)
    return F.coalesce(out, F.lit("flood_inundation"))


def severity_from_text(severity: Column) -> Column:
    low = F.lower(F.trim(severity))
    out = F.lit("critical_blocked")
    for word, name in reversed(SEVERITY_WORDS):
        out = F.when(low.contains(word), name).otherwise(out)
    return F.coalesce(out, F.lit("critical_blocked"))


def flood_stage(height_ft: Column, action: Column, minor: Column, moderate: Column, major: Column) -> Column:
    return F.when(height_ft >= major, "major").when(height_ft >= moderate, "moderate").when(height_ft >= minor, "minor").when(height_ft >= action, "action").otherwise("normal")


def is_flooding(stage: Column) -> Column:
    return stage.isin("minor", "moderate", "major")


def weather_alert(code: Column, wind_kmh: Column, rain_mm: Column) -> Column:
    """The code's level, raised by wind (75 km/h warning, 50 advisory if there is none) and rain (25 mm warning)."""
    base = F.lit("none")
    for level, codes in WMO_ALERTS.items():
        base = F.when(code.isin(codes), level).otherwise(base)
    return F.when((wind_kmh >= 75) | (rain_mm >= 25), "warning").when((wind_kmh >= 50) & (base == "none"), "advisory").otherwise(base)
