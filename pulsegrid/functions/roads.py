"""Road tags to access, direction, speed and cost, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default speed in km/h, and the share of it driven with lights and sirens, by road class.
ROAD_CLASSES = {
    "motorway": (100.0, 1.20),
    "trunk": (80.0, 1.20),
    "primary": (60.0, 1.15),
    "secondary": (50.0, 1.10),
    "tertiary": (40.0, 1.05),
    "unclassified": (30.0, 1.00),
    "residential": (25.0, 1.00),
    "service": (15.0, 1.00),
    "living_street": (15.0, 1.00),
    "motorway_link": (60.0, 1.15),
    "trunk_link": (50.0, 1.15),
    "primary_link": (45.0, 1.10),
    "secondary_link": (35.0, 1.05),
    "tertiary_link": (30.0, 1.00),
}
CLOSED = ["no", "private", "agricultural", "forestry", "delivery"]
NO_SPEED = ["", "none", "signals", "variable", "implicit"]
OTHER_SPEED, OTHER_SIREN, KMH_PER_MPH = 30.0, 1.0, 1.609344
PROFILES = {"distance": "distance_m", "travel_time": "travel_time_s", "emergency_time": "emergency_time_s"}


def tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def _plain(value: Column) -> Column:
    return F.lower(F.trim(value))


def way_accessible(tags: Column, allow_emergency: bool = True) -> Column:
    """Whether vehicles may use a way; emergency designations override closures. Missing tags mean open."""
    access = F.coalesce(tag(tags, "access"), F.lit("yes"))
    vehicle = F.coalesce(tag(tags, "motor_vehicle"), access)
    car = F.coalesce(tag(tags, "motorcar"), vehicle)
    is_open = ~(_plain(access).isin(CLOSED) | _plain(vehicle).isin(CLOSED) | _plain(car).isin(CLOSED))
    if not allow_emergency:
        return is_open
    named = F.coalesce(_plain(tag(tags, "emergency")).isin("yes", "designated", "destination"), F.lit(False))
    return named | (_plain(access) == "emergency") | is_open


def road_class_kept(highway: Column, classes: list[str] | None = None) -> Column:
    return F.coalesce(highway.isin(list(classes or ROAD_CLASSES)), F.lit(False))


def parse_maxspeed(value: Column, default_kmh: Column) -> Column:
    """km/h of a speed tag; what cannot be read, or is 0, gives the default, which is 1 at least."""
    fallback = F.greatest(default_kmh, F.lit(1.0))
    text = _plain(value)
    head = F.trim(F.regexp_extract(text, r"^([^@;:]*)", 1))
    number = lambda units: F.expr("double(null)") if units is None else F.regexp_extract(head, rf"^(\d+(?:\.\d+)?)\s*{units}$", 1).try_cast("double")
    speed = F.coalesce(number("(?:mph|miles_per_hour)") * KMH_PER_MPH, number("(?:km/h|kmh|kph)"), number(""))
    return F.when(text.isNull() | text.isin(NO_SPEED), fallback).when(text == "walk", 5.0).when(speed > 0, speed).otherwise(fallback)


def directions(tags: Column) -> Column:
    """struct(forward, reverse): which ways a road may be driven along its nodes' order."""
    oneway = F.coalesce(_plain(tag(tags, "oneway")), F.lit("no"))
    only_forward = (F.coalesce(F.lower(tag(tags, "junction")), F.lit("")) == "roundabout") | oneway.isin("yes", "1", "true")
    only_back = ~only_forward & oneway.isin("-1", "reverse")
    return F.struct((~only_back).alias("forward"), (~only_forward).alias("reverse"))


def _of_class(highway: Column, index: int, other: float) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in ROAD_CLASSES.items() for x in (k, v[index])])
    return F.coalesce(F.try_element_at(table, highway), F.lit(other))


def edge_cost(distance_m: Column, highway: Column, maxspeed: Column, profile: str = "distance") -> Column:
    """struct(cost, distance_m, travel_time_s, emergency_time_s, maxspeed_kmh); speeds are 0.1 m/s at least."""
    kmh = parse_maxspeed(maxspeed, _of_class(highway, 0, OTHER_SPEED))
    seconds = lambda speed: distance_m / F.greatest(speed / 3.6, F.lit(0.1))
    values = {"distance_m": distance_m, "travel_time_s": seconds(kmh), "emergency_time_s": seconds(kmh * _of_class(highway, 1, OTHER_SIREN))}
    return F.struct(values[PROFILES[profile]].alias("cost"), *[v.alias(k) for k, v in values.items()], kmh.alias("maxspeed_kmh"))
