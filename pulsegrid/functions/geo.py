"""Geometry on WGS84 coordinates as Column expressions.

Points are two columns (longitude first), polylines and rings are arrays of struct(lon, lat); rings are
stored unclosed. Nothing here is a Python UDF.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
METERS_PER_UNIT = {"m": 1.0, "km": 1000.0, "mi": 1609.344}
LINE_EPSILON, RING_EPSILON = 1e-12, 1e-9
MERCATOR_LATITUDE = 85.05112878


def _num(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, int | float) else F.col(x)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Great-circle distance, null if a coordinate is; the square under the root is clamped to [0, 1]."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    a = F.when(a < 0, 0.0).when(a > 1, 1.0).otherwise(a)  # greatest and least would pass over a null
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_M / METERS_PER_UNIT[unit])


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x2 - x1) + F.abs(y2 - y1)


def valid_wgs84(lon: Column, lat: Column) -> Column:
    """Finite and within range; never null."""
    inside = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    return F.coalesce(inside, F.lit(False))


def share_of_segment(lon: Column, lat: Column, a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column) -> Column:
    """How far along a segment (0 to 1) its nearest point lies, on a local flat map scaled by latitude."""
    scale = F.cos(F.radians((a_lat + b_lat) / 2))
    dx, dy = (b_lon - a_lon) * scale, b_lat - a_lat
    size = dx * dx + dy * dy
    along = ((lon - a_lon) * scale * dx + (lat - a_lat) * dy) / F.when(size >= LINE_EPSILON, size)
    return F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def project_to_segment(lon: Column, lat: Column, a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column) -> Column:
    """struct(lon, lat, distance_m, t): the nearest point of a segment, found on a local flat map scaled by latitude."""
    t = share_of_segment(lon, lat, a_lon, a_lat, b_lon, b_lat)
    x, y = a_lon + t * (b_lon - a_lon), a_lat + t * (b_lat - a_lat)
    return F.struct(x.alias("lon"), y.alias("lat"), haversine(lon, lat, x, y).alias("distance_m"), t.alias("t"))


def orientation(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """0 collinear, 1 clockwise, 2 counter-clockwise."""
    value = (qy - py) * (rx - qx) - (qx - px) * (ry - qy)
    return F.when(F.abs(value) < LINE_EPSILON, 0).when(value > 0, 1).otherwise(2)


def on_segment(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column, eps: float = LINE_EPSILON) -> Column:
    """Whether q lies in the box of p and r."""
    between = lambda v, a, b: (v <= F.greatest(a, b) + eps) & (v >= F.least(a, b) - eps)
    return between(qx, px, rx) & between(qy, py, ry)


def segments_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments ab and cd (structs of lon, lat) share a point; collinear touch counts."""
    xy = lambda p: (p["lon"], p["lat"])
    o1, o2 = orientation(*xy(a), *xy(b), *xy(c)), orientation(*xy(a), *xy(b), *xy(d))
    o3, o4 = orientation(*xy(c), *xy(d), *xy(a)), orientation(*xy(c), *xy(d), *xy(b))
    touch = lambda o, p, q, r: (o == 0) & on_segment(*xy(p), *xy(q), *xy(r))
    return ((o1 != o2) & (o3 != o4)) | touch(o1, a, c, b) | touch(o2, a, d, b) | touch(o3, c, a, d) | touch(o4, c, b, d)


def ring_sides(ring: Column) -> Column:
    """array of struct(a, b): a ring's sides, the closing one included."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd ray cast; the boundary counts as inside, rings of fewer than three vertices hold nothing."""
    sides = ring_sides(ring)

    def on_side(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]
        cross = (lat - ay) * (bx - ax) - (lon - ax) * (by - ay)
        return (F.abs(cross) < RING_EPSILON) & on_segment(ax, ay, lon, lat, bx, by, RING_EPSILON)

    def crossed(s: Column) -> Column:
        ax, ay, bx, by = s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"]
        straddles = (ay > lat) != (by > lat)
        return straddles & (lon < (bx - ax) * (lat - ay) / F.when(straddles, by - ay) + ax)

    odd = F.size(F.filter(sides, lambda s: F.coalesce(crossed(s), F.lit(False)))) % 2 == 1
    return (F.size(ring) >= 3) & (F.exists(sides, on_side) | odd)


def segment_meets_ring(a: Column, b: Column, ring: Column) -> Column:
    """Whether a segment (two structs) lies in, touches or crosses a ring."""
    inside = point_in_ring(a["lon"], a["lat"], ring) | point_in_ring(b["lon"], b["lat"], ring)
    return (F.size(ring) >= 3) & (inside | F.exists(ring_sides(ring), lambda s: segments_intersect(a, b, s["a"], s["b"])))


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Whether any segment of a polyline meets a ring."""
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.exists(pairs, lambda s: segment_meets_ring(s["a"], s["b"], ring))


def bounds(points: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of an array of points."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def bounds_overlap(a: Column, b: Column) -> Column:
    return (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"]) & (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"])


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial compass bearing in [0, 360)."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def turn_angle(before: Column, after: Column) -> Column:
    """From two bearings, in [-180, 180): right is positive."""
    return F.pmod(after - before + 540.0, F.lit(360.0)) - 180.0


def maneuver(angle: Column) -> Column:
    """Class of a turn; each band includes its outer end."""
    size, side = F.abs(angle), F.when(angle > 0, "right").otherwise("left")
    return F.when(size > 170, "u_turn").when(size <= 20, "straight").when(size <= 45, F.concat(F.lit("slight_"), side)).when(size <= 135, side).otherwise(F.concat(F.lit("sharp_"), side))


def slope(horizontal_m: Column, rise_m: Column) -> Column:
    """struct(rise_m, distance_3d_m, grade_percent, angle_deg); grade and angle are 0 under a millimetre."""
    flat = horizontal_m < 0.001
    ratio = rise_m / F.when(~flat, horizontal_m)
    return F.struct(
        rise_m.alias("rise_m"),
        F.hypot(horizontal_m, rise_m).alias("distance_3d_m"),
        F.when(flat, 0.0).otherwise(ratio * 100).alias("grade_percent"),
        F.when(flat, 0.0).otherwise(F.degrees(F.atan(ratio))).alias("angle_deg"),
    )


# Per apparatus (most climb %, most descent %, slowest share of speed, loss rate per % of climb).
GRADE_PROFILES = {
    "ambulance_als": (26.0, 28.0, 0.25, 0.035),
    "ambulance_bls": (26.0, 28.0, 0.25, 0.035),
    "fire_engine": (18.0, 20.0, 0.15, 0.055),
    "ladder_truck": (14.0, 16.0, 0.10, 0.075),
    "battalion_chief": (30.0, 32.0, 0.35, 0.025),
    # no limits are published for these two; they take the fire engine's
    "heavy_rescue": (18.0, 20.0, 0.15, 0.055),
    "hazmat_unit": (18.0, 20.0, 0.15, 0.055),
}


def grade_multiplier(apparatus: Column, grade_percent: Column, profiles: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
    """Share of flat speed an apparatus keeps on a grade; 0 where it cannot go. Unknown apparatus: null."""
    table = F.create_map(*[x for k, v in (profiles or GRADE_PROFILES).items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.try_element_at(table, apparatus)
    climb, descent, floor, loss = own[0], own[1], own[2], own[3]
    steep = F.abs(grade_percent)
    down = F.when(steep <= 6, 1 - 0.015 * (steep - 1)).otherwise(0.925 - 0.045 * (steep - 6))
    return (
        F.when(own.isNull(), F.lit(None).cast("double"))
        .when(steep <= 1, 1.0)
        .when((grade_percent > climb) | (grade_percent < -descent), 0.0)
        .when(grade_percent > 0, F.greatest(floor, F.exp(-loss * (grade_percent - 1))))
        .otherwise(F.greatest(F.lit(0.35), down))
    )


def tile_x(lon: Column, zoom: Column) -> Column:
    """Web Mercator column; longitudes wrap."""
    n = F.pow(F.lit(2.0), zoom)
    wrapped = F.pmod(lon + 180.0, F.lit(360.0))
    return F.least(F.floor(wrapped / 360.0 * n), n - 1).cast("int")


def tile_y(lat: Column, zoom: Column) -> Column:
    """Web Mercator row from the north; latitudes are clamped to the map's."""
    n = F.pow(F.lit(2.0), zoom)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LATITUDE)), F.lit(MERCATOR_LATITUDE)))
    y = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / pi) / 2 * n
    return F.least(F.greatest(F.floor(y), F.lit(0)), n - 1).cast("int")


def tile_corner(x: Column, y: Column, zoom: Column) -> Column:
    """struct(lon, lat) of a tile's north-west corner."""
    n = F.pow(F.lit(2.0), zoom)
    return F.struct((x / n * 360.0 - 180.0).alias("lon"), F.degrees(F.atan(F.sinh(pi * (1 - 2 * y / n)))).alias("lat"))


def tile_row_tms(y: Column, zoom: Column) -> Column:
    """The row counted from the south."""
    return (F.pow(F.lit(2.0), zoom) - 1 - y).cast("int")


def ground_resolution(lat: Column, zoom: Column, tile_pixels: int = 256) -> Column:
    """Metres per pixel."""
    return F.cos(F.radians(lat)) * (2 * pi * 6_378_137.0) / (tile_pixels * F.pow(F.lit(2.0), zoom))


def covering_tiles(lon1: Column, lat1: Column, lon2: Column, lat2: Column, zoom: Column) -> Column:
    """array of struct(x, y) of the tiles that a box covers; its corners may be swapped."""
    xs = F.sequence(tile_x(F.least(lon1, lon2), zoom), tile_x(F.greatest(lon1, lon2), zoom))
    ys = F.sequence(tile_y(F.greatest(lat1, lat2), zoom), tile_y(F.least(lat1, lat2), zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def guess_lon_lat(first: Column, second: Column) -> Column:
    """struct(lon, lat) of a pair in unknown order: a first value within 90 is taken for the latitude."""
    swapped = F.abs(first) <= 90
    return F.struct(F.when(swapped, second).otherwise(first).alias("lon"), F.when(swapped, first).otherwise(second).alias("lat"))


def circle(lon: Column, lat: Column, radius_m: Column, vertices: int = 12) -> Column:
    """A regular ring around a point."""
    step = 2 * pi / vertices
    dlat = radius_m / 111_320.0
    dlon = radius_m / (111_320.0 * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda i: F.struct((lon + dlon * F.cos(i * step)).alias("lon"), (lat + dlat * F.sin(i * step)).alias("lat")))


def path_pairs(path: Column) -> Column:
    """array of struct(src, dst): the directed steps of a path."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))


def ring_of(ring: Column) -> Column:
    """A ring without its repeated last vertex."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
