"""Links and flood polygons overlaid by geometry, and points between geographic and projected coordinates. Spark expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Overlay.


def _cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> Column:
    """The grid cells that a box touches."""
    of = lambda low, high: F.sequence(F.floor(low / size), F.floor(high / size))
    return F.flatten(F.transform(of(low_x, high_x), lambda x: F.transform(of(low_y, high_y), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Positive, zero or negative as c lies left of, on or right of the line from a to b; exact for whole numbers under 2 ** 26."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether the closed segments ab and cd have a point in common, touching and overlapping ones included."""
    boxes = (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.greatest(cx, dx) >= F.least(ax, bx)) & (F.greatest(ay, by) >= F.least(cy, dy)) & (F.greatest(cy, dy) >= F.least(ay, by))
    across = lambda p, q: ((p >= 0) & (q <= 0)) | ((p <= 0) & (q >= 0))
    ab = across(_turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy))
    return boxes & ab & across(_turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by))


def _sides(ring: Column) -> Column:
    """(x1, y1, x2, y2) of each side of a ring of (x, y); a ring may repeat its first corner at its end."""
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def point_inside(x: Column, y: Column, sides: Column) -> Column:
    """Whether an odd number of sides lies to the right of the point; on a side either answer may come (the sides themselves are tested apart)."""
    right = lambda s: ((s["y1"] > y) != (s["y2"] > y)) & ((_turn(s["x1"], s["y1"], s["x2"], s["y2"], x, y) > 0) == (s["y2"] > s["y1"]))
    return F.size(F.filter(sides, right)) % 2 == 1


def overlay_polygons(links: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """The columns of both for every link that has a point in common with a polygon, each pair once.

    ``links`` (x1, y1, x2, y2, ...): straight links. ``polygons`` (ring, ...): array of (x, y) structs, without holes, any winding, not necessarily
    convex; the boundary belongs to it. Both are put into the grid cells that their boxes touch, joined by cell, and kept in
    the one cell that holds the lower left corner of the boxes' common part, so no pair comes twice and nothing has to be removed later.
    Then the exact test: a side meets the link, or the link's start is inside. ``cell`` should be about the size of a common polygon; AQE splits
    a crowded cell. Links with a null or NaN end and rings of under three corners, or with such corners, meet nothing. Other columns must
    not clash.
    """
    if not cell > 0:
        raise ValueError(f"cell size {cell!r}")
    clash = set(links.columns) & set(polygons.columns)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    good = F.lit(True)
    for c in ends:
        good = good & c.isNotNull() & ~F.isnan(c.cast("double"))
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    boxed = links.where(good).select("*", *[c.alias(n) for c, n in zip(box, ("_lx", "_ly", "_hx", "_hy"), strict=True)])
    placed = boxed.select("*", F.explode(_cells(F.col("_lx"), F.col("_ly"), F.col("_hx"), F.col("_hy"), cell)).alias("_cell"))
    corner = lambda axis, pick: pick(F.transform("ring", lambda p: p[axis]))
    bad = F.exists("ring", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"].cast("double")) | F.isnan(p["y"].cast("double")))
    rings = polygons.where((F.size("ring") >= 3) & ~bad).select(
        "*", corner("x", F.array_min).alias("_px"), corner("y", F.array_min).alias("_py"), corner("x", F.array_max).alias("_qx"), corner("y", F.array_max).alias("_qy")
    )
    rings = rings.select("*", F.explode(_cells(F.col("_px"), F.col("_py"), F.col("_qx"), F.col("_qy"), cell)).alias("_cell"))
    common = (F.col("_lx") <= F.col("_qx")) & (F.col("_px") <= F.col("_hx")) & (F.col("_ly") <= F.col("_qy")) & (F.col("_py") <= F.col("_hy"))
    first = (F.floor(F.greatest("_lx", "_px") / cell) == F.col("_cell.x")) & (F.floor(F.greatest("_ly", "_py") / cell) == F.col("_cell.y"))
    # Spark tells sizes from the files, which do not know of cells, corners and copies: by those it would broadcast either side through the driver.
    met = placed.join(rings.hint("merge"), "_cell").where(common & first).withColumn("_sides", _sides(F.col("ring")))
    touches = F.exists("_sides", lambda s: segments_meet(*ends, s["x1"], s["y1"], s["x2"], s["y2"]))
    return met.where(touches | point_inside(ends[0], ends[1], F.col("_sides"))).select(*links.columns, *polygons.columns)


def flood_depths(links: DataFrame, polygons: DataFrame, key: list[str], cell: float) -> DataFrame:
    """(``key``, scenario, depth): the masks of ``network.overlay``, as the greatest depth of a scenario's polygons that a link meets."""
    return overlay_polygons(links, polygons, cell).groupBy(*key, "scenario").agg(F.max("depth").alias("depth"))


# Projection: transverse Mercator on WGS 84 by Krueger's series in the third flattening, to its fourth power (under a micrometre within 30 degrees of the meridian).

#: WGS 84, and the scale and false easting of UTM. Fixed values.
AXIS, FLATTENING, SCALE, EASTING = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0

_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectified meridian.
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series from conformal to rectified latitude, back, and from conformal to geographic latitude. Fixed values in the third flattening.
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


class UnknownReferenceSystem(ValueError):
    """A coordinate reference system that is not defined here."""


def _zone(crs: str) -> tuple[float, float]:
    """(central meridian in degrees, false northing) of a UTM zone by its EPSG code."""
    code = crs.removeprefix("EPSG:")
    if crs.startswith("EPSG:") and len(code) == 5 and code.isdigit() and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return 6.0 * int(code[3:]) - 183.0, 0.0 if code[:3] == "326" else 10_000_000.0
    raise UnknownReferenceSystem(f"{crs!r}; expected EPSG:4326, EPSG:32601 to 32660 or EPSG:32701 to 32760")


def to_utm(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees on WGS 84; null where a coordinate is null or latitude is beyond a pole."""
    middle, northing = _zone(crs)
    turn = F.radians(lon - F.lit(middle))
    sine = F.sin(F.radians(lat))
    # The conformal latitude's tangent.
    t = F.sinh(F.atanh(sine) - F.lit(_ECCENTRICITY) * F.atanh(F.lit(_ECCENTRICITY) * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(FORWARD, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    known = F.abs(lat) < 90
    return F.when(known, F.lit(EASTING) + F.lit(SCALE * RADIUS) * x), F.when(known, F.lit(northing) + F.lit(SCALE * RADIUS) * y)


def from_utm(easting: Column, northing: Column, crs: str) -> tuple[Column, Column]:
    """(lon, lat) in degrees on WGS 84 of metres in a UTM zone."""
    middle, north = _zone(crs)
    xi, eta = (northing - F.lit(north)) / F.lit(SCALE * RADIUS), (easting - F.lit(EASTING)) / F.lit(SCALE * RADIUS)
    p, q = xi, eta
    for j, b in enumerate(INVERSE, 1):
        p = p - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, c in enumerate(LATITUDE, 1):
        lat = lat + F.lit(c) * F.sin(2 * j * chi)
    return F.lit(middle) + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(lat)


def reproject(df: DataFrame, x: str, y: str, source: str, target: str) -> DataFrame:
    """``df`` with the coordinates ``x`` and ``y`` in another system: EPSG:4326 (longitude, latitude) and the UTM zones on WGS 84; others are refused by name."""
    lon, lat = (F.col(x), F.col(y)) if source == "EPSG:4326" else from_utm(F.col(x), F.col(y), source)
    if source == target:
        return df
    there = (lon, lat) if target == "EPSG:4326" else to_utm(lon, lat, target)
    return df.withColumns({x: there[0], y: there[1]})
