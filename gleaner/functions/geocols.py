"""Column expressions on latitude and longitude in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in km, km per degree on a great circle.
EARTH_KM = 6371.0088
DEGREE_KM = 111.195


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = (b - a) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(a) * F.cos(b) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cell(value: Column, size: float) -> Column:
    """Number of the grid cell that holds a coordinate."""
    return F.floor(value / size)


def eastward(start: Column, end: Column) -> Column:
    """Degrees from one longitude to another the short way; half a turn keeps its sign."""
    d = end - start
    return F.when(F.abs(d) > 180, d - 360 * F.signum(d)).otherwise(d)


def date_line_turns(ring: Column) -> Column:
    """Places of a ring (array of lat, lon) where an edge crosses the date line: vertex from 0, and 1 east or -1 west."""
    before = F.concat(F.slice(ring, 1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
    d = F.zip_with(ring, before, lambda p, q: p["lon"] - q["lon"])
    turn = F.transform(d, lambda x, i: F.struct(i.alias("i"), F.when(x < -180, 1).when(x > 180, -1).otherwise(0).alias("way")))
    return F.filter(turn, lambda t: t["way"] != 0)


def unrolled(ring: Column, turns: Column) -> Column:
    """The ring with longitudes that go on past the date line. Pass plain columns."""
    way = lambda i: F.aggregate(F.filter(turns, lambda t: t["i"] <= i), F.lit(0), lambda acc, t: acc + t["way"])
    return F.transform(ring, lambda p, i: F.struct(p["lat"].alias("lat"), (p["lon"] + 360 * way(i)).alias("lon")))


def inside_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """True when the point lies inside the ring (array of lat, lon), by crossing count."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crosses(p: Column, q: Column) -> Column:
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        at = (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]
        return F.when(spans & (lon < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, after, crosses), F.lit(0), lambda acc, x: acc + x) % 2 == 1


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area on the equal-area cylinder."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(
        ring, after,
        lambda p, q: F.radians(eastward(p["lon"], q["lon"])) * (F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))) / 2,
    )
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)) * EARTH_KM * EARTH_KM


def ring_length_km(ring: Column) -> Column:
    """Length of the closed ring in km."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    legs = F.zip_with(ring, after, lambda p, q: haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """Point on the unit sphere as x, y, z."""
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]
