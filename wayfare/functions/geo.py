"""Geodesy and motion as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth radii, in km, of distances and of destination points.
RADIUS_KM = 6371.0
DESTINATION_RADIUS_KM = 6378.1
KM_PER_DEGREE = 111.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null if any coordinate is."""
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    s, t = F.sin(F.radians(c - a) / 2), F.sin(F.radians(d - b) / 2)
    h = s * s + t * t * F.cos(F.radians(a)) * F.cos(F.radians(c))
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    return haversine_km(lat1, lon1, lat2, lon2) * 1000.0


def seconds_between(a_us: Column, b_us: Column) -> Column:
    """Whole seconds from ``a_us`` to ``b_us``, rounded down."""
    d = _col(b_us) - _col(a_us)
    return ((d - F.pmod(d, F.lit(1_000_000))) / F.lit(1_000_000)).cast("long")


def speed_kmh(km: Column, seconds: Column) -> Column:
    """Speed over a pair of points, 0 where no whole second passed."""
    km, seconds = _col(km), _col(seconds)
    return F.when(seconds == 0, F.lit(0.0)).otherwise(km * 1000.0 / F.nullif(seconds, F.lit(0)) * 3.6)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to below 360."""
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    la, lc, dl = F.radians(a), F.radians(c), F.radians(d - b)
    y = F.sin(dl) * F.cos(lc)
    x = F.cos(la) * F.sin(lc) - F.sin(la) * F.cos(lc) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, km: Column, radius_km: float = DESTINATION_RADIUS_KM) -> tuple[Column, Column]:
    """Latitude and longitude reached over ``km`` at the initial ``bearing`` in degrees."""
    lat, lon, bearing, km = map(_col, (lat, lon, bearing, km))
    la, br, r = F.radians(lat), F.radians(bearing), km / F.lit(radius_km)
    la2 = F.asin(F.sin(la) * F.cos(r) + F.cos(la) * F.sin(r) * F.cos(br))
    lo2 = F.radians(lon) + F.atan2(F.sin(br) * F.sin(r) * F.cos(la), F.cos(r) - F.sin(la) * F.sin(la2))
    return F.degrees(la2), F.degrees(lo2)


def velocity_change_rate(v1: Column, v2: Column) -> Column:
    """Relative change from ``v1`` to ``v2``, 0 where ``v1`` is 0."""
    v1, v2 = _col(v1), _col(v2)
    return F.when(v1 == 0, F.lit(0.0)).otherwise((v2 - v1) / F.nullif(v1, F.lit(0.0)))


def velocity_change_between(a: Column, b: Column, c: Column) -> Column:
    """The relative change of speed at ``b`` on the way from ``a`` over ``b`` to ``c``, structs of t, lat and lon."""
    leg = lambda p, q: speed_kmh(haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]), seconds_between(p["t"], q["t"]))
    return velocity_change_rate(leg(a, b), leg(b, c))


def km_to_degrees(km: Column) -> Column:
    return _col(km) / KM_PER_DEGREE


def norm3(x: Column, y: Column, z: Column) -> Column:
    """Length of a vector."""
    x, y, z = map(_col, (x, y, z))
    return F.sqrt(x * x + y * y + z * z)
