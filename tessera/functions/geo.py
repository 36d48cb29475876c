"""Geodesy on WGS-84 as column expressions: ECEF, local ENU and UTM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS-84 ellipsoid and the UTM projection.
SEMI_MAJOR = 6_378_137.0
FLATTENING = 1.0 / 298.257_223_563
E2 = 2.0 * FLATTENING - FLATTENING**2
EP2 = E2 / (1.0 - E2)
SEMI_MINOR = SEMI_MAJOR * (1.0 - FLATTENING)
UTM_SCALE = 0.9996
UTM_EAST = 500_000.0
UTM_SOUTH = 10_000_000.0
UTM_BANDS = "CDEFGHJKLMNPQRSTUVWX"


def _prime_vertical(lat: Column) -> Column:
    return F.lit(SEMI_MAJOR) / F.sqrt(1.0 - E2 * F.sin(lat) * F.sin(lat))


def geodetic_to_ecef(lat_deg: Column, lon_deg: Column, alt_m: Column | float = 0.0) -> Column:
    """struct<x,y,z> in metres."""
    alt = F.lit(alt_m) if not isinstance(alt_m, Column) else alt_m
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    n = _prime_vertical(lat)
    return F.struct(
        ((n + alt) * F.cos(lat) * F.cos(lon)).alias("x"),
        ((n + alt) * F.cos(lat) * F.sin(lon)).alias("y"),
        ((n * (1.0 - E2) + alt) * F.sin(lat)).alias("z"),
    )


def ecef_to_geodetic(x: Column, y: Column, z: Column, steps: int = 10) -> Column:
    """struct<lat,lon,alt>, by a fixed number of fixed-point steps on the latitude; near the poles the height is taken along z."""
    p = F.sqrt(x * x + y * y)
    start = F.atan2(z, p * (1.0 - E2))

    def step(lat: Column, _: Column) -> Column:
        return F.atan2(z + E2 * _prime_vertical(lat) * F.sin(lat), p)

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    height = lambda a: F.when(F.abs(F.cos(a)) > 1e-10, p / F.cos(a) - _prime_vertical(a)).otherwise(F.abs(z) - SEMI_MINOR)
    return F.transform(F.array(lat), lambda a: F.struct(F.degrees(a).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), height(a).alias("alt")))[0]


def ecef_to_enu(x: Column, y: Column, z: Column, lat0: float, lon0: float, alt0: float = 0.0) -> Column:
    """struct<east,north,up> about a fixed origin."""
    o = geodetic_to_ecef(F.lit(float(lat0)), F.lit(float(lon0)), F.lit(float(alt0)))
    dx, dy, dz = x - o.x, y - o.y, z - o.z
    sa, ca, so, co = F.sin(F.radians(F.lit(float(lat0)))), F.cos(F.radians(F.lit(float(lat0)))), F.sin(F.radians(F.lit(float(lon0)))), F.cos(F.radians(F.lit(float(lon0))))
    return F.struct(
        (co * dy - so * dx).alias("east"),
        (ca * dz - sa * co * dx - sa * so * dy).alias("north"),
        (ca * co * dx + ca * so * dy + sa * dz).alias("up"),
    )


def enu_to_ecef(east: Column, north: Column, up: Column, lat0: float, lon0: float, alt0: float = 0.0) -> Column:
    """struct<x,y,z>."""
    o = geodetic_to_ecef(F.lit(float(lat0)), F.lit(float(lon0)), F.lit(float(alt0)))
    sa, ca, so, co = F.sin(F.radians(F.lit(float(lat0)))), F.cos(F.radians(F.lit(float(lat0)))), F.sin(F.radians(F.lit(float(lon0)))), F.cos(F.radians(F.lit(float(lon0))))
    return F.struct(
        (o.x + ca * co * up - sa * co * north - so * east).alias("x"),
        (o.y + ca * so * up - sa * so * north + co * east).alias("y"),
        (o.z + sa * up + ca * north).alias("z"),
    )


def geodetic_to_enu(lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float = 0.0) -> Column:
    p = geodetic_to_ecef(lat, lon, alt)
    return ecef_to_enu(p.x, p.y, p.z, lat0, lon0, alt0)


def utm_zone_number(lat: Column, lon: Column) -> Column:
    """int; Norway and Svalbard have their own zones, and longitude 180 falls in zone 61."""
    svalbard = (lat >= 72) & (lat < 84)
    between = lambda a, b: (lon >= a) & (lon < b)
    return (
        F.when(svalbard & between(0, 9), 31)
        .when(svalbard & between(9, 21), 33)
        .when(svalbard & between(21, 33), 35)
        .when(svalbard & between(33, 42), 37)
        .when((lat >= 56) & (lat < 64) & between(3, 12), 32)
        .otherwise(((lon + 180.0) / 6.0).cast("int") + 1)
    )


def utm_zone_letter(lat: Column) -> Column:
    """One band letter; null outside -80..84 degrees."""
    i = F.least(((lat + 80.0) / 8.0).cast("int"), F.lit(len(UTM_BANDS) - 1))
    return F.when((lat >= -80) & (lat <= 84), F.substring(F.lit(UTM_BANDS), i + 1, F.lit(1)))


def geodetic_to_utm(lat_deg: Column, lon_deg: Column) -> Column:
    """struct<easting,northing,zone,letter>; null outside the bands."""
    zone = utm_zone_number(lat_deg, lon_deg)
    lat = F.radians(lat_deg)
    t, c = F.tan(lat) * F.tan(lat), EP2 * F.cos(lat) * F.cos(lat)
    a = F.cos(lat) * (F.radians(lon_deg) - F.radians((zone - 1) * 6 - 177))
    n = _prime_vertical(lat)
    arc = SEMI_MAJOR * (
        (1.0 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * lat
        - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * lat)
        + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * lat)
        - (35 * E2**3 / 3072) * F.sin(6 * lat)
    )
    east = UTM_EAST + UTM_SCALE * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, 5) / 120)
    north = UTM_SCALE * (arc + n * F.tan(lat) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, 6) / 720))
    ok = (lat_deg >= -80) & (lat_deg <= 84)
    return F.when(ok, F.struct(east.alias("easting"), (north + F.when(lat_deg < 0, UTM_SOUTH).otherwise(0.0)).alias("northing"), zone.alias("zone"), utm_zone_letter(lat_deg).alias("letter")))


def utm_to_geodetic(easting: Column, northing: Column, zone: Column, letter: Column) -> Column:
    """struct<lat,lon>; letters before N are south of the equator."""
    x = easting - UTM_EAST
    y = northing - F.when(F.upper(letter) < "N", UTM_SOUTH).otherwise(0.0)
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    mu = y / UTM_SCALE / (SEMI_MAJOR * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    n = _prime_vertical(foot)
    t, c = F.tan(foot) * F.tan(foot), EP2 * F.cos(foot) * F.cos(foot)
    r = SEMI_MAJOR * (1 - E2) / F.pow(1 - E2 * F.sin(foot) * F.sin(foot), 1.5)
    d = x / (n * UTM_SCALE)
    lat = foot - (n * F.tan(foot) / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(foot)
    return F.struct(F.degrees(lat).alias("lat"), ((zone - 1) * 6 - 177 + F.degrees(lon)).alias("lon"))


def hdop_to_noise(hdop: Column, base_sigma_m: float = 3.0, vertical_sigma_m: float = 5.0) -> Column:
    """The diagonal of the position noise: array of three variances."""
    h = (hdop * base_sigma_m) * (hdop * base_sigma_m)
    return F.array(h, h, F.lit(vertical_sigma_m**2))


def fix_to_enu(kind: Column, lat: Column, lon: Column, alt: Column, lat0: float, lon0: float, alt0: float = 0.0) -> Column:
    """ENU of a fix: a GGA fix has its own altitude, an RMC fix that of the reference."""
    return geodetic_to_enu(lat, lon, F.when(kind == "GGA", alt).otherwise(F.lit(float(alt0))), lat0, lon0, alt0)
