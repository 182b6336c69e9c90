"""Geospatial functions as Column expressions; angles in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius; WGS-84 axis and flattening; UTM scale and offsets.
EARTH_RADIUS = 6371000.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0, UTM_EASTING, UTM_NORTHING = 0.9996, 500000.0, 10000000.0
MGRS_BANDS = "CDEFGHJKLMNPQRSTUVWX"
MGRS_COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
MGRS_ROWS = ("ABCDEFGHJKLMNPQRSTUV", "FGHJKLMNPQRSTUVABCDE")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def haversine_distance(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = a2 - a1, F.radians(_c(lon2) - _c(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    a1, a2, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(a2), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)))
    return F.pmod(angle + 360.0, F.lit(360.0))


def is_ahead(lat, lon, heading, target_lat, target_lon) -> Column:
    """Whether the target's bearing is at most 90 degrees off the heading."""
    off = F.pmod(bearing(lat, lon, target_lat, target_lon) - _c(heading) + 540.0, F.lit(360.0)) - 180.0
    return F.abs(off) <= 90.0


def destination_spherical(lat, lon, bearing_deg, distance) -> Column:
    """array(lat, lon) reached on a sphere."""
    a, o, b, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(bearing_deg)), _c(distance) / EARTH_RADIUS
    end = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))))
    lon2 = o + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(end))
    return F.array(F.degrees(end), F.pmod(F.degrees(lon2) + 540.0, F.lit(360.0)) - 180.0)


def destination(lat, lon, bearing_deg, distance, rounds: int = 8) -> Column:
    """array(lat, lon) reached on the WGS-84 ellipsoid (Vincenty's direct formula).

    The angular distance is found by a fixed number of rounds inside one
    higher-order function, so the expression stays small.
    """
    f = WGS84_F
    b = WGS84_A * (1 - f)
    phi, lam, alpha, s = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(bearing_deg)), _c(distance)
    tan_u = (1 - f) * F.tan(phi)
    cos_u = 1 / F.sqrt(1 + tan_u * tan_u)
    sin_u = tan_u * cos_u
    sigma1 = F.atan2(tan_u, F.cos(alpha))
    sin_alpha = cos_u * F.sin(alpha)
    cos_sq = 1 - sin_alpha * sin_alpha
    u_sq = cos_sq * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    start = s / (b * big_a)

    def step(sigma: Column, _: Column) -> Column:
        c = F.cos(2 * sigma1 + sigma)
        sn, cs = F.sin(sigma), F.cos(sigma)
        return start + big_b * sn * (c + big_b / 4 * (cs * (-1 + 2 * c * c) - big_b / 6 * c * (-3 + 4 * sn * sn) * (-3 + 4 * c * c)))

    def finish(sigma: Column) -> Column:
        c, sn, cs = F.cos(2 * sigma1 + sigma), F.sin(sigma), F.cos(sigma)
        across = sin_u * sn - cos_u * cs * F.cos(alpha)
        phi2 = F.atan2(sin_u * cs + cos_u * sn * F.cos(alpha), (1 - f) * F.sqrt(sin_alpha * sin_alpha + across * across))
        turn = F.atan2(sn * F.sin(alpha), cos_u * cs - sin_u * sn * F.cos(alpha))
        k = f / 16 * cos_sq * (4 + f * (4 - 3 * cos_sq))
        lam2 = lam + turn - (1 - k) * f * sin_alpha * (sigma + k * sn * (c + k * cs * (-1 + 2 * c * c)))
        return F.array(F.degrees(phi2), F.pmod(F.degrees(lam2) + 540.0, F.lit(360.0)) - 180.0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, finish)


def utm_zone(lat, lon) -> Column:
    """UTM zone number with the exceptions for southern Norway and Svalbard."""
    lat, lon = _c(lat), _c(lon)
    plain = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32))
        .when((lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42), svalbard)
        .otherwise(plain)
        .cast("int")
    )


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def to_utm(lat, lon) -> Column:
    """struct(zone, hemisphere, easting, northing); null beyond the UTM latitudes 80 S to 84 N.

    Transverse Mercator by Krueger's series in the third flattening, to third order.
    """
    lat, lon = _c(lat), _c(lon)
    n = WGS84_F / (2 - WGS84_F)
    big_a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)

    def point(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        x, y = eta, xi
        for j, a in enumerate(alphas, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        south = F.when(lat < 0, UTM_NORTHING).otherwise(0.0)
        return F.struct(v["zone"].alias("zone"), F.when(lat < 0, "S").otherwise("N").alias("hemisphere"), (UTM_EASTING + UTM_K0 * big_a * x).alias("easting"), (south + UTM_K0 * big_a * y).alias("northing"))

    def angles(v: Column) -> Column:
        dlam = F.radians(lon - (v["zone"] * 6 - 183))
        return F.struct(v["zone"].alias("zone"), F.atan2(v["t"], F.cos(dlam)).alias("xi"), F.atanh(F.sin(dlam) / F.sqrt(1 + v["t"] * v["t"])).alias("eta"))

    sine = F.sin(F.radians(lat))
    base = F.struct(utm_zone(lat, lon).alias("zone"), F.sinh(F.atanh(sine) - e * F.atanh(e * sine)).alias("t"))
    return F.when(lat.between(-80, 84), _let(_let(base, angles), point))


def to_mgrs(lat, lon, digits: int = 5) -> Column:
    """Military grid reference, e.g. ``18TWL8044512388``; null beyond the UTM latitudes."""
    lat = _c(lat)
    unit = 10 ** (5 - digits)

    def letters(utm: Column) -> Column:
        zone, east, north = utm["zone"], utm["easting"], utm["northing"]
        band = F.substring(F.lit(MGRS_BANDS), F.least(F.floor((lat + 80) / 8) + 1, F.lit(20)).cast("int"), F.lit(1))
        columns = F.element_at(F.array(*map(F.lit, MGRS_COLUMNS)), F.pmod(zone - 1, F.lit(3)) + 1)
        rows = F.element_at(F.array(*map(F.lit, MGRS_ROWS)), F.pmod(zone - 1, F.lit(2)) + 1)
        first = F.substring(columns, F.floor(east / 100000).cast("int"), F.lit(1))
        second = F.substring(rows, (F.floor(north / 100000) % 20 + 1).cast("int"), F.lit(1))
        pad = lambda v: F.lpad(F.floor((v % 100000) / unit).cast("string"), digits, "0")
        return F.concat(F.lpad(zone.cast("string"), 2, "0"), band, first, second, pad(east), pad(north))

    return _let(to_utm(lat, lon), letters)


def route_distance(points) -> Column:
    """Sum of haversine lengths along an array of structs (lat, lon)."""
    points = _c(points)
    legs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine_distance(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda t, d: t + d)


def detour_ratio(distance, straight) -> Column:
    return F.try_divide(_c(distance), _c(straight))


def bounding_box(lat, lon, center_lat: float, center_lon: float, radius: float) -> Column:
    """A cheap condition that every point within the radius meets; it reaches the scan as plain comparisons."""
    dlat = math.degrees(radius / EARTH_RADIUS)
    low, high = center_lat - dlat, center_lat + dlat
    inside = _c(lat).between(low, high)
    if low <= -90 or high >= 90:  # a pole is within reach: any longitude
        return inside
    reach = math.sin(radius / EARTH_RADIUS) / math.cos(math.radians(center_lat))
    if radius / EARTH_RADIUS >= math.pi / 2 or reach >= 1:
        return inside
    dlon = math.degrees(math.asin(reach))
    west, east = center_lon - dlon, center_lon + dlon
    if west < -180:
        return inside & ((_c(lon) >= west + 360) | (_c(lon) <= east))
    if east > 180:
        return inside & ((_c(lon) >= west) | (_c(lon) <= east - 360))
    return inside & _c(lon).between(west, east)
