"""Coordinates of national grids as longitude and latitude, by built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half axes of the Airy 1830, GRS80 and WGS84 ellipsoids, and the shift between the British datum and WGS84.
AIRY, GRS80, WGS84 = (6377563.396, 6356256.909), (6378137.0, 6356752.314140), (6378137.0, 6356752.314245)
SHIFT, TURN, STRETCH = (446.448, -125.157, 542.060), (0.1502, 0.2470, 0.8421), -20.4894e-6
# Transverse Mercator grids as ellipsoid, scale, latitude and longitude of origin, false easting and northing.
BRITISH = (AIRY, 0.9996012717, 49.0, -2.0, 400000.0, -100000.0)
MERCATOR = {25800 + z: (GRS80, 0.9996, 0.0, 6.0 * z - 183, 500000.0, 0.0) for z in range(28, 39)} | {3006: (GRS80, 0.9996, 0.0, 15.0, 500000.0, 0.0)}
# The European equal-area grid as latitude and longitude of origin, false easting and northing.
EQUAL_AREA = {3035: (52.0, 10.0, 4321000.0, 3210000.0)}
#: Degrees already (ETRS89 and WGS84 differ by less than a metre).
GEOGRAPHIC = (4258, 4326)


def add_degrees(df: DataFrame, x: str, y: str, epsg: int, out: str) -> DataFrame:
    """Add struct<lon, lat> in degrees (WGS84); null where a coordinate is null. ValueError for systems that aren't known.

    A chain of projections, so that each intermediate result is computed once.
    """
    keep = df.columns
    if epsg in GEOGRAPHIC:
        lon, lat = F.col(x), F.col(y)
    elif epsg == 27700:
        df, lon, lat = _to_wgs84(*_transverse_mercator(df, F.col(x), F.col(y), *BRITISH))
    elif epsg in MERCATOR:
        df, lat, lon = _transverse_mercator(df, F.col(x), F.col(y), *MERCATOR[epsg])
        lon, lat = F.degrees(lon), F.degrees(lat)
    elif epsg in EQUAL_AREA:
        df, lon, lat = _equal_area(df, F.col(x), F.col(y), *EQUAL_AREA[epsg])
    else:
        raise ValueError(f"coordinates of EPSG:{epsg} aren't supported")
    place = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))
    return df.select(*(F.col(f"`{c}`") for c in keep if c != out), place.alias(out))


def _equal_area(df: DataFrame, east: Column, north: Column, lat0: float, lon0: float, east0: float, north0: float) -> tuple[DataFrame, Column, Column]:
    """Inverse Lambert azimuthal equal-area projection of GRS80, by its series; longitude and latitude in degrees."""
    a, b = GRS80
    e2 = 1 - b * b / (a * a)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0, qp = math.sin(math.radians(lat0)), q(1.0)
    beta0, radius = math.asin(q(s0) / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * s0 * s0) / (radius * math.cos(beta0))
    df = df.withColumns({"__x": (east - east0) / d, "__y": (north - north0) * d})
    df = df.withColumn("__r", F.sqrt(F.pow("__x", 2) + F.pow("__y", 2))).withColumn("__c", 2 * F.asin(F.col("__r") / (2 * radius)))
    x, y, r, c = (F.col(n) for n in ("__x", "__y", "__r", "__c"))
    df = df.withColumn("__b", F.asin(F.cos(c) * math.sin(beta0) + F.when(r > 0, y * F.sin(c) * math.cos(beta0) / r).otherwise(0.0)))
    lam = F.atan2(x * F.sin(c), r * math.cos(beta0) * F.cos(c) - y * math.sin(beta0) * F.sin(c))
    beta = F.col("__b")
    phi = (
        beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta)
        + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta)
    )
    return df, lon0 + F.degrees(lam), F.degrees(phi)


def _transverse_mercator(df: DataFrame, east: Column, north: Column, ellipsoid: tuple[float, float], scale: float, lat_0: float, lon_0: float, east0: float, north0: float) -> tuple[DataFrame, Column, Column]:
    """Inverse transverse Mercator projection by its series; latitude and longitude in radians, on the grid's own datum."""
    a, b = ellipsoid
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    lat0 = math.radians(lat_0)

    def arc(lat: Column) -> Column:
        d, s = lat - lat0, lat + lat0
        return b * scale * (
            (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s)
            + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
        )

    # The footpoint latitude: each round leaves about a thousandth of the error of the one before.
    lat = F.col("__lat")
    df = df.withColumn("__lat", (north - north0) / (a * scale) + lat0)
    for _ in range(5):
        df = df.withColumn("__lat", lat + (north - north0 - arc(lat)) / (a * scale))
    df = df.withColumns({"__w": 1 - e2 * F.pow(F.sin(lat), 2), "__t": F.tan(lat), "__d": east - east0})
    df = df.withColumns({"__nu": a * scale / F.sqrt("__w"), "__rho": a * scale * (1 - e2) / F.pow("__w", 1.5)})
    nu, rho, t, d = F.col("__nu"), F.col("__rho"), F.col("__t"), F.col("__d")
    eta2, sec = nu / rho - 1, 1 / F.cos(lat)
    phi = (
        lat - d**2 * t / (2 * rho * nu) + d**4 * t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta2 - 9 * t**2 * eta2)
        - d**6 * t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4)
    )
    lam = (
        math.radians(lon_0) + d * sec / nu - d**3 * sec / (6 * nu**3) * (nu / rho + 2 * t**2)
        + d**5 * sec / (120 * nu**5) * (5 + 28 * t**2 + 24 * t**4) - d**7 * sec / (5040 * nu**7) * (61 + 662 * t**2 + 1320 * t**4 + 720 * t**6)
    )
    df = df.withColumns({"__p": phi, "__q": lam})
    return df, F.col("__p"), F.col("__q")


def _to_wgs84(df: DataFrame, p: Column, q: Column) -> tuple[DataFrame, Column, Column]:
    """Longitude and latitude in degrees of a place on the British datum: a seven-parameter shift, good to a few metres."""
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    df = df.withColumn("__r", a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2)))
    df = df.withColumns({"__x": F.col("__r") * F.cos(p) * F.cos(q), "__y": F.col("__r") * F.cos(p) * F.sin(q), "__z": F.col("__r") * (1 - e2) * F.sin(p)})
    x, y, z, k = F.col("__x"), F.col("__y"), F.col("__z"), 1 + STRETCH
    rx, ry, rz = (math.radians(s / 3600) for s in TURN)
    df = df.withColumns({"__x": SHIFT[0] + k * x - rz * y + ry * z, "__y": SHIFT[1] + rz * x + k * y - rx * z, "__z": SHIFT[2] - ry * x + rx * y + k * z})
    a, b = WGS84
    e2 = 1 - b * b / (a * a)
    df = df.withColumn("__r", F.sqrt(x * x + y * y)).withColumn("__p", F.atan2(z, F.col("__r") * (1 - e2)))
    for _ in range(3):
        df = df.withColumn("__p", F.atan2(z + a * e2 * F.sin(p) / F.sqrt(1 - e2 * F.pow(F.sin(p), 2)), F.col("__r")))
    return df, F.degrees(F.atan2(y, x)), F.degrees(p)
