"""Geometry as Column expressions: no Python in the row path."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.functions.scalar import col_of

EARTH_KM = 6371

# WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
# GRS80 flattening, used by EPSG:32148.
GRS80_F = 1 / 298.257222101


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in kilometres."""
    lon1, lat1, lon2, lat2 = map(col_of, (lon1, lat1, lon2, lat2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # least() would skip a null and turn a missing point into half the globe.
    return F.lit(2.0 * EARTH_KM) * F.asin(F.when(chord > 1, F.lit(1.0)).otherwise(F.sqrt(chord)))


def manhattan(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(col_of, (x1, y1, x2, y2))
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def bbox_area_km2(min_lon, min_lat, max_lon, max_lat) -> Column:
    """Area of a box as the product of its southern and western sides."""
    south = haversine_km(min_lon, min_lat, max_lon, min_lat)
    west = haversine_km(min_lon, min_lat, min_lon, max_lat)
    return south * west


def bbox_polygon(min_x, min_y, max_x, max_y) -> Column:
    """Closed ring of the box corners, starting bottom left and going up."""
    ring = [(min_x, min_y), (min_x, max_y), (max_x, max_y), (max_x, min_y), (min_x, min_y)]
    return F.array(*[F.struct(col_of(x).alias("x"), col_of(y).alias("y")) for x, y in ring])


def grid_bin(value, low: float, high: float, size: float) -> Column:
    """Cell index along one axis.

    ``(high - low) // size`` evenly spaced edges from low to high; 0 is below
    the first edge and the number of edges is at or above the last one.
    """
    value = col_of(value)
    edges = int((high - low) // size)
    if edges < 1:
        return F.when(value.isNotNull(), F.lit(0)).cast("long")
    if edges == 1:
        return F.when(value < low, F.lit(0)).when(value >= low, F.lit(1)).cast("long")
    width = (high - low) / (edges - 1)
    inside = F.floor((value - F.lit(float(low))) / F.lit(width)) + 1
    return (
        F.when(value < low, F.lit(0)).when(value >= high, F.lit(edges)).when(inside > edges - 1, F.lit(edges - 1)).otherwise(inside)
    ).cast("long")


def hex_axial(x, y, size: float) -> tuple[Column, Column]:
    """Axial indices of the pointy-top hexagon of side ``size`` around a point."""
    x, y = col_of(x), col_of(y)
    q = (x * F.lit(math.sqrt(3) / 3) - y * F.lit(1 / 3)) / F.lit(float(size))
    r = y * F.lit(2 / 3) / F.lit(float(size))
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return (
        F.when(fix_q, -rr - rs).otherwise(rq).cast("long"),
        F.when(fix_r, -rq - rs).otherwise(rr).cast("long"),
    )


def hex_id(q, r) -> Column:
    return F.concat_ws(":", col_of(q).cast("string"), col_of(r).cast("string"))


# The six neighbours of an axial hexagon.
HEX_NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


@F.pandas_udf(T.StructType().add("dist", T.DoubleType()).add("bearing", T.DoubleType()))
def geodesic_inv(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    """WGS84 ellipsoid distance in metres and forward azimuth in degrees, by Vincenty's inverse method.

    Iterates a whole Arrow batch until every pair has settled, two or three
    rounds for bus steps. Near-antipodal pairs, which do not settle, come out
    null. An Arrow function, not a chain of columns: some fifty nested
    expressions would be copied into every filter on the result.
    """
    with np.errstate(all="ignore"):
        return pd.DataFrame(dict(zip(("dist", "bearing"), _vincenty(*(c.to_numpy(float) for c in (lon1, lat1, lon2, lat2))))))


def _vincenty(lon1, lat1, lon2, lat2, rounds: int = 20):
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    apart = np.radians(lon2 - lon1)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, change = apart, np.full_like(apart, np.inf)
    for _ in range(rounds):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_sig = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_sig = s1 * s2 + c1 * c2 * cl
        sig = np.arctan2(sin_sig, cos_sig)
        sin_az = np.where(sin_sig == 0, 0.0, c1 * c2 * sl / sin_sig)
        cos2_az = 1 - sin_az**2
        mid = np.where(cos2_az < 1e-15, 0.0, cos_sig - 2 * s1 * s2 / cos2_az)
        c = f / 16 * cos2_az * (4 + f * (4 - 3 * cos2_az))
        new = apart + (1 - c) * f * sin_az * (sig + c * sin_sig * (mid + c * cos_sig * (2 * mid**2 - 1)))
        change, lam = np.abs(new - lam), new
        if not (change > 1e-13).any():
            break
    k = cos2_az * (a * a - b * b) / (b * b)
    big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    inner = cos_sig * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_sig**2 - 3) * (4 * mid**2 - 3)
    dist = b * big_a * (sig - big_b * sin_sig * (mid + big_b / 4 * inner))
    bearing = np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl))
    settled = change < 1e-9
    return np.where(settled, dist, np.nan), np.where(settled, bearing, np.nan)


def geodesic(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, dist="dist_m", bearing="bear_d") -> DataFrame:
    """Add :func:`geodesic_inv` as two columns; null where a coordinate is missing."""
    whole = F.col(lon1).isNotNull() & F.col(lat1).isNotNull() & F.col(lon2).isNotNull() & F.col(lat2).isNotNull()
    df = df.withColumn("_geo", geodesic_inv(lon1, lat1, lon2, lat2))
    settled = whole & ~F.isnan("_geo.dist")
    return df.withColumns(
        {dist: F.when(settled, F.col("_geo.dist")), bearing: F.when(settled, F.col("_geo.bearing"))}
    ).drop("_geo")


def sphere_bearing(lon1, lat1, lon2, lat2) -> Column:
    """Forward azimuth on the sphere, degrees clockwise from north in (-180, 180]."""
    lon1, lat1, lon2, lat2 = map(col_of, (lon1, lat1, lon2, lat2))
    d = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))


def utm_xy(lon, lat, epsg) -> tuple[Column, Column]:
    """Easting and northing for EPSG 326xx / 327xx, by the Krüger series.

    ``epsg`` may be a number or a column, so feeds in different zones project
    in one pass.
    """
    lon, lat = col_of(lon), col_of(lat)
    epsg = epsg if isinstance(epsg, Column) else F.lit(epsg)
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # Krüger coefficients of the forward series to sixth order.
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    zone = F.pmod(epsg, F.lit(100))
    lam = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    k = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(s) - F.lit(k) * F.atanh(F.lit(k) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, coef in enumerate(alpha, start=1):
        north = north + coef * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + coef * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    scale = 0.9996 * radius
    false_north = F.when((epsg >= 32701) & (epsg <= 32760), 1e7).otherwise(0.0)
    return 5e5 + scale * east, false_north + scale * north


def lambert_xy(lon, lat, lat1=47.5, lat2=48 + 44 / 60, lat0=47.0, lon0=-(120 + 50 / 60), east0=5e5, north0=0.0):
    """Two-parallel conic easting and northing; the defaults are EPSG:32148."""
    lon, lat = col_of(lon), col_of(lat)
    e = math.sqrt(GRS80_F * (2 - GRS80_F))

    def m_of(p):
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t_of(p):
        s = e * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    n = (math.log(m_of(p1)) - math.log(m_of(p2))) / (math.log(t_of(p1)) - math.log(t_of(p2)))
    f = m_of(p1) / (n * t_of(p1) ** n)
    rho0 = WGS84_A * f * t_of(p0) ** n
    s = F.lit(e) * F.sin(F.radians(lat))
    t = F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho = F.lit(WGS84_A * f) * F.pow(t, F.lit(n))
    theta = F.lit(n) * F.radians(lon - lon0)
    return east0 + rho * F.sin(theta), north0 + rho0 - rho * F.cos(theta)


def project(df: DataFrame, lon: str, lat: str, epsg, x="x", y="y") -> DataFrame:
    """Local metres for a UTM code, a column of UTM codes, or EPSG 32148."""
    east, north = lambert_xy(lon, lat) if epsg == 32148 and not isinstance(epsg, Column) else utm_xy(lon, lat, epsg)
    return df.withColumns({x: east, y: north})


def center_xy(df: DataFrame, x: str, y: str, cx, cy) -> DataFrame:
    """Offset from the reference centre, the centre cut to whole metres."""
    cx, cy = (c if isinstance(c, Column) else F.lit(c) for c in (cx, cy))
    return df.withColumns({"x_cent": F.col(x) - cx.cast("int"), "y_cent": F.col(y) - cy.cast("int")})


def within_bounds(df: DataFrame, lon: str, lat: str, bounds: Sequence[float]) -> DataFrame:
    """Points inside (min_lon, min_lat, max_lon, max_lat), edges included."""
    return df.filter(F.col(lon).between(bounds[0], bounds[2]) & F.col(lat).between(bounds[1], bounds[3]))
