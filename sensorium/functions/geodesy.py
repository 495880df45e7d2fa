"""Drawing coordinates to metres and degrees, as expressions: UTM by the Krüger series on the WGS84 ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and UTM.
A, FLAT, K0, FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def to_utm(lat: Column, lon: Column, zone: int = 31) -> Column:
    """Easting and northing (northern half) of degrees."""
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(zone * 6 - 183)
    e = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((FALSE_EAST + K0 * RADIUS * east).alias("east"), (K0 * RADIUS * north).alias("north"))


def from_utm(east: Column, north: Column, zone: int = 31) -> Column:
    """Degrees (lat, lon) of easting and northing."""
    xi, eta = north / (K0 * RADIUS), (east - FALSE_EAST) / (K0 * RADIUS)
    x, y = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183)).alias("lon"))


def placed(points: Column, width: float, height: float, east: float, north: float, metres_wide: float, metres_high: float, heading: float) -> Column:
    """Points of a drawing (y down) in metres: scaled to the building's sides, turned by its heading, and moved so
    that the drawing's lower left corner comes to (east, north)."""
    c, s = math.cos(math.radians(heading)), math.sin(math.radians(heading))

    def one(p: Column) -> Column:
        x, y = p.x / width * metres_wide, (height - p.y) / height * metres_high
        return F.struct((east + x * c + y * s).alias("x"), (north - x * s + y * c).alias("y"))

    return F.transform(points, one)
