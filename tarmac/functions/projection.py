"""Longitude and latitude to and from the state-plane grid EPSG:2278 (Lambert conformal conic, two parallels).

Closed-form column expressions on the GRS 1980 ellipsoid; distances in US survey feet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public EPSG entry.
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
PARALLEL_1, PARALLEL_2 = 28.0 + 23.0 / 60.0, 30.0 + 17.0 / 60.0
ORIGIN_LAT, ORIGIN_LON = 27.0 + 50.0 / 60.0, -99.0
FALSE_EAST_M, FALSE_NORTH_M = 600000.0, 4000000.0
FOOT_M = 1200.0 / 3937.0

_F = 1 / INVERSE_FLATTENING
_E = math.sqrt(2 * _F - _F * _F)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


_P1, _P2, _P0 = (math.radians(x) for x in (PARALLEL_1, PARALLEL_2, ORIGIN_LAT))
_N = (math.log(_m(_P1)) - math.log(_m(_P2))) / (math.log(_t(_P1)) - math.log(_t(_P2)))
_K = _m(_P1) / (_N * _t(_P1) ** _N)
_R0 = SEMI_MAJOR_M * _K * _t(_P0) ** _N


def to_feet(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of a longitude and latitude in degrees."""
    phi = F.radians(lat)
    s = _E * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    r = SEMI_MAJOR_M * _K * F.pow(t, F.lit(_N))
    theta = _N * F.radians(lon - ORIGIN_LON)
    return (FALSE_EAST_M + r * F.sin(theta)) / FOOT_M, (FALSE_NORTH_M + _R0 - r * F.cos(theta)) / FOOT_M


# Coefficients of sin(2k chi) in the series that gives the latitude from the conformal latitude chi.
_E2 = _E * _E
_SERIES = (
    _E2 / 2 + 5 * _E2**2 / 24 + _E2**3 / 12 + 13 * _E2**4 / 360,
    7 * _E2**2 / 48 + 29 * _E2**3 / 240 + 811 * _E2**4 / 11520,
    7 * _E2**3 / 120 + 81 * _E2**4 / 1120,
    4279 * _E2**4 / 161280,
)


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing, by a series (error under 1e-10 degrees)."""
    east, north = x * FOOT_M - FALSE_EAST_M, _R0 - (y * FOOT_M - FALSE_NORTH_M)
    chi = math.pi / 2 - 2 * F.atan(F.pow(F.hypot(east, north) / (SEMI_MAJOR_M * _K), F.lit(1 / _N)))
    phi = chi
    for k, c in enumerate(_SERIES):
        phi = phi + c * F.sin((2 * k + 2) * chi)
    return F.degrees(F.atan2(east, north) / _N) + ORIGIN_LON, F.degrees(phi)


def project_line(points: Column, inverse: bool = False) -> Column:
    """All points of a line, to feet (or, if ``inverse``, to degrees)."""
    to = to_degrees if inverse else to_feet

    def moved(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, moved)
