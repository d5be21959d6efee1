"""Distances, bearings, cell sizes and bounding boxes as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridair import constants as C


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * C.EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000.0


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, degrees clockwise from north in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance used between stations, the short way round the globe; the cosine is taken at point 1."""
    dy = (lat1 - lat2) * C.STATION_KM_LAT
    way = F.abs(lon1 - lon2)
    dx = F.when(way > 180.0, 360.0 - way).otherwise(way) * C.STATION_KM_LON * F.cos(F.radians(lat1))
    return F.sqrt(dy * dy + dx * dx)


def pixel_dx_m(west: Column, north: Column, res: Column, height: Column) -> Column:
    """Cell width in metres at the central latitude of the grid."""
    return res * C.GRID_M_LON * F.cos(F.radians(north - height * res / 2))


def pixel_dy_m(res: Column) -> Column:
    return res * C.GRID_M_LAT


def cell_lon(west: Column, res: Column, col: Column) -> Column:
    return west + res * (col + F.lit(0.5))


def cell_lat(north: Column, res: Column, row: Column) -> Column:
    return north - res * (row + F.lit(0.5))


def parse_bbox(text: Column) -> Column:
    """'west,south,east,north' -> struct; null unless four numbers with east > west and north > south."""
    parts = F.split(text, ",")
    vals = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    w, s, e, n = (F.try_element_at(vals, F.lit(i)) for i in (1, 2, 3, 4))
    ok = (F.size(parts) == 4) & (e > w) & (n > s)
    return F.when(ok, F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north")))


def _digits(step: float) -> int:
    """Decimals of a step."""
    return max(0, -Decimal(str(step)).normalize().as_tuple().exponent)


def snap_down(v: Column, step: float = 0.05) -> Column:
    """Largest multiple of ``step`` not above ``v`` (1e-9 tolerance for values already on the lattice)."""
    return F.round(F.floor((v + 1e-9) / step) * step, _digits(step))


def snap_up(v: Column, step: float = 0.05) -> Column:
    return F.round(F.ceil((v - 1e-9) / step) * step, _digits(step))
