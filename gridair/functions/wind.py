"""Wind speed, direction and compass columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridair.functions.units import clip

# Compass names clockwise from north.
COMPASS_8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
COMPASS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def from_deg(u: Column, v: Column) -> Column:
    """Direction the wind blows from, degrees."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def to_deg(u: Column, v: Column) -> Column:
    """Direction the wind blows to, degrees."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 360.0, F.lit(360.0))


def compass_index(deg: Column, points: int = 8) -> Column:
    width = 360.0 / points
    return F.floor((F.pmod(deg, F.lit(360.0)) + width / 2) / width).cast("int") % points


def compass(deg: Column, points: int = 8) -> Column:
    names = COMPASS_8 if points == 8 else COMPASS_16
    return F.element_at(F.array(*[F.lit(n) for n in names]), compass_index(deg, points) + 1)


def diurnal_u(hour: Column) -> Column:
    """Eastward wind of the idealised diurnal cycle."""
    return F.lit(4.5) + 2.5 * F.cos(hour * (2 * math.pi / 24.0))


def diurnal_v(hour: Column) -> Column:
    return F.lit(3.0) + 1.8 * F.sin(hour * (2 * math.pi / 24.0))


def estimate_blh(t2m_k: Column, u: Column, v: Column) -> Column:
    """Bulk boundary-layer height (m) from temperature (K) and wind."""
    value = F.lit(250.0) + 35.0 * clip(t2m_k - 273.15, 0.0, 45.0) + 90.0 * speed(u, v)
    return clip(value, 200.0, 3000.0)
