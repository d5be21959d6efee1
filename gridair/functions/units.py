"""Unit conversions, clipping, decay and quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridair import constants as C


def clip(x: Column, lo: float, hi: float) -> Column:
    """``x`` limited to [lo, hi]; missing stays missing (``greatest`` and ``least`` alone would give a bound)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def smoothstep(a: Column) -> Column:
    return a * a * (F.lit(3.0) - 2.0 * a)


def exp_decay(x: Column, scale: float) -> Column:
    return F.exp(-x / scale)


def column_to_surface(column: Column, blh: Column) -> Column:
    """Column (umol/m2) mixed over the boundary layer (m, at least 50) -> ug/m3."""
    return column * C.NO2_MOLAR_MASS_G / F.when(blh.isNotNull(), F.greatest(blh, F.lit(50.0)))


def lead_confidence(hours: Column, base: Column | float = 0.5) -> Column:
    """Confidence of a point forecast, decaying with lead hours (e-folding 24 h)."""
    start = base if isinstance(base, Column) else F.lit(float(base))
    value = start * F.exp(-hours / 24.0)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def frame_confidence(minutes: Column, mass_error: Column, base: float = 0.63) -> Column:
    """Confidence of a forecast frame: decays with real lead minutes and with the mass error."""
    kept = F.lit(1.0) - F.when(mass_error.isNotNull(), F.least(mass_error, F.lit(1.0)))
    value = F.lit(base) * F.exp(-minutes / 90.0) * kept
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


# Fixed values: (mean, deviation) of the forecast channels; the first group is on a log1p scale.
LOG_CHANNELS = ("no2", "prev_no2", "co", "blh", "population")
CHANNEL_STATS = {
    "no2": (0.0, 1.0), "prev_no2": (0.0, 1.0), "co": (0.0, 1.0), "wind_u": (0.0, 5.0), "wind_v": (0.0, 5.0),
    "wind_speed": (2.0, 3.0), "temp": (15.0, 12.0), "pressure": (900.0, 30.0), "humidity": (5.0, 5.0),
    "blh": (0.0, 1.0), "dem": (200.0, 500.0), "slope": (2.0, 5.0), "road_density": (0.0, 1.0),
    "built_up": (0.3, 0.3), "night_lights": (0.0, 1.0), "population": (0.0, 1.0), "power_plants": (0.0, 1.0),
}


def normalise_channel(name: str, x: Column) -> Column:
    """Channel value on the scale of the forecast samples; missing counts as zero."""
    mean, std = CHANNEL_STATS[name]
    v = F.coalesce(x, F.lit(0.0))
    if name in LOG_CHANNELS:
        v = F.log1p(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))))
    return (v - mean) / (std + 1e-8)


def overpass_utc_hour(lon: Column) -> Column:
    return F.pmod(F.lit(13.5) - lon / 15.0, F.lit(24.0))


def quantise(x: Column, scale: float) -> Column:
    """int16 steps of ``scale``; missing becomes -32768."""
    q = F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.bround(x / scale, 0)))
    return F.when(x.isNull(), F.lit(-32768)).otherwise(q.cast("int")).cast("smallint")


def dequantise(q: Column, scale: float) -> Column:
    return F.when(q != -32768, q * F.lit(float(scale)))


# Scale from accumulated to mean fluxes, (hourly, daily).
FLUX_SCALES = {"ssrd": (1 / 3600, 1 / 86400), "tp": (1000.0, 1000.0 / 24), "sshf": (1 / 3600, 1 / 86400)}


def scale_flux(name: str, x: Column, daily: bool = False) -> Column:
    """Accumulated flux -> W/m2 (ssrd, sshf) or mm/h (tp)."""
    return x * FLUX_SCALES[name][1 if daily else 0]


def ndvi(nir: Column, red: Column) -> Column:
    return safe_ratio(nir - red, nir + red)


def season_angle(day: Column) -> Column:
    return F.dayofyear(day) * (2 * math.pi / C.YEAR_DAYS)
