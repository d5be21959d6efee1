"""Hazard bands, status, severity and other threshold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridair import constants as C


def _in_band(v: Column, band: dict) -> Column:
    upper = F.lit(True) if band["max"] == float("inf") else v < band["max"]
    return (v >= band["min"]) & upper


def hazard_band(v: Column, attribute: str = "category") -> Column:
    """Label, key, colour or advice of the band [min, max) holding ``v``; outside all bands: the first."""
    out = F.lit(C.HAZARD_BANDS[0][attribute])
    for b in C.HAZARD_BANDS[1:]:
        out = F.when(_in_band(v, b), F.lit(b[attribute])).otherwise(out)
    return out


def hazard_code(v: Column) -> Column:
    """Band code 1..4; 0 for values outside all bands or missing."""
    out = F.lit(0)
    for b in C.HAZARD_BANDS:
        out = F.when(_in_band(v, b), F.lit(b["code"])).otherwise(out)
    return out.cast("int")


def display_band(v: Column) -> Column:
    """The web layer's variant of the bands: the upper bound belongs to the band."""
    return (F.when(v <= 40.0, "Normal").when(v <= 80.0, "Moderate").when(v <= 180.0, "Unhealthy")
            .otherwise("Hazardous"))


def classify_status(mean: Column, share_above: Column) -> Column:
    return (F.when(mean > C.HAZARDOUS, "critical_spike").when(mean > C.NAAQS_24H, "critical")
            .when((mean > 40.0) | (share_above >= 0.05), "elevated").otherwise("normal"))


def pct_vs(v: Column, standard: float) -> Column:
    return (v - standard) / standard * 100.0


def acceptance(r2: Column, rmse: Column, min_r2: float = 0.6, max_rmse: float = 15.0) -> Column:
    return F.coalesce((r2 >= min_r2) & (rmse <= max_rmse), F.lit(False))


def severity(v: Column, scheme: str = "map") -> Column:
    """Hotspot severity; ``map`` splits at 300 / 200, ``simulator`` at 180 / 80 / 40."""
    if scheme == "map":
        return F.when(v >= 300.0, "CRITICAL").when(v >= 200.0, "HIGH").otherwise("ELEVATED")
    if scheme == "simulator":
        return F.when(v > 180.0, "critical").when(v > 80.0, "high").when(v > 40.0, "moderate").otherwise("compliant")
    raise ValueError(f"unknown severity scheme {scheme!r}")


def severity_label(mean: Column) -> Column:
    """Severity word of an area mean used by the decision rules."""
    return (F.when(mean > C.HAZARDOUS, "hazardous").when(mean > C.NAAQS_24H, "critical").when(mean > 40.0, "elevated")
            .otherwise("normal"))


def haze_class(index: Column) -> Column:
    return (F.when(index < 0.30, "clear").when(index < 0.45, "light").when(index < 0.60, "moderate")
            .when(index.isNotNull(), "dense"))


def clamp_index(index: Column) -> Column:
    """A client-supplied haze index limited to [0, 1]."""
    return F.when(index.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), index)))


def health_level(v: Column) -> Column:
    return F.when(v <= 25.0, "good").when(v <= 80.0, "moderate").when(v <= 180.0, "poor").otherwise("severe")


def compliance_status(peak: Column) -> Column:
    return F.when(peak > C.HAZARDOUS, "CRITICAL").when(peak > C.NAAQS_24H, "EXCEEDANCE").otherwise("COMPLIANT")
