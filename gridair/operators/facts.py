"""Area facts per day: summaries, exposure, likely sources, alerts, haze and request resolution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import bands, dates, geo
from gridair.functions.arrays import labels
from gridair.functions.quantiles import exact_quantiles
from gridair.operators.cells import pixel_size
from gridair.schemas import DAY_KEY

SOURCE_LAYERS = ("road_density", "night_lights", "ghsl_built", "power_plants")


def share(cond: Column, value: str = "no2") -> Column:
    """Share of the valid cells that meet ``cond``; 0 without valid cells."""
    return F.coalesce(F.avg(F.when(F.col(value).isNotNull(), cond.cast("double"))), F.lit(0.0))


def area_summary(cells: DataFrame, grids: DataFrame, value: str = "no2") -> DataFrame:
    """One row per area and day: mean, median, p95, maximum and its place, shares above the limits and per
    band, status, and the period's mean against the annual limit.

    All means, maxima and shares come from one partial aggregation; quantiles from the two-step exact one.
    """
    v = F.col(value)
    day = cells.groupBy(*DAY_KEY).agg(
        F.avg(v).alias("mean"), F.max(v).alias("max"),
        F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))).alias("_top"),
        share(v > C.NAAQS_24H, value).alias("share_above_naaqs"), share(v > C.WHO_24H, value).alias("share_above_who"),
        *[share(bands.hazard_code(v) == b["code"], value).alias(f"share_{b['key']}") for b in C.HAZARD_BANDS])
    q = exact_quantiles(cells, list(DAY_KEY), value, {"median": 0.5, "p95": 0.95})
    window = cells.groupBy("area_id").agg(F.avg(v).alias("window_mean"))
    g = grids.select("area_id", "west", "north", "res")
    out = (day.join(q, list(DAY_KEY), "left").join(window, "area_id").join(g, "area_id", "left")
           .withColumn("max_row", -F.col("_top.r")).withColumn("max_col", -F.col("_top.c"))
           .withColumn("max_lat", F.round(geo.cell_lat(F.col("north"), F.col("res"), F.col("max_row")), 4))
           .withColumn("max_lon", F.round(geo.cell_lon(F.col("west"), F.col("res"), F.col("max_col")), 4)))
    return (out.withColumn("status", bands.classify_status(F.col("mean"), F.col("share_above_naaqs")))
            .withColumn("band", bands.hazard_band(F.col("mean"), "key"))
            .withColumn("pct_vs_naaqs", bands.pct_vs(F.col("mean"), C.NAAQS_24H))
            .withColumn("pct_vs_annual", bands.pct_vs(F.col("window_mean"), C.NAAQS_ANNUAL))
            .drop("_top", "west", "north", "res"))


def population_exposure(cells: DataFrame, static: DataFrame, grids: DataFrame, value: str = "no2") -> DataFrame:
    """People per band and above the limits, and the population-weighted mean, per area and day."""
    px = pixel_size(grids)
    people = (static.join(px, "area_id").select(
        "area_id", "row", "col", (F.greatest(F.coalesce("population", F.lit(0.0)), F.lit(0.0))
                                  * F.col("dx_m") * F.col("dy_m") / C.GHSL_CELL_M2).alias("_p")))
    j = cells.where(F.col(value).isNotNull()).join(people, ["area_id", "row", "col"])
    v, p = F.col(value), F.col("_p")
    where = lambda cond: F.sum(F.when(cond, p).otherwise(F.lit(0.0)))
    g = j.groupBy(*DAY_KEY).agg(
        F.sum(p).alias("total"), *[where(bands.hazard_code(v) == b["code"]).alias(f"people_{b['key']}") for b in C.HAZARD_BANDS],
        where(v > C.NAAQS_24H).alias("above_naaqs"), where(v > C.WHO_24H).alias("above_who"), F.sum(p * v).alias("_pv"))
    return (g.where(F.col("total") > 0).withColumn("share_above_naaqs", F.col("above_naaqs") / F.col("total"))
            .withColumn("share_above_who", F.col("above_who") / F.col("total"))
            .withColumn("weighted_mean", F.col("_pv") / F.col("total")).drop("_pv"))


def layer_thresholds(static: DataFrame, layers: tuple[str, ...] = SOURCE_LAYERS) -> DataFrame:
    """80th and 90th percentile of every layer per area, as columns ``<layer>_p80`` and ``<layer>_p90``."""
    long = static.select("area_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("layer"), F.coalesce(F.col(n), F.lit(0.0)).alias("v")) for n in layers])).alias("_l")).select(
        "area_id", "_l.layer", "_l.v")
    q = exact_quantiles(long, ["area_id", "layer"], "v", {"p80": 0.8, "p90": 0.9})
    return q.groupBy("area_id").agg(*[
        F.max(F.when(F.col("layer") == n, F.col(p))).alias(f"{n}_{p}") for n in layers for p in ("p80", "p90")])


def source_tags(static: DataFrame, layers: tuple[str, ...] = SOURCE_LAYERS) -> DataFrame:
    """Likely sources per pixel from its (smoothed) layers: ``tags``, 'background' when nothing stands out."""
    j = static.join(layer_thresholds(static, layers), "area_id")
    at = lambda n, p: F.coalesce(F.col(n), F.lit(0.0)) >= F.col(f"{n}_{p}")
    tags = labels(
        (at("road_density", "p80"), "traffic"),
        (F.coalesce("power_plants", F.lit(0.0)) >= F.greatest(F.col("power_plants_p90"), F.lit(math.log1p(50.0))), "power_plant"),
        (at("night_lights", "p80") & at("ghsl_built", "p80"), "dense_urban"))
    return (j.withColumn("tags", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("background"))))
            .drop(*[f"{n}_{p}" for n in layers for p in ("p80", "p90")]))


def forecast_alerts(horizons: DataFrame, current: DataFrame) -> DataFrame:
    """The alert of each area and day from ``horizons(.., hours, share, max)`` and ``current(.., share_now)``."""
    h = F.col("hours")
    high = F.col("share") >= 0.05
    g = horizons.groupBy(*DAY_KEY).agg(
        F.count("*").alias("_n"), F.count_if(high).alias("_k"), F.max_by("share", h).alias("_last"), F.max(h).alias("_lasth"),
        F.min(F.when(high, F.struct(h.alias("h"), F.col("share").alias("s")))).alias("_first"),
        F.min(F.when(F.col("max") > C.NAAQS_24H, F.struct(h.alias("h"), F.col("share").alias("s")))).alias("_peak"))
    now = F.col("share_now")
    j = current.join(g, list(DAY_KEY))
    persisting = (now >= 0.05) & (F.col("_k") == F.col("_n"))
    expected = (now < 0.05) & (F.col("_k") > 0)
    improving = (now >= 0.05) & (F.col("_last") < now - 0.05)

    def pick(a, b, c, d, e) -> Column:
        return (F.when(persisting, a).when(expected, b).when(improving, c).when(F.col("_peak").isNotNull(), d).otherwise(e))

    lit = F.lit
    return j.select(
        *DAY_KEY, pick(lit("persisting"), lit("exceedance_expected"), lit("improving"), lit("localized_peak"), lit("no_exceedance")).alias("code"),
        pick(lit("critical"), lit("warning"), lit("info"), lit("warning"), lit("info")).alias("level"),
        pick(lit(24), F.col("_first.h"), lit(24), F.col("_peak.h"), lit(24)).alias("hours"),
        pick(F.col("_last"), F.col("_first.s"), F.col("_last"), F.col("_peak.s"), lit(0.0)).alias("share"))


def point_verdict(df: DataFrame, value: str = "value", horizons: str = "horizons") -> DataFrame:
    """Health level, multiple of the WHO value and direction of the coming hours at a point."""
    v = F.col(value)
    peak = F.greatest(v, F.array_max(horizons))
    last = F.try_element_at(F.col(horizons), F.lit(-1))
    direction = F.when(peak > v * 1.1, "rising").when(last < v * 0.9, "easing").otherwise("steady")
    return (df.withColumn("level", bands.health_level(v)).withColumn("who_multiple", v / C.WHO_24H)
            .withColumn("peak", peak).withColumn("advice_level", bands.health_level(peak)).withColumn("direction", direction))


def haze_summary(readings: DataFrame, now: Column, hours: int = 72, keys: tuple[str, ...] = ()) -> DataFrame:
    """Latest reading, count, mean and maximum of the last ``hours``; all of them, however many arrived."""
    recent = readings.where((F.col("ts") >= now - F.expr(f"interval {hours} hours")) & (F.col("ts") <= now))
    x = F.col("haze_index")
    return (recent.groupBy(*keys).agg(
        F.max(F.struct("ts", "haze_index")).alias("_l"), F.count("*").alias("n"), F.round(F.avg(x), 3).alias("mean"),
        F.round(F.max(x), 3).alias("max"))
        .select(*keys, F.col("_l.ts").alias("latest_ts"), F.col("_l.haze_index").alias("latest_index"),
                bands.haze_class(F.col("_l.haze_index")).alias("latest_class"), "n", "mean", "max"))


def resolve_request(df: DataFrame, today: Column) -> DataFrame:
    """Day to use and product for requests with an optional ``day``."""
    use = dates.usable_day(F.col("day"), today)
    return df.withColumn("use_day", use).withColumn("product", dates.product_choice(F.col("use_day"), today))
