"""Global grid operators: latest mosaic, bilinear samples, border fluxes, ambient mass, gateways, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import units, wind
from gridair.functions.quantiles import exact_quantiles
from gridair.operators.places import points_in_regions


# --------------------------------------------------------------------------------------------- snapshot
def latest_mosaic(obs: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Newest cloud-free value per cell of the last ``hours`` (3..72) with its age; ties take the larger value.

    ``max`` of a struct is a partial aggregate: one row per cell and task is shuffled.
    """
    window = max(3, min(72, hours))
    recent = obs.where(F.col("no2").isNotNull() & (F.col("cloud_fraction") < C.MAX_CLOUD_FRACTION)
                       & (F.col("ts") > now - F.expr(f"interval {window} hours")) & (F.col("ts") <= now))
    best = recent.groupBy("row", "col").agg(F.max(F.struct("ts", "no2", "u", "v")).alias("_b"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("_b.ts")) / 3600.0
    return best.select("row", "col", F.col("_b.no2").alias("no2"), F.col("_b.u").alias("u"), F.col("_b.v").alias("v"),
                       F.col("_b.ts").alias("ts"), age.alias("age_h"))


def snapshot_meta(mosaic: DataFrame, width: int, height: int) -> DataFrame:
    """Newest and oldest observation and the covered share of the grid."""
    return mosaic.agg(F.max("ts").alias("newest_obs"), F.min("ts").alias("oldest_obs"),
                      F.round(F.count("no2") / F.lit(float(width * height)), 3).alias("coverage"))


# --------------------------------------------------------------------------------------------- bilinear samples
def corner_table(cells: DataFrame, fields: list[str], width: int, height: int) -> DataFrame:
    """Per anchor cell the values of its four corners (``<field>_00 .. _11``), wrapping in longitude.

    The grid is the small side: its corners are gathered once here, so that sampling costs the points one
    equi-join and no aggregation.
    """
    roles = F.array(
        F.struct(F.lit("00").alias("k"), F.col("row").alias("r"), F.col("col").alias("c")),
        F.struct(F.lit("01").alias("k"), F.col("row").alias("r"), F.pmod(F.col("col") - 1, F.lit(width)).alias("c")),
        F.struct(F.lit("10").alias("k"), (F.col("row") - 1).alias("r"), F.col("col").alias("c")),
        F.struct(F.lit("11").alias("k"), (F.col("row") - 1).alias("r"), F.pmod(F.col("col") - 1, F.lit(width)).alias("c")),
        # the last row is its own southern neighbour
        F.struct(F.lit("10").alias("k"), F.when(F.col("row") == height - 1, F.col("row")).alias("r"), F.col("col").alias("c")),
        F.struct(F.lit("11").alias("k"), F.when(F.col("row") == height - 1, F.col("row")).alias("r"),
                 F.pmod(F.col("col") - 1, F.lit(width)).alias("c")))
    parts = cells.select(*fields, F.explode(roles).alias("_k")).where(F.col("_k.r") >= 0)
    return parts.groupBy(F.col("_k.r").alias("_r0"), F.col("_k.c").alias("_c0")).agg(*[
        F.max(F.when(F.col("_k.k") == k, F.col(f))).alias(f"{f}_{k}") for f in fields for k in ("00", "01", "10", "11")])


def sample_bilinear(points: DataFrame, cells: DataFrame, fields: list[str], res: float = 0.5) -> DataFrame:
    """Values of a global north-up grid at (lat, lon): bilinear, longitude wrapped, latitude clamped.  With a
    missing corner the mean of the present ones, with none 0."""
    width, height = int(round(360 / res)), int(round(180 / res))
    y = F.greatest(F.lit(0.0), F.least(F.lit(float(height - 1)), (F.lit(90.0) - F.col("lat")) / res))
    x = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / res
    p = (points.withColumn("_y", y).withColumn("_x", x).withColumn("_r0", F.floor("_y").cast("int"))
         .withColumn("_c0", F.pmod(F.floor("_x"), F.lit(width)).cast("int"))
         .withColumn("_fy", F.col("_y") - F.floor("_y")).withColumn("_fx", F.col("_x") - F.floor("_x")))
    j = p.join(corner_table(cells, fields, width, height), ["_r0", "_c0"], "left")
    fx, fy, one = F.col("_fx"), F.col("_fy"), F.lit(1.0)
    outs = []
    for f in fields:
        v00, v01, v10, v11 = (F.col(f"{f}_{k}") for k in ("00", "01", "10", "11"))
        line = (one - fy) * ((one - fx) * v00 + fx * v01) + fy * ((one - fx) * v10 + fx * v11)
        present = F.array_compact(F.array(v00, v01, v10, v11))
        mean = F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(present), F.lit(0))
        outs.append(F.coalesce(line, mean, F.lit(0.0)).alias(f))
    return j.select(*points.columns, *outs)


# --------------------------------------------------------------------------------------------- border flux
def segment_flux(segments: DataFrame, cells: DataFrame, res: float = 0.5) -> DataFrame:
    """Flux across border segments (lon1, lat1) -> (lon2, lat2): five samples each, inward normal to the left.

    Values are rounded to two decimals per segment, as the totals are sums of rounded segments.
    """
    mid = F.radians((F.col("lat1") + F.col("lat2")) / 2.0)
    s = (segments
         .withColumn("_dx", F.lit(C.EARTH_RADIUS_M) * F.radians(F.col("lon2") - F.col("lon1")) * F.greatest(F.lit(0.05), F.cos(mid)))
         .withColumn("_dy", F.lit(C.EARTH_RADIUS_M) * F.radians(F.col("lat2") - F.col("lat1")))
         .withColumn("len_m", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))))
    ids = ["region_id", "corridor_id", "segment_id"]
    at = (s.where(F.col("len_m") >= 1.0)
          .withColumn("_w", F.explode(F.array(*[F.lit(w) for w in (0.1, 0.3, 0.5, 0.7, 0.9)])))
          .select(*ids, (F.col("lon1") + F.col("_w") * (F.col("lon2") - F.col("lon1"))).alias("lon"),
                  (F.col("lat1") + F.col("_w") * (F.col("lat2") - F.col("lat1"))).alias("lat")))
    means = sample_bilinear(at, cells, ["no2", "u", "v"], res).groupBy(*ids).agg(
        F.avg("no2").alias("_no2"), F.avg("u").alias("_u"), F.avg("v").alias("_v"))
    zero = F.lit(0.0)
    j = s.join(means, ids, "left")
    safe = F.nullif("len_m", zero)
    normal = F.col("_u") * (-F.col("_dy") / safe) + F.col("_v") * (F.col("_dx") / safe)
    flux = F.greatest(zero, F.col("_no2")) * C.UMOL_TO_G_M2 * normal * F.col("len_m") * C.DAY_SECONDS * 1e-6
    two = lambda c: F.coalesce(F.round(c, 2), zero)
    return j.select(
        *ids, two(flux).alias("flux"), two(F.greatest(zero, flux)).alias("inflow"), two(F.greatest(zero, -flux)).alias("outflow"),
        two(F.col("_no2")).alias("mean_no2"), two(F.col("_u")).alias("mean_u"), two(F.col("_v")).alias("mean_v"),
        F.round(F.col("len_m") / 1000.0, 1).alias("len_km"),
        F.round((F.col("lon1") + F.col("lon2")) / 2.0, 4).alias("mid_lon"), F.round((F.col("lat1") + F.col("lat2")) / 2.0, 4).alias("mid_lat"))


def intensity(flux: Column, severe: float = 40.0, high: float = 20.0, moderate: float = 8.0) -> Column:
    f = F.abs(flux)
    return F.when(f > severe, "severe").when(f > high, "high").when(f > moderate, "moderate").otherwise("low")


def corridor_flux(segment_rows: DataFrame) -> DataFrame:
    """Corridor totals, mean wind and intensity from segment rows, with the corridor's share of all inflow."""
    g = segment_rows.groupBy("region_id", "corridor_id").agg(
        F.round(F.sum("inflow"), 2).alias("inflow"), F.round(F.sum("outflow"), 2).alias("outflow"),
        F.avg("mean_no2").alias("mean_no2"), F.avg("mean_u").alias("mean_u"), F.avg("mean_v").alias("mean_v"),
        F.avg("mid_lon").alias("mid_lon"), F.avg("mid_lat").alias("mid_lat"))
    total = g.groupBy("region_id").agg(F.sum("inflow").alias("_total"))
    u, v = F.col("mean_u"), F.col("mean_v")
    value = F.when(F.col("inflow") > F.col("outflow"), F.col("inflow")).otherwise(-F.col("outflow"))
    share = F.when(F.col("_total") > 0, F.round(F.col("inflow") / F.nullif("_total", F.lit(0.0)) * 100.0, 1)).otherwise(F.lit(0.0))
    return (g.join(total, "region_id").withColumn("net", F.round(F.col("inflow") - F.col("outflow"), 2))
            .withColumn("wind_speed", wind.speed(u, v)).withColumn("wind_from", wind.from_deg(u, v))
            .withColumn("wind_to", wind.to_deg(u, v)).withColumn("flux", value).withColumn("is_inflow", F.col("inflow") >= F.col("outflow"))
            .withColumn("intensity", intensity(F.col("flux"))).withColumn("share_pct", share).drop("_total"))


def rank_corridors(corridors: DataFrame) -> DataFrame:
    """Corridors of a region by inflow (largest first)."""
    w = Window.partitionBy("region_id").orderBy(F.desc("inflow"), "corridor_id")
    return corridors.withColumn("rank", F.row_number().over(w))


def ambient_mass(regions: DataFrame, cells: DataFrame, res: float = 0.5) -> DataFrame:
    """NO2 mass (t) in each box from 8 x 8 samples, at least 0.5, and what its lifetime turns over per day."""
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    at = (regions.withColumn("_i", k).withColumn("_j", k)
          .withColumn("lat", F.col("lat_min") + F.col("_i") * (F.col("lat_max") - F.col("lat_min")) / 7.0)
          .withColumn("lon", F.col("lon_min") + F.col("_j") * (F.col("lon_max") - F.col("lon_min")) / 7.0)
          .withColumn("_area", (F.col("lat_max") - F.col("lat_min")) * C.AMBIENT_M_PER_DEG / 7.0
                      * (F.col("lon_max") - F.col("lon_min")) * C.AMBIENT_M_PER_DEG
                      * F.cos(F.radians((F.col("lat_min") + F.col("lat_max")) / 2.0)) / 7.0)
          .select("region_id", "lat", "lon", "_area"))
    mass = F.sum(F.greatest(F.lit(0.0), F.col("no2")) * C.UMOL_TO_G_M2 * F.col("_area") * 1e-6)
    return (sample_bilinear(at, cells, ["no2"], res).groupBy("region_id")
            .agg(F.greatest(F.lit(0.5), mass).alias("ambient_mass"))
            .withColumn("turnover", F.col("ambient_mass") * (24.0 / C.TAU_DAYTIME_HOURS)))


def region_flux(corridors: DataFrame, mass: DataFrame) -> DataFrame:
    """Region totals with the external share, raw and limited to 12..88 % as it is displayed."""
    g = corridors.groupBy("region_id").agg(F.round(F.sum("inflow"), 2).alias("inflow"), F.round(F.sum("outflow"), 2).alias("outflow"))
    local = F.greatest(F.lit(5.0), F.col("turnover") - (F.col("inflow") - F.col("outflow")))
    raw = F.col("inflow") / (F.col("inflow") + local) * 100.0
    return (g.join(mass, "region_id").withColumn("net", F.round(F.col("inflow") - F.col("outflow"), 2))
            .withColumn("local_source", local).withColumn("external_raw_pct", raw)
            .withColumn("external_pct", units.clip(F.round(raw, 1), 12.0, 88.0)))


def gateway_flux(gateways: DataFrame, cells: DataFrame, res: float = 0.5) -> DataFrame:
    """Flux through gateways 10 km wide along the wind."""
    g = sample_bilinear(gateways, cells, ["no2", "u", "v"], res)
    speed = wind.speed(F.col("u"), F.col("v"))
    flux = F.round(F.greatest(F.lit(0.0), F.col("no2")) * C.UMOL_TO_G_M2 * speed * 10_000.0 * C.DAY_SECONDS * 1e-6, 1)
    return (g.withColumn("wind_speed", speed).withColumn("wind_to", wind.to_deg(F.col("u"), F.col("v")))
            .withColumn("flux", flux).withColumn("intensity", intensity(F.col("flux"), 35.0, 18.0, 6.0)))


def flux_arrows(corridors: DataFrame) -> DataFrame:
    """Arrow along the wind (``start`` / ``end``) and display arrow away from the region's middle per corridor.

    The display arrow points outward from the mean of the region's crossings; a crossing at the middle follows
    the wind.  ``weight`` grows with the flux up to 40 t/d.
    """
    centre = corridors.groupBy("region_id").agg(F.avg("mid_lon").alias("_clon"), F.avg("mid_lat").alias("_clat"))
    c = (corridors.join(centre, "region_id").withColumn("_cos", F.greatest(F.lit(0.2), F.cos(F.radians("_clat"))))
         .withColumn("weight", F.least(F.lit(1.0), F.abs("flux") / 40.0))
         .withColumn("_ex", (F.col("mid_lon") - F.col("_clon")) * F.col("_cos")).withColumn("_ny", F.col("mid_lat") - F.col("_clat"))
         .withColumn("_r", F.sqrt(F.col("_ex") * F.col("_ex") + F.col("_ny") * F.col("_ny"))))
    h = F.radians("wind_to")
    sign = F.when(F.col("is_inflow"), F.lit(-1.0)).otherwise(F.lit(1.0))
    central = F.col("_r") < 0.02
    safe = F.nullif("_r", F.lit(0.0))
    ex = F.when(central, sign * F.sin(h)).otherwise(F.col("_ex") / safe)
    ny = F.when(central, sign * F.cos(h)).otherwise(F.col("_ny") / safe)
    outer, inner = F.lit(1.1) + 0.9 * F.col("weight"), F.lit(-0.2)
    first = F.when(F.col("is_inflow"), outer).otherwise(inner)
    last = F.when(F.col("is_inflow"), inner).otherwise(outer)
    at = lambda d: F.struct((F.col("mid_lon") + ex * d / F.col("_cos")).alias("lon"), (F.col("mid_lat") + ny * d).alias("lat"))
    label = F.concat(F.col("corridor_id").cast("string"), F.lit(" · "), F.when(F.col("is_inflow"), "+").otherwise("−"),
                     F.format_number(F.abs("flux"), 1), F.lit(" t/d"))
    arrow = lambda s: F.struct((F.col("mid_lon") + s * 0.11 * F.sin(h)).alias("lon"),
                               (F.col("mid_lat") + s * 0.11 * F.cos(h)).alias("lat"))
    return c.select("region_id", "corridor_id", "weight", at(first).alias("display_start"), at(last).alias("display_end"),
                    arrow(-1.0).alias("start"), arrow(1.0).alias("end"), label.alias("label"))


def headline(regions: DataFrame) -> DataFrame:
    """One sentence per region on the share that came from outside."""
    text = F.format_string("%.0f%% of region %s's NO₂ today arrived from neighbouring jurisdictions.",
                           F.col("external_pct"), F.col("region_id").cast("string"))
    return regions.select("region_id", text.alias("headline"))


# --------------------------------------------------------------------------------------------- regions
def global_background(cells: DataFrame) -> Column:
    """Scalar: median of the observed cells, at least 1; 5 when nothing is observed.  All cells take part."""
    m = exact_quantiles(cells, [], "no2", {"m": 0.5})
    return F.coalesce(F.greatest(F.lit(1.0), m.scalar()), F.lit(5.0))


def region_stats(cells: DataFrame, vertices: DataFrame, res: float, step: float = 5.0) -> DataFrame:
    """Cells, seen cells, mean, maximum, ratio to the background and level of every region.

    ``cells(row, col, no2)`` has a row for every cell of the global grid, null where unobserved.
    """
    centred = (cells.withColumn("lat", F.lit(90.0) - (F.col("row") + F.lit(0.5)) * res)
               .withColumn("lon", F.lit(-180.0) + (F.col("col") + F.lit(0.5)) * res))
    inside = points_in_regions(centred.select("row", "col", "lat", "lon"), vertices, ["row", "col"], step)
    g = inside.join(cells, ["row", "col"]).groupBy("region_id").agg(
        F.count("*").alias("cells"), F.count("no2").alias("seen"), F.avg("no2").alias("mean"), F.max("no2").alias("max"))
    g = g.withColumn("background", global_background(cells)).withColumn("ratio", F.col("mean") / F.col("background"))
    enough = F.col("seen") / F.col("cells") >= 0.03
    level = F.when(enough & ((F.col("ratio") >= 2.2) | (F.col("max") >= F.col("background") * 8)), "high").when(
        enough & (F.col("ratio") >= 1.35), "elevated").otherwise("background")
    return g.withColumn("level", level)
