"""Distance joins and radius aggregates without cross joins.

Points and sources meet in latitude / longitude buckets.  ``within_radius`` is the plain bucket join for
results that list the pairs themselves.  ``radius_mean`` and ``radius_sum`` never list pairs that lie in
buckets wholly inside the radius: such buckets contribute their pre-aggregated totals, so that a crowded place
costs one row per bucket and not one row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import geo

def _bucket(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _east(lon: Column) -> Column:
    """Degrees east of the date line, from 0 to below 360."""
    return F.pmod(lon + 180.0, F.lit(360.0))


def _bands(km: float) -> tuple[float, int]:
    """Height in degrees and number of the latitude bands from pole to pole that no radius of ``km`` can leap over."""
    height = km * 1.01 / C.STATION_KM_LAT
    return height, math.ceil(180.0 / height)


def _cells(band: Column, height: float, km: float) -> Column:
    """Cells around the globe in a band: each as wide as the radius is anywhere in the band or the next one to the pole."""
    farthest = F.greatest(F.abs((band - 1) * height - 90.0), F.abs((band + 2) * height - 90.0))
    width = km * 1.01 / C.STATION_KM_LON / F.cos(F.radians(farthest))
    return F.when(farthest >= 90.0, 1).otherwise(F.greatest(F.lit(1), F.floor(360.0 / width))).cast("long")


def within_radius(points: DataFrame, sources: DataFrame, km: float, *, lat: str = "lat", lon: str = "lon",
                  src_lat: str = "src_lat", src_lon: str = "src_lon",
                  condition: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """All (point, source) rows that may lie within ``km``; callers filter by their own exact distance.

    The globe is cut into latitude bands, each with cells of its own width that go round it: fewer towards the poles, one
    at them, and the last beside the first at the date line.  Sources are repeated into the cells around them in their own
    band and the two beside it, and joined on band and cell.  Rows without coordinates have no partner.
    """
    height, n = _bands(km)
    band = lambda c: F.least(_bucket(F.col(c) + 90.0, height), F.lit(n - 1))
    cell = lambda c, b: F.least(F.floor(_east(F.col(c)) * _cells(b, height, km) / 360.0).cast("long"), _cells(b, height, km) - 1)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = points.withColumn("_by", band(lat)).withColumn("_bx", cell(lon, F.col("_by")))
    s = (sources.withColumn("_sy", F.explode(F.transform(near, lambda i: band(src_lat) + i))).where((F.col("_sy") >= 0) & (F.col("_sy") < n))
         .withColumn("_around", _cells(F.col("_sy"), height, km)).withColumn("_mid", cell(src_lon, F.col("_sy")))
         .withColumn("_sx", F.explode(F.array_distinct(F.transform(near, lambda i: F.pmod(F.col("_mid") + i, F.col("_around")))))).drop("_around", "_mid"))
    on = (p["_by"] == s["_sy"]) & (p["_bx"] == s["_sx"])
    if condition is not None:
        on = on & condition(p, s)
    return p.join(s, on).drop("_by", "_bx", "_sy", "_sx")


def radius_mean(obs: DataFrame, sites: DataFrame, km: float, value: str, name: str,
                splits: int = 6) -> DataFrame:
    """Mean of ``value`` over other sites with 0 < distance < ``km`` on the same day, per site and day.

    ``sites(station_id, lat, lon)`` has one row per station.  Buckets are ``1 / splits`` of the radius.  A pair
    of buckets whose farthest corners are inside the radius contributes bucket-day totals; pairs that straddle
    the radius are settled site by site.  Of a site's own bucket the other places are added up from both ends, so
    that nothing is subtracted; readings at the very same coordinates don't count.

    Places and buckets meet in wide cells, day by day: a cell is twice as wide as the reach, so a bucket's day is sent
    to four of them.  Pairs are added up where they meet; what is shuffled grows with the readings, not with the pairs.
    """
    dy = km / C.STATION_KM_LAT / splits
    around_globe = max(1, math.floor(360.0 / dy))
    dx = 360.0 / around_globe
    src = sites.select("station_id", "lat", "lon").withColumn("_y", _bucket(F.col("lat"), dy)).withColumn(
        "_x", F.least(_bucket(_east(F.col("lon")), dx), F.lit(around_globe - 1)))
    # The station's own coordinates come from ``sites`` so that one station cannot sit in two buckets.
    rows = obs.select("station_id", "day", value).join(src, "station_id")
    known = F.when(~F.isnan(value), F.col(value))  # one NaN would reach all around
    zero, none = F.lit(0), F.lit(0.0)
    own = Window.partitionBy("_y", "_x", "day").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.orderBy("lat", "lon"), own.orderBy(F.desc("lat"), F.desc("lon"))
    beside = lambda c, of: sum((F.coalesce(F.sum(c).over(w), of) for w in ends), of)
    # A bucket is inside itself (its diagonal is far below the radius): its other places are those before and after the own one.
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_place = (rows.dropna(subset=["day", "lat", "lon"]).repartition(parts, "_y", "_x", "day").groupBy("_y", "_x", "day", "lat", "lon")
                .agg(F.sum(known).alias("_s"), F.count(known).alias("_c")))
    places = at_place.select("_y", "_x", "day", "lat", "lon", beside("_s", none).alias("_bs"), beside("_c", zero).alias("_bc"))
    place = F.struct(F.col("lat").alias("a"), F.col("lon").alias("o"), F.col("_s").alias("s"), F.col("_c").alias("c"))
    buckets = at_place.where(F.col("_c") > 0).groupBy(F.col("_y").alias("_ty"), F.col("_x").alias("_tx"), "day").agg(
        F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"), F.collect_list(place).alias("_q"))

    # Cells: a bucket's middle is at most half a bucket farther than its places.
    reach = 2 * km * (1 + 1 / splits)
    height, n = _bands(reach)
    at_y, at_x = (F.col("lat") + 90.0) / height, _east(F.col("lon")) / 360.0
    last = lambda c, size: F.greatest(F.lit(0), F.least(F.floor(c).cast("long"), size - 1))
    p = (places.withColumn("_by", last(at_y, F.lit(n))).withColumn("_bx", last(at_x * _cells(F.col("_by"), height, reach), _cells(F.col("_by"), height, reach)))
         .repartition(parts, "_by", "_bx", "day"))
    mid_y, mid_x = ((F.col("_ty") + 0.5) * dy + 90.0) / height, (F.col("_tx") + 0.5) * dx / 360.0
    halves = F.array(F.lit(-0.5), F.lit(0.5))
    round_it = _cells(F.col("_by"), height, reach)
    s = (buckets.withColumn("_by", F.explode(F.array_distinct(F.transform(halves, lambda h: last(mid_y + h, F.lit(n))))))
         .withColumn("_bx", F.explode(F.array_distinct(F.transform(halves, lambda h: F.pmod(F.floor(mid_x * round_it + h).cast("long"), round_it)))))
         .repartition(parts, "_by", "_bx", "day"))

    # Bounds of the distance between any two points of the buckets; the cosine is largest nearest the equator.
    low, high = F.abs(F.col("_y") * dy), F.abs((F.col("_y") + 1) * dy)
    lat_lo = F.when((F.col("_y") < 0) != (F.col("_y") + 1 <= 0), F.lit(0.0)).otherwise(F.least(low, high))
    wide = lambda lat: F.lit(dx * C.STATION_KM_LON) * F.cos(F.radians(lat))
    p = p.withColumn("_widest", wide(lat_lo)).withColumn("_least", wide(F.least(F.greatest(low, high), F.lit(90.0))))
    gap_y, straight = F.abs(F.col("_ty") - F.col("_y")), F.abs(F.col("_tx") - F.col("_x"))
    gap_x = F.least(straight, around_globe - straight)
    square = lambda c: c * c
    far = F.sqrt(square((gap_y + 1) * (dy * C.STATION_KM_LAT)) + square((gap_x + 1) * F.col("_widest")))
    close = F.sqrt(square(F.greatest(gap_y - 1, zero) * (dy * C.STATION_KM_LAT)) + square(F.greatest(gap_x - 1, zero) * F.col("_least")))
    inside = far < km * (1 - 1e-9)
    met = ((p["_by"] == s["_by"]) & (p["_bx"] == s["_bx"]) & (p["day"] == s["day"])
           & ((gap_y > 0) | (gap_x > 0)) & (inside | (close < km * (1 + 1e-9))))
    whole = F.struct(F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("o"), F.col("_ts").alias("s"), F.col("_tc").alias("c"))
    pairs = (p.join(s, met, "left").select(p["_by"], p["_bx"], p["day"], "lat", "lon", "_bs", "_bc", F.explode_outer(F.when(inside, F.array(whole)).otherwise(F.col("_q"))).alias("_o")))
    counts = F.col("_o.a").isNull() | (geo.flat_km(F.col("lat"), F.col("lon"), F.col("_o.a"), F.col("_o.o")) < km)
    found = pairs.groupBy("_by", "_bx", "day", "lat", "lon").agg(
        (F.coalesce(F.sum(F.when(counts, F.col("_o.s"))), none) + F.any_value("_bs")).alias("_total"),
        (F.coalesce(F.sum(F.when(counts, F.col("_o.c"))), zero) + F.any_value("_bc")).alias("_count"))
    days = obs.select("station_id", "day").distinct().join(src.select("station_id", "lat", "lon"), "station_id")
    count = F.coalesce("_count", zero)
    return (days.join(found.drop("_by", "_bx"), ["lat", "lon", "day"], "left")
            .select("station_id", "day", F.when(count > 0, F.col("_total") / F.nullif(count, zero)).alias(name),
                    count.alias("neighbours")))
