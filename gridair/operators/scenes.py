"""Satellite scenes: indices, scene choice, overpass weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import units


def surface_indices(df: DataFrame) -> DataFrame:
    """Vegetation index and built-up flag from bands b4, b8, b11; null under cloud, shadow or snow classes."""
    ndvi = units.safe_ratio(F.col("b8") - F.col("b4"), F.col("b8") + F.col("b4"))
    ndbi = units.safe_ratio(F.col("b11") - F.col("b8"), F.col("b11") + F.col("b8"))
    clear = ~F.col("scl").isin(*C.MASKED_SCENE_CLASSES)
    return (df.withColumn("ndvi", F.when(clear, ndvi))
            .withColumn("built_up", F.when(clear & ndvi.isNotNull() & ndbi.isNotNull(),
                                           ((ndbi > 0) & (ndvi < 0.3)).cast("double"))))


def best_scenes(scenes: DataFrame, end: str, keep: int = 8) -> DataFrame:
    """The ``keep`` clearest complete scenes of every tile in the twelve months up to ``end``.

    The rank is limited per tile, which Spark applies before and after the shuffle.
    """
    last = F.lit(end).cast("date")
    ok = ((F.col("cloud_pct") < 20) & (F.col("nodata_pct") < 10) & (F.col("day") >= F.date_sub(last, 365))
          & (F.col("day") <= last))
    w = Window.partitionBy("tile").orderBy("cloud_pct", "scene_id")
    return scenes.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def overpass_weather(hourly: DataFrame, daily: DataFrame, keys: list[str], value: str, half_window_h: float = 1.5,
                     hour: str = "overpass_hour") -> DataFrame:
    """Mean of the readings within the overpass window per key and day; days without any take the daily value."""
    offset = (F.unix_timestamp("ts") - F.unix_timestamp(F.to_date("ts").cast("timestamp"))) / 3600.0
    inside = (offset >= F.col(hour) - half_window_h) & (offset < F.col(hour) + half_window_h)
    near = (hourly.where(inside).groupBy(*keys, F.to_date("ts").alias("day")).agg(F.avg(value).alias("_w")))
    return (daily.join(near, [*keys, "day"], "left")
            .select(*keys, "day", F.coalesce("_w", value).alias(value), F.col("_w").isNull().alias("fallback")))
