"""Column contracts of the domain tables and the check that enforces them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STATION_COLUMNS = ("station_id", "lat", "lon", "date", "no2")
STATION_HOUR_COLUMNS = ("station_id", "lat", "lon", "ts", "no2")
CELL_KEY = ("area_id", "day", "row", "col")
PIXEL_KEY = ("area_id", "row", "col")
DAY_KEY = ("area_id", "day")
GRID_COLUMNS = ("area_id", "west", "north", "res", "width", "height")

STATION_COORDS = T.StructType([
    T.StructField("station_name", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])
HAZE_READING = T.StructType([
    T.StructField("haze_index", T.DoubleType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("source", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])
STATION_HOUR = T.StructType([
    T.StructField("station_id", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("ts", T.TimestampType()),
    T.StructField("no2", T.DoubleType()),
])


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """Fail when a required column is absent; returns ``df`` so that calls can be chained."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df
