"""Sources: station files, downloaded sensor, POI and road payloads, dated paths, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridair.functions import arrays, dates, strings
from gridair.schemas import STATION_COLUMNS, STATION_COORDS, require_columns

MIN_HOUR_COMPLETENESS = 75.0


# --------------------------------------------------------------------------------------------- CSV and parquet
def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station CSV files: headers trimmed and lower-cased, required columns enforced, ``no2`` numeric or null.

    Only headers are read ahead; values stay text until cast, so that no file is scanned twice for types.
    """
    raw = spark.read.option("header", True).csv(path)
    df = require_columns(raw.toDF(*[c.strip().lower() for c in raw.columns]), STATION_COLUMNS, f"station file {path}")
    return df.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"),
                           "no2": F.col("no2").try_cast("double"), "ts": F.col("date").try_cast("timestamp_ntz")})


def read_station_coords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(STATION_COORDS).csv(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Long cell table; one grid per area and one value per cell and day are enforced."""
    from gridair.operators.cells import check_one_row_per_cell
    df = require_columns(spark.read.parquet(path), ("area_id", "day", "row", "col", "no2"), f"cell table {path}")
    return check_one_row_per_cell(df)


def with_path_date(df: DataFrame, path: str | None = None) -> DataFrame:
    """``day`` from the last date in the file path (or in column ``path``)."""
    return df.withColumn("day", dates.path_date(F.col(path) if path else F.input_file_name()))


# --------------------------------------------------------------------------------------------- sensor payloads
_HOUR = "value double, coverage struct<percentComplete: double>, period struct<datetimeFrom: struct<local: string>>"
_LOCATION = ("id bigint, name string, coordinates struct<latitude: double, longitude: double>, "
             "provider struct<name: string>, sensors array<struct<id: bigint, parameter: struct<id: int>>>")


def flatten_sensor_hours(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Hourly values of sensor payloads: nulls and hours with less than 75 % coverage are dropped; ``ts`` is the
    local start of the hour."""
    j = F.from_json(payload, _HOUR)
    rest = [c for c in payloads.columns if c != payload]
    complete = F.col("_j.coverage.percentComplete")
    local = F.replace(F.substring("_j.period.datetimeFrom.local", 1, 16), F.lit("T"), F.lit(" "))
    return (payloads.withColumn("_j", j).where(F.col("_j.value").isNotNull() & (complete.isNull() | (complete >= MIN_HOUR_COMPLETENESS)))
            .select(*rest, local.alias("date"), F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("ts"), F.col("_j.value").alias("no2")))


def flatten_sensors(locations: DataFrame, parameter: int, payload: str = "payload") -> DataFrame:
    """One row per sensor of the wanted parameter with its location's name and coordinates."""
    j = locations.select(F.from_json(payload, _LOCATION).alias("_j")).select("_j.*")
    return (j.select(F.col("id").alias("location_id"), "name", F.col("coordinates.latitude").alias("lat"),
                     F.col("coordinates.longitude").alias("lon"), F.col("provider.name").alias("provider"), F.explode("sensors").alias("_s"))
            .where(F.col("_s.parameter.id") == parameter)
            .select("location_id", F.col("_s.id").alias("sensor_id"), "name", "lat", "lon", "provider"))


def assemble_sensors(hours: DataFrame, sensors: DataFrame) -> DataFrame:
    """Station table from hourly values and the sensor catalogue."""
    cat = sensors.select("sensor_id", F.concat_ws("_", F.lit("OPENAQ"), F.col("location_id").cast("string"), F.col("sensor_id").cast("string")).alias("station_id"),
                         "name", "lat", "lon")
    return hours.select("sensor_id", "ts", "no2").join(cat, "sensor_id").select("station_id", "name", "lat", "lon", "ts", "no2")


# --------------------------------------------------------------------------------------------- report rows
def clean_report_rows(df: DataFrame, start: str = "from_date", value: str = "value") -> DataFrame:
    """Rows with a readable 'dd-MM-yyyy HH:mm' start and a numeric value ('NA' and blanks are dropped)."""
    rest = [c for c in df.columns if c not in (start, value)]
    ts = F.try_to_timestamp(F.trim(start), F.lit("dd-MM-yyyy HH:mm")).cast("timestamp_ntz")
    return df.select(*rest, ts.alias("ts"), F.trim(F.col(value)).try_cast("double").alias("no2")).dropna(subset=["ts", "no2"])


def match_coordinates(reports: DataFrame, coords: DataFrame, station: str = "station") -> DataFrame:
    """Report rows with coordinates by normalised station name, and the station's id."""
    c = (coords.withColumn("_n", strings.normalise_name(F.col("station_name"))).groupBy("_n")
         .agg(F.max_by(F.struct("lat", "lon"), "station_name").alias("_c")))
    return (reports.withColumn("_n", strings.normalise_name(F.col(station))).join(c, "_n")
            .withColumn("station_id", strings.slug(F.col(station))).withColumn("lat", F.col("_c.lat")).withColumn("lon", F.col("_c.lon"))
            .drop("_n", "_c"))


def skipped_stations(reports: DataFrame, coords: DataFrame, station: str = "station") -> DataFrame:
    """Stations of the reports that have no coordinates."""
    c = coords.select(strings.normalise_name(F.col("station_name")).alias("_n")).distinct()
    return (reports.select(station).distinct().withColumn("_n", strings.normalise_name(F.col(station)))
            .join(c, "_n", "left_anti").drop("_n"))


def dedupe_station_rows(df: DataFrame, rank: str = "file_rank", ts: str = "ts") -> DataFrame:
    """One row per station and time: the one of the first file.  ``min_by`` combines before the shuffle."""
    others = [c for c in df.columns if c not in ("station_id", ts)]
    best = df.groupBy("station_id", ts).agg(F.min(F.struct(rank, *[c for c in others if c != rank])).alias("_b"))
    return best.select("station_id", ts, *[F.col(f"_b.{c}").alias(c) for c in others])


# --------------------------------------------------------------------------------------------- POI and roads
_ELEMENT = ("type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, "
            "tags map<string,string>, geometry array<struct<lat: double, lon: double>>")


def tag(name: str, tags: str = "tags") -> Column:
    """Value of a tag; empty text counts as absent."""
    return F.nullif(F.try_element_at(F.col(tags), F.lit(name)), F.lit(""))


def classify_poi(df: DataFrame) -> DataFrame:
    """``category``, ``factor``, ``details`` and ``name`` from the tags of a point element."""
    plant = F.coalesce(tag("power") == "plant", F.lit(False))
    works = F.coalesce(tag("man_made") == "works", F.lit(False))
    text = lambda pre, v, post: F.when(v.isNotNull(), F.concat(F.lit(pre), v, F.lit(post))).otherwise("")
    kind = F.nullif(tag("industrial"), F.lit("yes"))
    detail = (F.when(plant, F.concat(F.lit("Power plant"), text(" (", F.coalesce(tag("plant:source"), tag("generator:source")), ")"),
                                     text(", ", tag("plant:output:electricity"), ""), F.lit(".")))
              .when(works, F.concat(F.lit("Factory / works"), text(": ", tag("product"), ""), F.lit(".")))
              .otherwise(F.concat(F.lit("Industrial area"), text(" (", F.replace(kind, F.lit("_"), F.lit(" ")), ")"), F.lit("."))))
    fallback = F.when(plant, "Power plant").otherwise("Industrial site")
    return (df.withColumn("category", F.when(plant, "POWER_PLANT").otherwise("FACTORY"))
            .withColumn("factor", F.when(plant, 0.9).when(works, 0.7).otherwise(0.6))
            .withColumn("details", F.concat(detail, F.lit(" Source: OpenStreetMap.")))
            .withColumn("name", F.coalesce(tag("name:en"), tag("name"), fallback)))


def parse_elements(elements: DataFrame, payload: str = "payload") -> DataFrame:
    return elements.select(F.from_json(payload, _ELEMENT).alias("_e")).select("_e.*")


def poi_points(parsed: DataFrame) -> DataFrame:
    """Typed point rows; elements without coordinates are dropped."""
    p = (parsed.where(F.col("geometry").isNull())
         .withColumn("lat", F.coalesce("lat", "center.lat")).withColumn("lon", F.coalesce("lon", "center.lon"))
         .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    return classify_poi(p).select(F.concat_ws("-", F.lit("osm"), "type", F.col("id").cast("string")).alias("id"), "name", "category",
                                  "lat", "lon", "factor", "details")


def poi_lines(parsed: DataFrame) -> DataFrame:
    """Typed line rows with simplified paths; lines of fewer than two vertices are dropped."""
    g = parsed.where(F.size(F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>"))) >= 2)
    rounded = F.transform(arrays.simplify_line(F.col("geometry")), lambda v: F.struct(F.round(v["lat"], 5).alias("lat"), F.round(v["lon"], 5).alias("lon")))
    rail = F.map_contains_key("tags", "railway")
    way = tag("highway")
    kind = F.when(rail, "railway").otherwise(F.coalesce(way, F.lit("road")))
    factor = F.when(rail, 0.5).when(way == "motorway", 0.85).otherwise(0.7)
    return g.select(F.concat(F.lit("osm-way-"), F.col("id").cast("string")).alias("id"),
                    F.coalesce(tag("name:en"), tag("name"), tag("ref"), F.initcap(kind)).alias("name"), kind.alias("kind"), factor.alias("factor"), rounded.alias("path"))


def parse_roads(parsed: DataFrame) -> DataFrame:
    """Road rows with their class ('_link' removed); other elements and short ways are dropped."""
    g = parsed.where((F.col("type") == "way") & (F.size(F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>"))) >= 2))
    return g.select("id", F.replace(F.coalesce(tag("highway"), F.lit("")), F.lit("_link"), F.lit("")).alias("highway"), F.col("geometry").alias("path"))


def latest_version(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of every key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return runs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")
