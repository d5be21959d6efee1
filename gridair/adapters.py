"""Domain tables derived from the given parquet tables.

One SQL text per domain table; it runs unchanged in Spark and in DuckDB, so that a query and its check start
from equal rows.  Every derived table grows with its source: areas and cities follow the supplier, part and
customer keys, so ten times the data is ten times as many areas, stations and points of interest.

Area ``k`` is a 13 x 10 grid of 0.035 degree cells; areas lie side by side, 300 to a row.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")


def _west(k: str) -> str:
    return f"(60E0 + 0.4E0 * ({k} % 300))"


def _north(k: str) -> str:
    return f"(30E0 - 0.5E0 * floor({k} / 300E0))"


def _k(expr: str) -> str:
    return f"CAST(floor({expr}) AS INT)"


_SUPP_AREA = _k("l_suppkey / 20E0")
_POI_AREA = _k("s_suppkey / 20E0")
_STATION = _k("o_custkey / 37E0")
_SCITY = _k("floor(o_custkey / 37E0) / 8E0")
_HCITY = _k("user_id / 30E0")
_PART_AREA = _k("p_partkey / 400E0")

# First day of the derived calendar.
EPOCH = "DATE '2024-01-01'"

ADAPTERS: dict[str, str] = {
    "stations_hourly": f"""
        SELECT concat('ST', CAST(user_id AS STRING)) AS station_id,
               {_north(_HCITY)} - 0.005E0 - ((user_id * 37) % 440) / 1000E0 AS lat,
               {_west(_HCITY)} + 0.005E0 + ((user_id * 53) % 340) / 1000E0 AS lon,
               ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS no2
        FROM {{events}}""",
    "stations_daily": f"""
        SELECT concat('ST', CAST({_STATION} AS STRING)) AS station_id,
               concat('City', CAST({_SCITY} AS STRING)) AS city,
               {_north(_SCITY)} - 0.005E0 - (({_STATION} * 37) % 440) / 1000E0 AS lat,
               {_west(_SCITY)} + 0.005E0 + (({_STATION} * 53) % 340) / 1000E0 AS lon,
               CAST(o_orderdate AS DATE) AS day,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 500029E0) AS no2
        FROM {{orders}} GROUP BY 1, 2, 3, 4, 5""",
    # Station days with a satellite column, weather and static layers, as a national training run takes them.
    "national": f"""
        SELECT concat('ST', CAST({_STATION} AS STRING)) AS station_id,
               concat('City', CAST({_SCITY} AS STRING)) AS city,
               {_north(_SCITY)} - 0.005E0 - (({_STATION} * 37) % 440) / 1000E0 AS lat,
               {_west(_SCITY)} + 0.005E0 + (({_STATION} * 53) % 340) / 1000E0 AS lon,
               CAST(o_orderdate AS DATE) AS day,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 500029E0) AS no2,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 50021E0) AS column,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (count(*) * 10.007E0) - 2.5E0 AS u10,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1.6647E0) - 3E0 AS v10,
               300E0 + CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 100E0 / (count(*) * 0.9997E0) AS blh,
               CAST(({_STATION} * 91) % 900 AS DOUBLE) AS elevation, CAST(({_STATION} * 57) % 1000 AS DOUBLE) AS population,
               CAST(({_STATION} * 29) % 100 AS DOUBLE) AS road_density
        FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5, 11, 12, 13""",
    "cells": f"""
        SELECT {_SUPP_AREA} AS area_id,
               {EPOCH} + CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS day,
               CAST(l_partkey % 13 AS INT) AS row, CAST(floor(l_partkey / 13E0) AS INT) % 10 AS col,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 50021E0) AS no2,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / (count(*) * 10.007E0) - 2.5E0 AS u10,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 10E0 / (count(*) * 16.647E0) - 3E0 AS v10,
               300E0 + CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 1000E0 / (count(*) * 9.997E0) AS blh
        FROM {{lineitem}} GROUP BY 1, 2, 3, 4""",
    "pois": f"""
        SELECT s_suppkey AS id, s_name AS name, {_POI_AREA} AS area_id,
               CASE s_nationkey % 3 WHEN 0 THEN 'FACTORY' WHEN 1 THEN 'POWER_PLANT' ELSE 'TRAFFIC_CORRIDOR' END
                   AS category,
               {_north(_POI_AREA)} - 0.01E0 - ((s_suppkey * 31) % 440) / 1000E0 AS lat,
               {_west(_POI_AREA)} + 0.01E0 + ((s_suppkey * 47) % 330) / 1000E0 AS lon,
               0.4E0 + (s_suppkey % 6) / 10E0 AS factor
        FROM {{supplier}}""",
    "grids": f"""
        SELECT area_id, {_west('area_id')} AS west, {_north('area_id')} AS north, 0.035E0 AS res,
               10 AS width, 13 AS height
        FROM (SELECT DISTINCT {_POI_AREA} AS area_id FROM {{supplier}}) g""",
    "static": f"""
        SELECT {_PART_AREA} AS area_id,
               CAST(p_partkey % 13 AS INT) AS row, CAST(floor(p_partkey / 13E0) AS INT) % 10 AS col,
               CAST(sum(p_size) AS DOUBLE) AS population,
               CAST(max(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / 100E0 AS road_density,
               CAST(min(p_size) AS DOUBLE) / 10E0 AS night_lights,
               CAST(max(p_size) AS DOUBLE) / 60E0 AS ghsl_built,
               CAST(sum(p_size) % 17 AS DOUBLE) / 3E0 AS power_plants,
               CAST(sum(p_size * 7) % 90 AS DOUBLE) AS elevation
        FROM {{part}} GROUP BY 1, 2, 3""",
    "points": f"""
        SELECT c_custkey AS point_id,
               CAST(floor(c_custkey / 300E0) AS INT) AS area_id,
               {_north('CAST(floor(c_custkey / 300E0) AS INT)')} + 0.02E0 - ((c_custkey * 71) % 500) / 1000E0 AS lat,
               {_west('CAST(floor(c_custkey / 300E0) AS INT)')} - 0.02E0 + ((c_custkey * 83) % 400) / 1000E0 AS lon
        FROM {{customer}}""",
    "global_obs": """
        SELECT CAST(l_orderkey % 90 AS INT) AS row, CAST((l_partkey * 7 + l_suppkey) % 180 AS INT) AS col,
               l_shipdate AS ts, l_extendedprice / 1000.3E0 AS no2,
               l_discount * 5E0 AS cloud_fraction, l_quantity / 5.003E0 - 5E0 AS u, l_tax * 1000E0 / 9.973E0 - 4E0 AS v
        FROM {lineitem}""",
    "haze": f"""
        SELECT {_HCITY} AS area_id, ts, CASE WHEN value < 0 THEN 0E0 ELSE (value % 100E0) / 100.03E0 END AS haze_index,
               event_id
        FROM {{events}} WHERE value IS NOT NULL""",
    "messages": "SELECT conv_id, turn, role, text FROM {conversations}",
    "texts": "SELECT doc_id, text, n_chars FROM {documents}",
    # Station report and catalogue payloads (JSON text as a download would deliver it).
    "sensor_json": """
        SELECT user_id AS sensor_id, CAST(user_id % 40 AS BIGINT) AS location_id,
               concat('{{"value":', CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS STRING) END,
                      ',"coverage":{{"percentComplete":', CAST(CAST(event_id % 100 AS INT) AS STRING),
                      '}},"period":{{"datetimeFrom":{{"local":"', CAST(CAST(ts AS DATE) AS STRING), 'T',
                      CASE WHEN hour(ts) < 10 THEN concat('0', CAST(hour(ts) AS STRING)) ELSE CAST(hour(ts) AS STRING) END,
                      ':00:00+05:30"}}}}}}') AS payload
        FROM {events}""",
}


def needed(sql: str) -> list[str]:
    """Names of the domain tables a SQL text mentions, in definition order."""
    return [n for n in ADAPTERS if re.search(rf"\b{n}\b", sql)]


def oracle_text(sql: str) -> str:
    """A SQL text for DuckDB with the domain tables it mentions prefixed as CTEs."""
    names = needed(sql)
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n].format(**{s: s for s in SOURCE_TABLES})})" for n in names)
    body = sql.strip()
    if not names:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazy access to source and domain tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.table = lru_cache(maxsize=None)(self._table)

    def _table(self, name: str) -> DataFrame:
        if name in SOURCE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = ADAPTERS[name]
        sources = {s: self.table(s) for s in SOURCE_TABLES if "{%s}" % s in text}
        return self.spark.sql(text, **sources)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCE_TABLES or name in ADAPTERS:
            return self.table(name)
        raise AttributeError(name)
