"""Queries over ingest, sinks, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridair.adapters import Tables
from gridair.functions import arrays, dates, geo, strings, units
from gridair.operators import levels, scenes
from gridair.operators import facts as X
from gridair.plans.q_cells import K
from gridair.plans.q_facts import _SUM
from gridair.plans.registry import query
from gridair.sources import ingest as I
from gridair.sources import sinks as W
from gridair.streaming.jobs import work_folder


def r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


@query("src_05_path_date", """
WITH p AS (SELECT o_orderkey, concat('/data/', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '/run_', CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INT) AS VARCHAR), '_', CAST(o_orderkey AS VARCHAR), '.tif') AS path,
   CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INT) AS day FROM orders) SELECT o_orderkey, day FROM p""")
def src_05(t: Tables):
    d = F.to_date("o_orderdate")
    later = F.date_add(d, (F.col("o_orderkey") % 50).cast("int"))
    p = t.orders.select("o_orderkey", F.concat(F.lit("/data/"), d.cast("string"), F.lit("/run_"), later.cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("path"))
    return I.with_path_date(p, "path").select("o_orderkey", "day")


@query("src_07_flatten_sensor_hours", """
SELECT user_id AS sensor_id, user_id % 40 AS location_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS date, date_trunc('hour', ts) AS ts, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS no2
FROM events WHERE event_type <> 'error' AND event_id % 100 >= 75""")
def src_07(t: Tables):
    return I.flatten_sensor_hours(t.sensor_json)


_CAT = """
cat AS (SELECT s_nationkey AS location_id, s_suppkey AS sensor_id, n_name AS name, n_nationkey / 2E0 + 8 AS lat, n_nationkey / 3E0 + 70 AS lon FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 <> 3)"""


def catalogue(t: Tables):
    """Location payloads with all their sensors, one JSON text per nation."""
    s = t.supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("s_suppkey").alias("id"), F.struct(F.when(F.col("s_suppkey") % 4 != 3, 7).otherwise(5).alias("id")).alias("parameter")))).alias("sensors"))
    j = t.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    body = F.struct(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"),
                    F.struct((F.col("n_nationkey") / 2.0 + 8).alias("latitude"), (F.col("n_nationkey") / 3.0 + 70).alias("longitude")).alias("coordinates"),
                    F.struct(F.lit("net").alias("name")).alias("provider"), "sensors")
    return j.select(F.to_json(body).alias("payload"))


@query("src_08_flatten_sensors", f"WITH {_CAT} SELECT CAST(location_id AS BIGINT) AS location_id, sensor_id, name, lat, lon, 'net' AS provider FROM cat")
def src_08(t: Tables):
    return I.flatten_sensors(catalogue(t), 7)


@query("src_09_assemble_sensors", f"""
WITH {_CAT}, h AS (SELECT user_id AS sensor_id, date_trunc('hour', ts) AS ts, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS no2 FROM events WHERE event_type <> 'error' AND event_id % 100 >= 75)
SELECT concat('OPENAQ_', CAST(location_id AS VARCHAR), '_', CAST(sensor_id AS VARCHAR)) AS station_id, name, lat, lon, ts, no2 FROM h JOIN cat USING (sensor_id)""")
def src_09(t: Tables):
    return I.assemble_sensors(I.flatten_sensor_hours(t.sensor_json), I.flatten_sensors(catalogue(t), 7))


_REP = """
rep AS (SELECT event_id, concat('Site-', CAST(user_id % 60 AS VARCHAR), ' (City)') AS station, ts, CASE WHEN event_type = 'error' THEN 'NA' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value FROM events)"""


def reports(t: Tables):
    v = F.when(F.col("event_type") == "error", "NA").otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string"))
    return t.events.select("event_id", F.concat(F.lit("Site-"), (F.col("user_id") % 60).cast("string"), F.lit(" (City)")).alias("station"),
                           F.when(F.col("event_type") == "view", F.lit("n/a")).otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm")).alias("from_date"), v.alias("value"))


@query("src_10_clean_report_rows", f"""
WITH {_REP} SELECT event_id, station, date_trunc('minute', rep.ts) AS ts, CAST(value AS DOUBLE) AS no2 FROM rep WHERE value <> 'NA' AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')""")
def src_10(t: Tables):
    return I.clean_report_rows(reports(t))


_COORDS = "co AS (SELECT concat('SITE ', CAST(s_suppkey AS VARCHAR), ' city') AS station_name, s_suppkey / 10E0 AS lat, 70 + s_suppkey / 7E0 AS lon FROM supplier WHERE s_acctbal > 2000)"


def coords(t: Tables):
    return t.supplier.where("s_acctbal > 2000").select(F.concat(F.lit("SITE "), F.col("s_suppkey").cast("string"), F.lit(" city")).alias("station_name"),
                                                         (F.col("s_suppkey") / 10.0).alias("lat"), (F.lit(70) + F.col("s_suppkey") / 7.0).alias("lon"))


@query("src_11_match_coordinates", f"""
WITH {_REP}, {_COORDS} SELECT event_id, station, concat('SITE_', CAST(CAST(regexp_extract(station, '\\d+') AS INT) AS VARCHAR), '_CITY') AS station_id, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM rep JOIN co ON regexp_replace(lower(station), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(station_name), '[^a-z0-9]+', '', 'g')""")
def src_11(t: Tables):
    return I.match_coordinates(reports(t), coords(t)).select("event_id", "station", "station_id", r("lat").alias("lat"), r("lon").alias("lon"))


@query("src_11_skipped_stations", f"""
WITH {_REP}, {_COORDS} SELECT DISTINCT station FROM rep WHERE NOT EXISTS (SELECT 1 FROM co WHERE regexp_replace(lower(station), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(station_name), '[^a-z0-9]+', '', 'g'))""")
def src_11b(t: Tables):
    return I.skipped_stations(reports(t), coords(t))


@query("src_12_dedupe_station_rows", """
SELECT station_id, ts, no2, file_rank FROM (SELECT concat('ST', CAST(user_id AS VARCHAR)) AS station_id, date_trunc('hour', ts) AS ts, value AS no2, event_id AS file_rank,
 row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS k FROM events) z WHERE k = 1""")
def src_12(t: Tables):
    e = t.events.select(F.concat(F.lit("ST"), F.col("user_id").cast("string")).alias("station_id"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("no2"), F.col("event_id").alias("file_rank"))
    return I.dedupe_station_rows(e)


# Elements as a map download delivers them: points and areas from suppliers, ways from parts.
def elements(t: Tables):
    k = F.col("s_suppkey")
    kv = lambda c, n, v: F.when(c, F.struct(F.lit(n).alias("key"), v.alias("value")))
    tags = F.map_from_entries(F.array_compact(F.array(
        kv(F.col("s_nationkey") % 3 == 0, "power", F.lit("plant")), kv(F.col("s_nationkey") % 3 == 1, "man_made", F.lit("works")),
        kv(k % 4 == 0, "name", F.col("s_name")), kv(k % 5 == 0, "name:en", F.lower("s_name")), kv(k % 2 == 0, "plant:source", F.lit("coal")),
        kv(k % 3 == 0, "plant:output:electricity", F.concat(k.cast("string"), F.lit(" MW"))), kv(k % 7 == 0, "product", F.lit("steel")), kv(k % 6 == 1, "industrial", F.lit("food_industry")))))
    centre = F.when(k % 3 == 1, F.struct((k / 10.0).alias("lat"), (k / 5.0).alias("lon")))
    pts = t.supplier.select(F.to_json(F.struct(F.when(k % 3 == 1, "way").otherwise("node").alias("type"), k.alias("id"), F.when(k % 3 == 0, k / 10.0).alias("lat"), F.when(k % 3 == 0, k / 5.0).alias("lon"),
                                               centre.alias("center"), tags.alias("tags"))).alias("payload"))
    p = F.col("p_partkey")
    n = p % 60
    path = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.struct(((p + i) / 100.0).alias("lat"), ((p + i * 2) / 100.0).alias("lon")))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    ltags = F.map_from_entries(F.array_compact(F.array(
        kv(p % 5 == 0, "railway", F.lit("rail")), kv(p % 2 == 0, "highway", F.when(p % 3 == 0, "motorway").when(p % 3 == 1, "trunk_link").otherwise("primary")), kv(p % 3 == 0, "ref", F.concat(F.lit("NH"), p.cast("string"))))))
    ways = t.part.select(F.to_json(F.struct(F.lit("way").alias("type"), p.alias("id"), ltags.alias("tags"), path.alias("geometry"))).alias("payload"))
    return pts.unionByName(ways)


@query("src_13_poi_points", """
WITH e AS (SELECT s_suppkey AS k, s_name, s_nationkey % 3 = 0 AS pl, s_nationkey % 3 = 1 AS wk FROM supplier WHERE s_suppkey % 3 <> 2)
SELECT concat('osm-', CASE WHEN k % 3 = 1 THEN 'way' ELSE 'node' END, '-', CAST(k AS VARCHAR)) AS id, CASE WHEN k % 5 = 0 THEN lower(s_name) WHEN k % 4 = 0 THEN s_name WHEN pl THEN 'Power plant' ELSE 'Industrial site' END AS name,
 CASE WHEN pl THEN 'POWER_PLANT' ELSE 'FACTORY' END AS category, k / 10E0 AS lat, k / 5E0 AS lon, CASE WHEN pl THEN 0.9E0 WHEN wk THEN 0.7E0 ELSE 0.6E0 END AS factor,
 concat(CASE WHEN pl THEN concat('Power plant', CASE WHEN k % 2 = 0 THEN ' (coal)' ELSE '' END, CASE WHEN k % 3 = 0 THEN concat(', ', CAST(k AS VARCHAR), ' MW') ELSE '' END, '.')
  WHEN wk THEN concat('Factory / works', CASE WHEN k % 7 = 0 THEN ': steel' ELSE '' END, '.') ELSE concat('Industrial area', CASE WHEN k % 6 = 1 THEN ' (food industry)' ELSE '' END, '.') END, ' Source: OpenStreetMap.') AS details FROM e""")
def src_13(t: Tables):
    return I.poi_points(I.parse_elements(elements(t)))


@query("prj_12_classify_poi", """
SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN 'POWER_PLANT' ELSE 'FACTORY' END AS category, CASE WHEN s_nationkey % 3 = 0 THEN 0.9E0 WHEN s_nationkey % 3 = 1 THEN 0.7E0 ELSE 0.6E0 END AS factor FROM supplier""")
def prj_12(t: Tables):
    return I.classify_poi(I.parse_elements(elements(t)).where("geometry IS NULL")).select("id", "category", "factor")


_WAYS = """
w AS (SELECT p_partkey AS p, p_partkey % 60 AS n, greatest(1, CAST(floor((p_partkey % 60) / 20E0) AS INT)) AS k FROM part WHERE p_partkey % 60 >= 2)"""


@query("src_13_poi_lines", f"""
WITH {_WAYS} SELECT concat('osm-way-', CAST(p AS VARCHAR)) AS id, CASE WHEN p % 3 = 0 THEN concat('NH', CAST(p AS VARCHAR)) WHEN p % 5 = 0 THEN 'Railway' WHEN p % 2 = 0 AND p % 3 = 1 THEN 'Trunk_link' WHEN p % 2 = 0 THEN 'Primary' ELSE 'Road' END AS name,
 CASE WHEN p % 5 = 0 THEN 'railway' WHEN p % 2 = 0 THEN CASE p % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' ELSE 'primary' END ELSE 'road' END AS kind,
 CASE WHEN p % 5 = 0 THEN 0.5E0 WHEN p % 2 = 0 AND p % 3 = 0 THEN 0.85E0 ELSE 0.7E0 END AS factor, CAST(ceil(n / CAST(k AS DOUBLE)) + CASE WHEN (n - 1) % k = 0 THEN 0 ELSE 1 END AS INT) AS vertices, (p + n - 1) / 100E0 AS last_lat FROM w""")
def src_13b(t: Tables):
    return I.poi_lines(I.parse_elements(elements(t))).select("id", "name", "kind", "factor", F.size("path").alias("vertices"), F.element_at("path", -1)["lat"].alias("last_lat"))


@query("src_14_parse_roads", f"""
WITH {_WAYS} SELECT p AS id, CASE WHEN p % 2 = 0 THEN CASE p % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' ELSE 'primary' END ELSE '' END AS highway, CAST(n AS INT) AS vertices FROM w""")
def src_14(t: Tables):
    return I.parse_roads(I.parse_elements(elements(t))).select("id", "highway", F.size("path").alias("vertices"))


# --------------------------------------------------------------------------------------------- sinks
_POINTS = """
SELECT area_id, day, lon, lat, round(no2 * pow(10, 5 - floor(log10(abs(no2))))) / pow(10, 5 - floor(log10(abs(no2)))) AS no2 FROM
 (SELECT c.*, round(west + res * (col + 0.5E0), 4) AS lon, round(north - res * (row + 0.5E0), 4) AS lat FROM cells c JOIN grids USING (area_id) WHERE row % 2 = 0 AND col % 2 = 0) z"""


@query("snk_01_points_table", _POINTS)
def snk_01(t: Tables):
    p = W.points_table(t.cells, t.grids, 2)
    return p.withColumn("lon", r("lon", 4)).withColumn("lat", r("lat", 4))


@query("snk_01_write_points_csv", _POINTS)
def snk_01b(t: Tables):
    """The point files, written and read back."""
    folder = f"{work_folder(t.spark, 'points')}/csv"
    W.write_points_csv(t.cells, t.grids, folder, 2)
    back = t.spark.read.option("header", True).schema("lon double, lat double, no2 double, area_id int, day date").csv(folder)
    return back.select("area_id", "day", r("lon", 4).alias("lon"), r("lat", 4).alias("lat"), "no2")


@query("snk_02_point_features", """
SELECT area_id, day, row, col, round(no2, 3) AS no2, CASE WHEN no2 < 40 THEN 'Normal' WHEN no2 < 80 THEN 'Moderate' WHEN no2 < 180 THEN 'Unhealthy' ELSE 'Hazardous' END AS band,
 round(west + res * (col + 0.5E0), 5) AS lon, 'Point' AS kind FROM cells JOIN grids USING (area_id) WHERE row % 2 = 0 AND col % 2 = 0""")
def snk_02(t: Tables):
    f = W.point_features(t.cells, t.grids)
    at = lambda p: F.get_json_object("feature", p)
    return f.select("area_id", "day", "row", "col", at("$.properties.no2").cast("double").alias("no2"), at("$.properties.band").alias("band"),
                    at("$.geometry.coordinates[0]").cast("double").alias("lon"), at("$.geometry.type").alias("kind"))


@query("snk_03_wind_features", """
SELECT area_id, day, row, col, round(west + res * (col + 0.5E0) + u10 * 900 / (111320E0 * cos(radians(north - height * res / 2))), 5) AS head_lon, round(north - res * (row + 0.5E0) + v10 * 900 / 110574E0, 5) AS head_lat,
 round(sqrt(u10 * u10 + v10 * v10), 2) AS speed_ms, round((degrees(atan2(u10, v10)) + 360) % 360, 1) AS heading_deg FROM cells JOIN grids USING (area_id) WHERE (row - 2) % 4 = 0 AND (col - 2) % 4 = 0""")
def snk_03(t: Tables):
    f = W.wind_features(t.cells, t.grids, 4)
    at = lambda p: F.get_json_object("feature", p).cast("double")
    return f.select("area_id", "day", "row", "col", "head_lon", "head_lat", at("$.properties.speed_ms").alias("speed_ms"), at("$.properties.heading_deg").alias("heading_deg"))


@query("snk_05_pending_runs", """
SELECT area_id, day FROM (SELECT DISTINCT area_id, day FROM cells) c WHERE NOT EXISTS (SELECT 1 FROM cells d WHERE d.area_id = c.area_id AND d.day = c.day AND d.row = 3 AND d.col = 3)""")
def snk_05(t: Tables):
    todo = W.with_run_key(t.cells.select("area_id", "day").distinct(), ["area_id", "day"])
    done = W.with_run_key(t.cells.where("row = 3 AND col = 3").select("area_id", "day").distinct(), ["area_id", "day"])
    return W.pending_runs(todo, done).select("area_id", "day")


@query("snk_06_quantise", """
WITH q AS (SELECT row, col, ts, CASE WHEN cloud_fraction < 0.3E0 THEN CAST(greatest(-32767, least(32767, round_even(no2 / 0.01E0, 0))) AS SMALLINT) ELSE CAST(-32768 AS SMALLINT) END AS q FROM global_obs)
SELECT row, col, ts, q, CASE WHEN q <> -32768 THEN round(q * 0.01E0, 6) END AS back FROM q""")
def snk_06(t: Tables):
    q = units.quantise(F.when(F.col("cloud_fraction") < 0.3, F.col("no2")), 0.01)
    return t.global_obs.select("row", "col", "ts", q.alias("q")).withColumn("back", r(units.dequantise(F.col("q"), 0.01)))


_FACTS = f"""
WITH {_SUM} SELECT area_id, day, round(mean, 3) AS mean, round(max, 3) AS max, round(share_above_who, 3) AS who FROM s"""


@query("snk_07_write_facts_json", _FACTS)
def snk_07b(t: Tables):
    """The fact documents, written as JSON lines and read back."""
    folder = f"{work_folder(t.spark, 'facts')}/json"
    f = X.area_summary(t.cells, t.grids).select("area_id", "day", *[r(c, 3).alias(c) for c in ("mean", "max", "share_above_who")])
    W.write_facts_json(f, {"current": ["mean", "max"], "shares": ["share_above_who"]}, folder)
    back = t.spark.read.schema("area_id int, day date, current struct<mean:double,max:double>, shares struct<share_above_who:double>").json(folder)
    return back.select("area_id", "day", "current.mean", "current.max", F.col("shares.share_above_who").alias("who"))


@query("snk_07_facts_document", _FACTS)
def snk_07(t: Tables):
    f = X.area_summary(t.cells, t.grids)
    f = f.select("area_id", "day", *[r(c, 3).alias(c) for c in ("mean", "max", "share_above_who")])
    d = W.facts_document(f, {"current": ["mean", "max"], "shares": ["share_above_who"]})
    at = lambda p: F.get_json_object("document", p).cast("double")
    return d.select("area_id", "day", at("$.current.mean").alias("mean"), at("$.current.max").alias("max"), at("$.shares.share_above_who").alias("who"))


# --------------------------------------------------------------------------------------------- scenes and weather
@query("top_03_best_scenes", """
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS scene_id, l_suppkey AS tile, CAST(l_shipdate AS DATE) AS day, l_discount * 300 AS cloud_pct, l_tax * 200 AS nodata_pct FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cloud_pct, scene_id) AS rank FROM s WHERE cloud_pct < 20 AND nodata_pct < 10 AND day >= DATE '1998-06-01' - 365 AND day <= DATE '1998-06-01')
SELECT tile, scene_id, CAST(rank AS INT) AS rank FROM k WHERE rank <= 8""")
def top_03(t: Tables):
    s = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene_id"), F.col("l_suppkey").alias("tile"), F.to_date("l_shipdate").alias("day"),
                          (F.col("l_discount") * 300).alias("cloud_pct"), (F.col("l_tax") * 200).alias("nodata_pct"))
    return scenes.best_scenes(s, "1998-06-01").select("tile", "scene_id", "rank")


@query("agg_29_overpass_weather", """
WITH h AS (SELECT station_id, CAST(ts AS DATE) AS day, avg(no2) AS w FROM stations_hourly, (SELECT 8.5E0 AS o) z
   WHERE hour(ts) + minute(ts) / 60E0 + second(ts) / 3600E0 >= o - 1.5 AND hour(ts) + minute(ts) / 60E0 + second(ts) / 3600E0 < o + 1.5 GROUP BY 1, 2),
d AS (SELECT station_id, CAST(ts AS DATE) AS day, max(no2) AS v FROM stations_hourly GROUP BY 1, 2)
SELECT station_id, day, round(coalesce(w, v), 6) AS t2m, w IS NULL AS fallback FROM d LEFT JOIN h USING (station_id, day)""")
def agg_29(t: Tables):
    h = t.stations_hourly.select("station_id", "ts", F.col("no2").alias("t2m"), F.lit(8.5).alias("overpass_hour"))
    d = h.groupBy("station_id", F.to_date("ts").alias("day")).agg(F.max("t2m").alias("t2m"))
    return scenes.overpass_weather(h, d, ["station_id"], "t2m").withColumn("t2m", r("t2m"))


# --------------------------------------------------------------------------------------------- sets
@query("set_01_union_all", """
SELECT id, lat, lon, category, NULL AS area_id FROM pois UNION ALL SELECT point_id, lat, lon, NULL, area_id FROM points""")
def set_01(t: Tables):
    return levels.union_all(t.pois.select("id", "lat", "lon", "category"), t.points.select(F.col("point_id").alias("id"), "lat", "lon", "area_id"))


@query("set_03_common_features", "SELECT DISTINCT p_name AS feature FROM part WHERE p_size > 25 INTERSECT SELECT DISTINCT p_name FROM part WHERE p_retailprice < 920")
def set_03(t: Tables):
    f = F.col("p_name").alias("feature")
    return levels.common_features(t.part.where("p_size > 25").select(f), t.part.where("p_retailprice < 920").select(f))


@query("set_04_pending", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def set_04(t: Tables):
    return levels.pending(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# --------------------------------------------------------------------------------------------- scalar functions
@query("fun_01_distances", """
SELECT point_id, round(12742000E0 * asin(least(1, sqrt(pow(sin(radians(20 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(20E0)) * pow(sin(radians(75 - lon) / 2), 2)))), 3) AS metres,
 round((degrees(atan2(sin(radians(75 - lon)) * cos(radians(20E0)), cos(radians(lat)) * sin(radians(20E0)) - sin(radians(lat)) * cos(radians(20E0)) * cos(radians(75 - lon)))) + 360) % 360, 6) AS bearing,
 round(sqrt(pow((lat - 20) * 110.57E0, 2) + pow((lon - 75) * 111.32E0 * cos(radians(lat)), 2)), 6) AS flat FROM points""")
def fun_01(t: Tables):
    a, b, c, d = F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(75.0)
    return t.points.select("point_id", r(geo.haversine_m(a, b, c, d), 3).alias("metres"), r(geo.bearing_deg(a, b, c, d)).alias("bearing"), r(geo.flat_km(a, b, c, d)).alias("flat"))


@query("fun_02_boxes", """
WITH b AS (SELECT point_id, concat(CAST(point_id % 90 AS VARCHAR), '.5, ', CAST(point_id % 40 AS VARCHAR), ',', CAST(point_id % 97 AS VARCHAR), ', ', CAST(point_id % 43 AS VARCHAR), '.25') AS t FROM points),
p AS (SELECT point_id, CAST(point_id % 90 AS DOUBLE) + 0.5 AS w, CAST(point_id % 40 AS DOUBLE) AS s, CAST(point_id % 97 AS DOUBLE) AS e, CAST(point_id % 43 AS DOUBLE) + 0.25 AS n FROM points)
SELECT point_id, w < e AND s < n AS valid, CASE WHEN w < e AND s < n THEN w END AS west, CASE WHEN w < e AND s < n THEN n END AS north, round(floor((lon + 1e-9) / 0.05E0) * 0.05E0, 2) AS snap_w, round(ceil((lat - 1e-9) / 0.05E0) * 0.05E0, 2) AS snap_n FROM p JOIN points USING (point_id)""")
def fun_02(t: Tables):
    k = F.col("point_id")
    s = lambda c: c.cast("string")
    text = F.concat(s(k % 90), F.lit(".5, "), s(k % 40), F.lit(","), s(k % 97), F.lit(", "), s(k % 43), F.lit(".25"))
    b = geo.parse_bbox(text)
    return t.points.select("point_id", b.isNotNull().alias("valid"), b["west"].alias("west"), b["north"].alias("north"), geo.snap_down(F.col("lon")).alias("snap_w"), geo.snap_up(F.col("lat")).alias("snap_n"))


@query("fun_03_math", """
SELECT area_id, day, row, col, greatest(-1, least(1, u10)) AS clipped, round(sqrt(u10 * u10 + v10 * v10), 6) AS speed, round(ln(1 + no2), 6) AS logged, round(no2 / nullif(CAST(row AS DOUBLE), 0), 6) AS ratio,
 round((col / 9E0) * (col / 9E0) * (3 - 2 * (col / 9E0)), 6) AS eased, round(exp(-no2 / 24), 6) AS decayed FROM cells""")
def fun_03(t: Tables):
    v = F.col("no2")
    return t.cells.select(*K, units.clip(F.col("u10"), -1, 1).alias("clipped"), r(F.hypot("u10", "v10")).alias("speed"), r(F.log1p(v)).alias("logged"),
                          r(units.safe_ratio(v, F.col("row").cast("double"))).alias("ratio"), r(units.smoothstep(F.col("col") / 9.0)).alias("eased"), r(units.exp_decay(v, 24.0)).alias("decayed"))


@query("fun_04_text_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS slashed, DATE '2024-06-29' AS word, CAST(o_orderkey % 9 AS INT) AS hours, CAST(24 * (o_orderkey % 4) AS INT) AS days FROM orders""")
def fun_04(t: Tables):
    d = F.to_date("o_orderdate")
    today = F.lit("2024-06-30").cast("date")
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", dates.text_date(F.concat(F.lit("map of "), d.cast("string"), F.lit(" please")), today).alias("iso"),
                           dates.text_date(F.concat(F.lit("on "), F.date_format(d, "d/M/yyyy")), today).alias("slashed"), dates.text_date(F.concat(F.lit("Yesterday "), "o_orderstatus"), today).alias("word"),
                           dates.text_hours(F.concat(F.lit("for "), (k % 9).cast("string"), F.lit(" hr"))).alias("hours"),
                           dates.text_hours(F.concat((k % 4).cast("string"), F.lit(" d"))).alias("days"))


@query("fun_05_seasons", "SELECT o_orderkey, month(o_orderdate) IN (3, 4, 5) AS hot, least(2030, 5 * CAST(floor(year(o_orderdate) / 5E0) AS INT)) AS epoch FROM orders")
def fun_05(t: Tables):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.in_season(d, [3, 4, 5]).alias("hot"), dates.population_epoch(d).alias("epoch"))


@query("fun_06_people", """
SELECT o_orderkey, CASE WHEN x >= 1e6 THEN concat(format('{:.1f}', x / 1e6), ' million') ELSE format('{:,}', CAST(x AS BIGINT)) END AS people,
 CASE WHEN x >= 1e7 THEN concat(format('{:.1f}', x / 1e7), ' crore') WHEN x >= 1e5 THEN concat(format('{:.1f}', x / 1e5), ' lakh') ELSE format('{:,}', CAST(x AS BIGINT)) END AS indian FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey + 3 AS DOUBLE) AS x FROM orders) z""")
def fun_06(t: Tables):
    x = (F.col("o_orderkey") * F.col("o_orderkey") + 3).cast("double")
    return t.orders.select("o_orderkey", strings.people(x).alias("people"), strings.people_indian(x).alias("indian"))


@query("fun_07_similarity", """
WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS a FROM part), v AS (SELECT DISTINCT lower(p_type) AS b, p_partkey % 7 AS k FROM part)
SELECT a, b, k, round(CASE WHEN a = b THEN 1 WHEN length(a) < 4 OR length(b) < 4 THEN 0 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 6) AS sim FROM w JOIN v ON length(a) = length(b) OR length(a) + 1 = length(b)""")
def fun_07(t: Tables):
    w = t.part.select(F.lower(F.substring_index("p_name", " ", 1)).alias("a")).distinct().withColumn("n", F.explode(F.array(F.length("a"), F.length("a") + 1)))
    v = t.part.select(F.lower("p_type").alias("b"), (F.col("p_partkey") % 7).alias("k")).distinct().withColumn("n", F.length("b"))
    return w.join(v, "n").select("a", "b", "k", r(strings.similarity(F.col("a"), F.col("b"))).alias("sim"))


@query("fun_08_numbers", """
SELECT doc_id, list_transform(regexp_extract_all(replace(text, ',', ''), '[0-9]+(?:\\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE)) AS numbers FROM texts""")
def fun_08(t: Tables):
    return t.texts.select("doc_id", strings.numbers(F.col("text")).alias("numbers"))


@query("fun_09_simplify_line", """
WITH l AS (SELECT c_custkey, [x * 3 for x in range(c_custkey % 90 + 1)] AS p, greatest(1, CAST(floor((c_custkey % 90 + 1) / 20E0) AS INT)) AS k FROM customer),
s AS (SELECT c_custkey, p, list_transform(list_filter(range(len(p)), lambda i: i % k = 0), lambda i: p[i + 1]) AS q FROM l)
SELECT c_custkey, CASE WHEN q[-1] = p[-1] THEN q ELSE list_append(q, p[-1]) END AS kept FROM s""")
def fun_09(t: Tables):
    path = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("c_custkey") % 90), lambda x: x * 3)
    return t.customer.select("c_custkey", arrays.simplify_line(path).alias("kept"))


@query("fun_10_fuzzy_or", "SELECT area_id, day, row, col, round(1 - (1 - row / 20E0) * (1 - col / 15E0) * (1 - no2 / 500), 6) AS membership FROM cells")
def fun_10(t: Tables):
    return t.cells.select(*K, r(arrays.fuzzy_or(F.array(F.col("row") / 20.0, F.col("col") / 15.0, F.col("no2") / 500.0))).alias("membership"))


@query("fun_11_summarise_numbers", """
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN len(v) > 12 THEN CAST(len(v) AS INT) END AS n, CASE WHEN len(v) > 12 THEN list_min(v) END AS lo, CASE WHEN len(v) > 12 THEN list_max(v) END AS hi, CASE WHEN len(v) > 12 THEN v[1] END AS first, CASE WHEN len(v) > 12 THEN v[-1] END AS last FROM l""")
def fun_11(t: Tables):
    l = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))  # noqa: E741
    s = arrays.summarise_numbers(F.col("v"))
    return l.select("o_custkey", s["count"].alias("n"), s["min"].alias("lo"), s["max"].alias("hi"), s["first"].alias("first"), s["last"].alias("last"))


@query("fun_12_tags", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k'), 'none') AS name FROM events")
def fun_12(t: Tables):
    e = t.events.withColumn("tags", F.from_json("props", "map<string,string>"))
    return e.select("event_id", I.tag("k").cast("int").alias("k"), F.coalesce(I.tag("name"), I.tag("k"), F.lit("none")).alias("name"))


@query("fun_13_content_keys", "SELECT o_orderkey, sha1(concat(CAST(o_orderkey AS VARCHAR), '|', o_orderstatus)) AS sha FROM orders")
def fun_13(t: Tables):
    return t.orders.select("o_orderkey", F.sha1(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")).alias("sha"))


@query("fun_13_stable_placement", "SELECT CAST(CAST('0x' || substr(md5(concat(CAST(o_orderkey AS VARCHAR), '|', o_orderstatus)), 1, 8) AS BIGINT) % 16 AS INT) AS slot, count(*) AS n FROM orders GROUP BY 1")
def fun_13b(t: Tables):
    """Repeatable placement of records by checksum."""
    return t.orders.groupBy((strings.hash_number(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")) % 16).cast("int").alias("slot")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------------------------- files written and read
@query("src_01_read_stations", """
SELECT station_id, date_trunc('minute', ts) AS ts, round(lat, 6) AS lat, round(lon, 6) AS lon, no2 FROM stations_hourly""")
def src_01(t: Tables):
    """The hourly stations written as CSV with untidy headers and read back."""
    folder = f"{work_folder(t.spark, 'stations')}/csv"
    out = t.stations_hourly.select(F.col("station_id").alias(" Station_ID"), F.col("lat").alias("LAT"), F.col("lon").alias("Lon "),
                                   F.date_format("ts", "yyyy-MM-dd HH:mm").alias("Date"), F.coalesce(F.col("no2").cast("string"), F.lit("NA")).alias("NO2"))
    out.write.mode("overwrite").option("header", True).csv(folder)
    return I.read_stations(t.spark, folder).select("station_id", "ts", r("lat").alias("lat"), r("lon").alias("lon"), "no2")


@query("src_02_read_station_coords", "SELECT s_name AS station_name, s_suppkey / 10E0 AS lat, s_suppkey / 8E0 AS lon FROM supplier")
def src_02(t: Tables):
    folder = f"{work_folder(t.spark, 'coords')}/csv"
    k = F.col("s_suppkey")
    t.supplier.select(F.col("s_name").alias("station_name"), (k / 10.0).alias("lat"), (k / 8.0).alias("lon")).write.mode("overwrite").option("header", True).csv(folder)
    return I.read_station_coords(t.spark, folder)


@query("snk_04_write_daily", """
SELECT area_id, day, count(*) AS cells, round(max(no2), 6) AS top FROM (SELECT area_id, day, CASE WHEN area_id % 2 = 0 THEN no2 + 1 ELSE no2 END AS no2 FROM cells) z GROUP BY 1, 2""")
def snk_04(t: Tables):
    """All days written, then the even areas written again: only their folders are replaced."""
    folder = f"{work_folder(t.spark, 'daily')}/out"
    W.write_daily(t.cells.select(*K, "no2"), folder)
    W.write_daily(t.cells.where("area_id % 2 = 0").select(*K, (F.col("no2") + 1).alias("no2")), folder)
    back = t.spark.read.parquet(folder)
    return back.groupBy("area_id", "day").agg(F.count("*").alias("cells"), r(F.max("no2")).alias("top"))


# --------------------------------------------------------------------------------------------- source protocols
def _provided(t: Tables, name: str, kind: str, by: tuple[str, ...], within: tuple[str, ...] = ()):
    """A domain table as a provider would deliver it, read through the source protocol.

    ``within`` cuts the rows of a folder into ranges of about equal size, so that files follow the rows and not the keys.
    """
    from gridair.sources import protocol
    from gridair.streaming.jobs import work_folder
    folder = f"{work_folder(t.spark, kind)}/table"
    rows = t.table(name).withColumn("year", F.year("day"))
    (rows.repartitionByRange(*by, *within) if within else rows.repartition(*by)).write.partitionBy(*by).parquet(folder)
    protocol.register(t.spark)
    return t.spark.read.format("gridair").option("kind", kind).load(folder)


@query("udx_04_satellite_source", "SELECT area_id, row, col, count(*) AS n, round(avg(no2), 6) AS mean FROM cells WHERE area_id % 2 = 0 AND day >= DATE '2024-01-20' AND day < DATE '2024-02-20' GROUP BY 1, 2, 3")
def udx_04a(t: Tables):
    """The filter on days leaves folders out; the one on areas is Spark's.  A folder holds a day of all areas."""
    d = _provided(t, "cells", "satellite", ("day",), ("area_id",)).where("area_id % 2 = 0 AND day >= DATE '2024-01-20' AND day < DATE '2024-02-20'")
    return d.groupBy("area_id", "row", "col").agg(F.count("*").alias("n"), F.round(F.avg("no2"), 6).alias("mean"))


@query("udx_04_ground_source", "SELECT station_id, day, no2 FROM stations_daily WHERE year(day) IN (1993, 1995) AND no2 IS NOT NULL")
def udx_04b(t: Tables):
    return _provided(t, "stations_daily", "ground", ("year",)).where("year IN (1993, 1995) AND no2 IS NOT NULL").select("station_id", "day", "no2")


@query("src_03_read_cells", "SELECT area_id, count(*) AS n, round(sum(no2), 4) AS total FROM cells GROUP BY 1")
def src_03_file(t: Tables):
    """A cell table in a file, read with its guard against two values for a cell and day."""
    from gridair.sources import ingest
    from gridair.streaming.jobs import work_folder
    path = f"{work_folder(t.spark, 'cells')}/table"
    t.cells.write.parquet(path)
    return ingest.read_cells(t.spark, path).groupBy("area_id").agg(F.count("*").alias("n"), F.round(F.sum("no2"), 4).alias("total"))
