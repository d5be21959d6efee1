"""Queries on area facts, attribution, forecasts and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridair.adapters import Tables
from gridair.functions import bands, units
from gridair.operators import attribution as A
from gridair.operators import facts as X
from gridair.operators import forecast as P
from gridair.operators import cells as G
from gridair.plans.q_cells import DENSE, FILLED, K, filled
from gridair.plans.registry import query


def r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


def rr(df, n=6, skip=()):
    """Rounded doubles of a DataFrame."""
    return df.select(*[F.round(F.col(c), n).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


_SUM = """
s AS (SELECT area_id, day, avg(no2) AS mean, quantile_cont(no2, 0.5) AS median, quantile_cont(no2, 0.95) AS p95, max(no2) AS max,
  avg(CAST(no2 > 80 AS INT)) AS share_above_naaqs, avg(CAST(no2 > 25 AS INT)) AS share_above_who, avg(CAST(no2 < 40 AS INT)) AS share_normal,
  avg(CAST(no2 >= 40 AND no2 < 80 AS INT)) AS share_moderate, avg(CAST(no2 >= 80 AND no2 < 180 AS INT)) AS share_unhealthy,
  avg(CAST(no2 >= 180 AS INT)) AS share_hazardous FROM cells GROUP BY 1, 2)"""


@query("agg_11_area_summary", f"""
WITH {_SUM}, w AS (SELECT area_id, avg(no2) AS window_mean FROM cells GROUP BY 1),
m AS (SELECT area_id, day, row AS max_row, col AS max_col FROM (SELECT *, row_number() OVER (PARTITION BY area_id, day ORDER BY no2 DESC, row, col) AS k FROM cells) z WHERE k = 1)
SELECT area_id, day, round(mean, 6) AS mean, round(median, 6) AS median, round(p95, 6) AS p95, round(max, 6) AS max, max_row, max_col,
 round(north - res * (max_row + 0.5E0), 4) AS max_lat, round(west + res * (max_col + 0.5E0), 4) AS max_lon,
 round(share_above_naaqs, 6) AS share_above_naaqs, round(share_above_who, 6) AS share_above_who, round(share_normal, 6) AS share_normal,
 round(share_moderate, 6) AS share_moderate, round(share_unhealthy, 6) AS share_unhealthy, round(share_hazardous, 6) AS share_hazardous,
 CASE WHEN mean > 180 THEN 'critical_spike' WHEN mean > 80 THEN 'critical' WHEN mean > 40 OR share_above_naaqs >= 0.05 THEN 'elevated' ELSE 'normal' END AS status,
 CASE WHEN mean < 40 THEN 'normal' WHEN mean < 80 THEN 'moderate' WHEN mean < 180 THEN 'unhealthy' ELSE 'hazardous' END AS band,
 round((mean - 80) / 80 * 100, 6) AS pct_vs_naaqs, round((window_mean - 40) / 40 * 100, 6) AS pct_vs_annual, round(window_mean, 6) AS window_mean
FROM s JOIN w USING (area_id) JOIN m USING (area_id, day) JOIN grids USING (area_id)""")
def agg_11(t: Tables):
    return rr(X.area_summary(t.cells, t.grids), skip=("max_lat", "max_lon"))


@query("prj_10_classify_status", f"""
WITH {_SUM} SELECT area_id, day, CASE WHEN mean * 1.5E0 > 180 THEN 'critical_spike' WHEN mean * 1.5E0 > 80 THEN 'critical' WHEN mean * 1.5E0 > 40 OR share_above_naaqs >= 0.05 THEN 'elevated' ELSE 'normal' END AS status FROM s""")
def prj_10(t: Tables):
    g = t.cells.groupBy("area_id", "day").agg(F.avg("no2").alias("m"), X.share(F.col("no2") > 80).alias("s"))
    return g.select("area_id", "day", bands.classify_status(F.col("m") * 1.5, F.col("s")).alias("status"))


@query("agg_12_population_exposure", """
WITH p AS (SELECT area_id, row, col, population * (res * 111320E0 * cos(radians(north - height * res / 2))) * (res * 110574E0) / 10000 AS p FROM static JOIN grids USING (area_id)),
j AS (SELECT area_id, day, no2, p FROM cells JOIN p USING (area_id, row, col)),
g AS (SELECT area_id, day, sum(p) AS total, coalesce(sum(p) FILTER (no2 < 40), 0) AS n1, coalesce(sum(p) FILTER (no2 >= 40 AND no2 < 80), 0) AS n2, coalesce(sum(p) FILTER (no2 >= 80 AND no2 < 180), 0) AS n3,
 coalesce(sum(p) FILTER (no2 >= 180), 0) AS n4, coalesce(sum(p) FILTER (no2 > 80), 0) AS a, coalesce(sum(p) FILTER (no2 > 25), 0) AS w, sum(p * no2) AS pv FROM j GROUP BY 1, 2)
SELECT area_id, day, round(total, 3) AS total, round(n1, 3) AS people_normal, round(n2, 3) AS people_moderate, round(n3, 3) AS people_unhealthy, round(n4, 3) AS people_hazardous,
 round(a, 3) AS above_naaqs, round(w, 3) AS above_who, round(a / total, 3) AS share_above_naaqs, round(w / total, 3) AS share_above_who, round(pv / total, 3) AS weighted_mean FROM g WHERE total > 0""")
def agg_12(t: Tables):
    return rr(X.population_exposure(t.cells, t.static, t.grids), 3)


@query("grd_12_source_tags", """
WITH q AS (SELECT area_id, quantile_cont(road_density, 0.8) AS r8, quantile_cont(power_plants, 0.9) AS p9, quantile_cont(night_lights, 0.8) AS n8, quantile_cont(ghsl_built, 0.8) AS g8 FROM static GROUP BY 1),
x AS (SELECT area_id, row, col, list_filter([CASE WHEN road_density >= r8 THEN 'traffic' END, CASE WHEN power_plants >= greatest(p9, ln(51E0)) THEN 'power_plant' END,
 CASE WHEN night_lights >= n8 AND ghsl_built >= g8 THEN 'dense_urban' END], lambda x: x IS NOT NULL) AS tags FROM static JOIN q USING (area_id))
SELECT area_id, row, col, CASE WHEN len(tags) > 0 THEN tags ELSE ['background'] END AS tags FROM x""")
def grd_12(t: Tables):
    return X.source_tags(t.static).select("area_id", "row", "col", "tags")


@query("agg_24_haze_summary", """
WITH n AS (SELECT max(ts) AS now FROM haze), h AS (SELECT haze.* FROM haze, n WHERE ts >= now - INTERVAL 72 HOUR)
SELECT area_id, max(ts) AS latest_ts, arg_max(haze_index, ts) AS latest_index,
 CASE WHEN arg_max(haze_index, ts) < 0.3 THEN 'clear' WHEN arg_max(haze_index, ts) < 0.45 THEN 'light' WHEN arg_max(haze_index, ts) < 0.6 THEN 'moderate' ELSE 'dense' END AS latest_class,
 count(*) AS n, round(avg(haze_index), 3) AS mean, round(max(haze_index), 3) AS max FROM h GROUP BY 1""")
def agg_24(t: Tables):
    return X.haze_summary(t.haze, t.haze.agg(F.max("ts")).scalar(), keys=("area_id",))


@query("prj_15_haze_class", """
SELECT event_id, CASE WHEN x < 0.3 THEN 'clear' WHEN x < 0.45 THEN 'light' WHEN x < 0.6 THEN 'moderate' ELSE 'dense' END AS haze, x AS clamped
FROM (SELECT event_id, greatest(0, least(1, haze_index * 1.3E0 - 0.1E0)) AS x FROM haze) z""")
def prj_15(t: Tables):
    x = bands.clamp_index(F.col("haze_index") * 1.3 - 0.1)
    return t.haze.select("event_id", bands.haze_class(x).alias("haze"), x.alias("clamped"))


@query("prj_16_lead_confidence", """
SELECT event_id, round(greatest(0, 0.5E0 * exp(-(hour(ts) + 1) / 24E0)), 6) AS hours, round(greatest(0, 0.63E0 * exp(-(30E0 * (hour(ts) + 1)) / 90E0) * (1 - least(haze_index, 1))), 6) AS frame FROM haze""")
def prj_16(t: Tables):
    h = F.hour("ts") + 1
    return t.haze.select("event_id", r(units.lead_confidence(h)).alias("hours"), r(units.frame_confidence(h * 30.0, F.col("haze_index"))).alias("frame"))


@query("prj_21_resolve_request", """
WITH n AS (SELECT max(CAST(o_orderdate AS DATE)) AS today FROM orders),
q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders),
u AS (SELECT o_orderkey, day, today, least(coalesce(day, today - 6), today - 6) AS use_day FROM q, n)
SELECT o_orderkey, day, use_day, CASE WHEN today - use_day > 12 THEN 'OFFL' ELSE 'NRTI' END AS product FROM u""")
def prj_21(t: Tables):
    d = F.to_date("o_orderdate")
    q = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, d).alias("day"))
    return X.resolve_request(q, t.orders.agg(F.max(d)).scalar())


@query("prj_23_severity", """
SELECT area_id, day, row, col, CASE WHEN no2 * 2 >= 300 THEN 'CRITICAL' WHEN no2 * 2 >= 200 THEN 'HIGH' ELSE 'ELEVATED' END AS map,
 CASE WHEN no2 > 180 THEN 'critical' WHEN no2 > 80 THEN 'high' WHEN no2 > 40 THEN 'moderate' ELSE 'compliant' END AS sim FROM cells""")
def prj_23(t: Tables):
    return t.cells.select(*K, bands.severity(F.col("no2") * 2).alias("map"), bands.severity(F.col("no2"), "simulator").alias("sim"))


@query("prj_27_point_verdict", """
WITH x AS (SELECT area_id, day, row, col, no2 AS v, [no2 * (0.8E0 + u10 / 20), no2 * (1 + v10 / 25)] AS h FROM cells)
SELECT area_id, day, row, col, CASE WHEN v <= 25 THEN 'good' WHEN v <= 80 THEN 'moderate' WHEN v <= 180 THEN 'poor' ELSE 'severe' END AS level, round(v / 25, 6) AS who_multiple,
 CASE WHEN greatest(v, h[1], h[2]) > v * 1.1 THEN 'rising' WHEN h[2] < v * 0.9 THEN 'easing' ELSE 'steady' END AS direction FROM x""")
def prj_27(t: Tables):
    v = F.col("no2")
    x = t.cells.select(*K, v.alias("value"), F.array(v * (F.lit(0.8) + F.col("u10") / 20), v * (F.lit(1.0) + F.col("v10") / 25)).alias("horizons"))
    return X.point_verdict(x).select(*K, "level", r("who_multiple").alias("who_multiple"), "direction")


# --------------------------------------------------------------------------------------------- attribution
def _hav(a, b, c, d):
    return (f"(12742E0 * asin(least(1, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))")


@query("jon_10_attribute_sources", f"""
WITH j AS (SELECT point_id, q.id AS source_id, q.category, round({_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')}, 1) AS km, factor FROM points p, pois q),
w AS (SELECT *, greatest(0.05E0, factor / (pow(km, 1.2) + 0.2E0)) AS weight FROM j WHERE km <= 15)
SELECT point_id, source_id, category, km, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY point_id) * 100, 0) AS percent,
 CAST(row_number() OVER (PARTITION BY point_id ORDER BY weight DESC, source_id) AS INT) AS rank FROM w""")
def jon_10(t: Tables):
    return A.attribute_sources(t.points, t.pois).select("point_id", "source_id", "category", "km", r("weight").alias("weight"), "percent", "rank")


@query("jon_11_plant_influence", """
WITH c AS (SELECT area_id, CAST(r.v AS INT) AS row, CAST(k.v AS INT) AS col, north - res * (r.v + 0.5E0) AS lat, west + res * (k.v + 0.5E0) AS lon, north - height * res / 2 AS lat0
  FROM grids, (SELECT unnest(range(13)) AS v) r, (SELECT unnest(range(10)) AS v) k),
p AS (SELECT lat AS plat, lon AS plon, factor * 500 AS mw FROM pois WHERE category = 'POWER_PLANT')
SELECT area_id, row, col, round(ln(1 + coalesce(sum(mw * exp(-(pow((lon - plon) * 111.32E0 * cos(radians(lat0)), 2) + pow((lat - plat) * 110.57E0, 2)) / 18)), 0)), 6) AS power_plants
FROM c, p GROUP BY 1, 2, 3""")
def jon_11(t: Tables):
    c = G.cell_spine(t.grids).join(t.grids.select("area_id", (F.col("north") - F.col("height") * F.col("res") / 2).alias("lat0")), "area_id")
    p = t.pois.select("lat", "lon", (F.col("factor") * 500).alias("capacity"), F.when(F.col("category") == "POWER_PLANT", "Coal").otherwise("Solar").alias("fuel"))
    return A.plant_influence(c, p).withColumn("power_plants", r("power_plants"))


_LINES = """
ln AS (SELECT p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'railway' WHEN 1 THEN 'motorway' ELSE 'primary' END AS kind, 0.5E0 + (p_size % 4) / 10E0 AS factor,
  north - 0.02E0 - (p_partkey * 29 % 400) / 1000E0 AS la, west + 0.02E0 + (p_partkey * 43 % 300) / 1000E0 AS lo, (p_partkey % 5 - 2) / 200E0 AS dla, (p_partkey % 7 - 3) / 200E0 AS dlo
  FROM part JOIN grids ON area_id = CAST(floor(p_partkey / 400E0) AS INT))"""


def lines(t: Tables):
    k = F.col("p_partkey")
    b = t.part.join(t.grids, F.floor(k / 400.0).cast("int") == F.col("area_id"))
    la, lo = F.col("north") - 0.02 - (k * 29 % 400) / 1000.0, F.col("west") + 0.02 + (k * 43 % 300) / 1000.0
    path = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((la + i * ((k % 5 - 2) / 200.0)).alias("lat"), (lo + i * ((k % 7 - 3) / 200.0)).alias("lon")))
    kind = F.when(F.col("p_size") % 3 == 0, "railway").when(F.col("p_size") % 3 == 1, "motorway").otherwise("primary")
    return b.select(k.alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), (F.lit(0.5) + (F.col("p_size") % 4) / 10.0).alias("factor"), path.alias("path"))


@query("jon_19_main_contributor", f"""
WITH {_LINES}, v AS (SELECT concat('l', CAST(id AS VARCHAR)) AS id, name, kind AS category, factor, i, la + i * dla AS lat, lo + i * dlo AS lon FROM ln, (SELECT unnest(range(4)) AS i) z
  UNION ALL SELECT concat('p', CAST(id AS VARCHAR)), name, category, factor, 0, lat, lon FROM pois),
d AS (SELECT p.point_id, p.lat AS plat, p.lon AS plon, p.point_id % 360 AS wf, v.*, {_hav('p.lat', 'p.lon', 'v.lat', 'v.lon')} AS km FROM points p JOIN v ON abs(v.lat - p.lat) < 0.04 AND abs(v.lon - p.lon) < 0.05),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, id ORDER BY km, i) AS k FROM d WHERE km <= 3) z WHERE k = 1),
b AS (SELECT *, abs(((degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360) % 360 - wf + 540 + 360) % 360 - 180) < 60 AS up FROM o),
w AS (SELECT *, factor / pow(km + 0.3E0, 1.5) * CASE WHEN up THEN 1.5 ELSE 1 END AS w FROM b),
c AS (SELECT point_id, category, sum(w) AS score, count(DISTINCT name) AS sources, min(km) AS km, arg_min(name, km) AS example, arg_min(up, km) AS upwind FROM w GROUP BY 1, 2)
SELECT point_id, category, example, round(km, 6) AS km, upwind, sources, round(share, 6) AS share FROM (SELECT *, score / sum(score) OVER (PARTITION BY point_id) AS share, row_number() OVER (PARTITION BY point_id ORDER BY score DESC) AS k FROM c) z WHERE k = 1""")
def jon_19(t: Tables):
    p = t.points.withColumn("wind_from", (F.col("point_id") % 360).cast("double"))
    return rr(A.main_contributor(p, t.pois, lines(t)))


@query("agg_25_ensemble_fuse", """
WITH p AS (SELECT area_id, day, row, col, no2 AS a, no2 * (1 + u10 / 10) AS b, no2 * (1 + v10 / 10) AS c FROM cells),
f AS (SELECT *, 0.5E0 * a + 0.3E0 * b + 0.2E0 * c AS prediction, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3) AS d FROM p)
SELECT area_id, day, row, col, round(prediction, 6) AS prediction, round(d, 6) AS disagreement,
 round(greatest(0.05E0, least(0.99E0, 1 - d / greatest(1, avg(abs(prediction)) OVER (PARTITION BY area_id)))), 6) AS confidence FROM f""")
def agg_25(t: Tables):
    p = t.cells.select(*K, F.col("no2").alias("a"), (F.col("no2") * (F.lit(1.0) + F.col("u10") / 10)).alias("b"), (F.col("no2") * (F.lit(1.0) + F.col("v10") / 10)).alias("c"))
    return rr(A.ensemble_fuse(p, {"a": 5, "b": 3, "c": 2}).select(*K, "prediction", "disagreement", "confidence"))


_FEATS = ("road_density", "night_lights", "population", "blh", "wind_speed")


def _feature_rows(t: Tables):
    w = t.cells.withColumn("wind_speed", F.sqrt(F.col("u10") * F.col("u10") + F.col("v10") * F.col("v10")))
    j = w.join(t.static, ["area_id", "row", "col"])
    return j.select(F.concat_ws("_", "area_id", "day", "row", "col").alias("instance_id"), F.col("no2").alias("pred"), *_FEATS)


_FROWS = """
fr AS (SELECT concat_ws('_', area_id, day, row, col) AS instance_id, no2 AS pred, road_density, night_lights, population, blh, sqrt(u10 * u10 + v10 * v10) AS wind_speed
       FROM cells JOIN static USING (area_id, row, col)),
ha AS (SELECT instance_id, f.feature, (pred - greatest(10, pred * 0.6E0)) * f.w AS value, CASE f.feature WHEN 'road_density' THEN road_density WHEN 'night_lights' THEN night_lights
       WHEN 'population' THEN population WHEN 'blh' THEN blh ELSE wind_speed END AS actual
       FROM fr, (VALUES ('road_density', 0.38E0, 'Dense road density'), ('night_lights', 0.02E0, ''), ('population', 0.1E0, ''), ('blh', -0.15E0, ''), ('wind_speed', -0.28E0, '')) f(feature, w, l))"""


@query("agg_27_heuristic_attribution", f"WITH {_FROWS} SELECT instance_id, feature, round(value, 6) + 0 AS value, round(actual, 6) AS actual FROM ha")
def agg_27(t: Tables):
    return rr(A.heuristic_attribution(_feature_rows(t), list(_FEATS)))


@query("agg_26_contributions", f"""
WITH {_FROWS}, c AS (SELECT *, round(abs(value) / CASE WHEN sum(abs(value)) OVER (PARTITION BY instance_id) <= 1e-6 THEN 1 ELSE sum(abs(value)) OVER (PARTITION BY instance_id) END * 100, 1) AS percentage FROM ha),
l AS (SELECT *, CASE feature WHEN 'road_density' THEN CASE WHEN actual > 0.5 THEN 'Dense road density' ELSE 'Road density' END WHEN 'night_lights' THEN 'Nighttime luminosity'
   WHEN 'population' THEN CASE WHEN actual > 0.5 THEN 'Dense population density' ELSE 'Population density' END
   WHEN 'blh' THEN CASE WHEN actual < 300 THEN 'Low boundary layer height' ELSE 'High boundary layer height' END ELSE CASE WHEN actual < 300 THEN 'Low wind speed' ELSE 'High wind speed' END END AS label,
   CAST(row_number() OVER (PARTITION BY instance_id ORDER BY percentage DESC, feature) AS INT) AS rank FROM c)
SELECT instance_id, feature, percentage, CASE WHEN value > 0 THEN 'increases_no2' ELSE 'reduces_no2' END AS direction, label, rank,
 concat(string_agg(CASE WHEN rank <= 3 THEN concat(label, ' contributed ', CAST(CAST(round_even(percentage, 0) AS INT) AS VARCHAR), '%') END, ', ' ORDER BY rank) OVER (PARTITION BY instance_id), '.') AS sentence FROM l""")
def agg_26(t: Tables):
    c = A.contributions(A.heuristic_attribution(_feature_rows(t), list(_FEATS)))
    return c.select("instance_id", "feature", "percentage", "direction", "label", "rank", "sentence")


# --------------------------------------------------------------------------------------------- forecasts
_DRIFT = """
px AS (SELECT area_id, width, height, res * 111320E0 * cos(radians(north - height * res / 2)) AS dx, res * 110574E0 AS dy FROM grids),
dr AS (SELECT area_id, day, h, width, height, row AS r0, col AS c0, no2 * (1 - exp(-h / 4)) AS stay, no2 * exp(-h / 4) AS go,
  CAST(floor(col + u10 * h * 3600 / dx + 0.5E0) AS INT) AS c1, CAST(floor(row - v10 * h * 3600 / dy + 0.5E0) AS INT) AS r1 FROM cells JOIN px USING (area_id), (SELECT unnest([1E0, 3E0, 6E0]) AS h) z),
fr AS (SELECT area_id, day, h AS horizon, row, col, sum(v) AS value FROM (SELECT area_id, day, h, r0 AS row, c0 AS col, stay AS v FROM dr
  UNION ALL SELECT area_id, day, h, r1, c1, go FROM dr WHERE r1 BETWEEN 0 AND height - 1 AND c1 BETWEEN 0 AND width - 1) q GROUP BY 1, 2, 3, 4, 5)"""


def frames(t: Tables):
    return P.drift_projection(t.cells, t.grids, (1.0, 3.0, 6.0))


@query("grd_15_drift_projection", f"WITH {_DRIFT} SELECT area_id, day, horizon, row, col, round(value, 6) AS value FROM fr")
def grd_15(t: Tables):
    return rr(frames(t))


@query("grd_16_forecast_alerts", f"""
WITH {_DRIFT}, hs AS (SELECT area_id, day, horizon AS h, max(value) AS mx, avg(CAST(value > 80 AS INT)) AS s FROM fr GROUP BY 1, 2, 3),
g AS (SELECT area_id, day, count(*) AS n, count(*) FILTER (s >= 0.05) AS k, arg_max(s, h) AS last, arg_min(h, h) FILTER (s >= 0.05) AS fh, arg_min(s, h) FILTER (s >= 0.05) AS fs,
  arg_min(h, h) FILTER (mx > 80) AS ph, arg_min(s, h) FILTER (mx > 80) AS ps FROM hs GROUP BY 1, 2),
c AS (SELECT area_id, day, avg(CAST(no2 > 80 AS INT)) AS now FROM cells GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN now >= 0.05 AND k = n THEN 'persisting' WHEN now < 0.05 AND k > 0 THEN 'exceedance_expected' WHEN now >= 0.05 AND last < now - 0.05 THEN 'improving'
  WHEN ph IS NOT NULL THEN 'localized_peak' ELSE 'no_exceedance' END AS code FROM c JOIN g USING (area_id, day))
SELECT area_id, day, code, CASE code WHEN 'persisting' THEN 'critical' WHEN 'exceedance_expected' THEN 'warning' WHEN 'localized_peak' THEN 'warning' ELSE 'info' END AS level,
 CASE code WHEN 'exceedance_expected' THEN fh WHEN 'localized_peak' THEN ph ELSE 24 END AS hours,
 round(CASE code WHEN 'exceedance_expected' THEN fs WHEN 'localized_peak' THEN ps WHEN 'no_exceedance' THEN 0 ELSE last END, 6) AS share FROM j""")
def grd_16(t: Tables):
    h = P.horizon_summary(frames(t)).withColumnRenamed("horizon", "hours")
    now = t.cells.groupBy("area_id", "day").agg(X.share(F.col("no2") > 80).alias("share_now"))
    return X.forecast_alerts(h, now).withColumn("share", r("share")).withColumn("hours", F.col("hours").cast("double"))


@query("grd_18_conserve_mass", f"""
WITH {_DRIFT}, m AS (SELECT area_id, day, horizon, sum(value) AS m FROM fr GROUP BY 1, 2, 3), i AS (SELECT area_id, day, sum(no2) AS m0 FROM cells GROUP BY 1, 2)
SELECT area_id, day, horizon, row, col, round(value * (m0 / m), 6) AS value, round(abs(m - m0) / (m0 + 1e-12), 6) AS mass_error FROM fr JOIN m USING (area_id, day, horizon) JOIN i USING (area_id, day)""")
def grd_18(t: Tables):
    return rr(P.conserve_mass(frames(t), t.cells))


_TRUTH = """tr AS (SELECT area_id, day - CAST(h AS INT) AS day, h AS horizon, row, col, no2 AS value FROM cells, (SELECT unnest([1E0, 3E0, 6E0]) AS h) z)"""


def truth(t: Tables):
    h = F.explode(F.array(F.lit(1.0), F.lit(3.0), F.lit(6.0)))
    return t.cells.withColumn("horizon", h).select("area_id", F.date_sub("day", F.col("horizon").cast("int")).alias("day"), "horizon", "row", "col", F.col("no2").alias("value"))


def _metrics(pred: str) -> str:
    return f"""
jj AS (SELECT f.area_id, f.day, f.horizon, f.value AS p, tr.value AS t, north - res * (f.row + 0.5E0) AS lat, west + res * (f.col + 0.5E0) AS lon
  FROM {pred} f JOIN tr ON tr.area_id = f.area_id AND tr.day = f.day AND tr.horizon = f.horizon AND tr.row = f.row AND tr.col = f.col JOIN grids g ON g.area_id = f.area_id),
mm AS (SELECT area_id, day, horizon, count(*) AS n, sqrt(avg(pow(p - t, 2))) AS rmse, avg(abs(p - t)) AS mae, 1 - sum(pow(p - t, 2)) / nullif(var_pop(t) * count(*), 0) AS r2,
  ((2 * avg(p) * avg(t) + 0.0001E0) * (2 * covar_pop(p, t) + 0.0009E0)) / ((pow(avg(p), 2) + pow(avg(t), 2) + 0.0001E0) * (var_pop(p) + var_pop(t) + 0.0009E0) + 1e-12) AS ssim,
  count(*) FILTER (p >= 40 AND t >= 40) / CAST(nullif(count(*) FILTER (p >= 40 OR t >= 40), 0) AS DOUBLE) AS iou, abs(sum(p) - sum(t)) / sum(t) AS mass_error,
  {_hav('sum(lat * p) / sum(p)', 'sum(lon * p) / sum(p)', 'sum(lat * t) / sum(t)', 'sum(lon * t) / sum(t)')} AS displacement_km FROM jj GROUP BY 1, 2, 3)"""


@query("agg_16_forecast_metrics", f"""
WITH {_DRIFT}, {_TRUTH}, {_metrics('fr')} SELECT area_id, day, horizon, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, CASE WHEN n >= 2 THEN round(r2, 4) END AS r2, round(ssim, 4) + 0 AS ssim,
 round(iou, 4) AS iou, round(mass_error, 4) AS mass_error, round(displacement_km, 4) AS displacement_km FROM mm""")
def agg_16(t: Tables):
    return rr(P.forecast_metrics(frames(t), truth(t), t.grids), 4)


@query("agg_17_compare_forecasts", f"""
WITH {_DRIFT}, {_TRUTH}, {_metrics('fr')}, hy AS (SELECT area_id, day, horizon, row, col, value * 0.6E0 + 8 AS value FROM fr),
{_metrics('hy').replace('jj', 'j2').replace('mm AS', 'm2 AS')},
a AS (SELECT area_id, {', '.join(f'avg({s}) AS {s}' for s in P.SCORES)} FROM mm GROUP BY 1), b AS (SELECT area_id, {', '.join(f'avg({s}) AS {s}' for s in P.SCORES)} FROM m2 GROUP BY 1)
{' UNION ALL '.join(f"SELECT area_id, '{s}' AS score, round(a.{s}, 4) AS physics, round(b.{s}, 4) AS hybrid, round(b.{s} - a.{s}, 4) AS improvement FROM a JOIN b USING (area_id)" for s in P.SCORES)}""")
def agg_17(t: Tables):
    f = frames(t)
    return rr(P.compare_forecasts(f, f.withColumn("value", F.col("value") * 0.6 + 8), truth(t), t.grids), 4)


@query("jon_20_forecast_at_points", f"""
WITH {_DRIFT}, p AS (SELECT point_id, area_id, CAST(floor((north - lat) / res) AS INT) AS r, CAST(floor((lon - west) / res) AS INT) AS c, width, height FROM points JOIN grids USING (area_id))
SELECT point_id, day, horizon, r BETWEEN 0 AND height - 1 AND c BETWEEN 0 AND width - 1 AS inside, round(value, 6) AS value, round(0.5E0 * exp(-horizon / 24), 6) AS confidence
FROM p JOIN fr ON fr.area_id = p.area_id AND fr.row = least(greatest(r, 0), height - 1) AND fr.col = least(greatest(c, 0), width - 1)""")
def jon_20(t: Tables):
    return rr(P.forecast_at_points(frames(t), t.points, t.grids)).select("point_id", "day", "horizon", "inside", "value", "confidence")


@query("jon_13_wind_at", """
WITH e AS (SELECT event_id, CAST(floor(user_id / 30E0) AS INT) AS series_id, hour(ts) AS h, value, hour(ts) + minute(ts) / 60E0 + 0.25E0 AS hours FROM events),
hr AS (SELECT series_id, h, avg(value) AS u, min(value) AS v FROM e GROUP BY 1, 2), l AS (SELECT series_id, max(h) AS last FROM hr GROUP BY 1),
s AS (SELECT event_id, series_id, hours, last, CAST(floor(hours) AS INT) AS i0, hours - floor(hours) AS a FROM e JOIN l USING (series_id))
SELECT event_id, round(CASE WHEN i0 >= last THEN z.u ELSE x.u * (1 - a) + y.u * a END, 6) AS u, round(CASE WHEN i0 >= last THEN z.v ELSE x.v * (1 - a) + y.v * a END, 6) AS v
FROM s LEFT JOIN hr x ON x.series_id = s.series_id AND x.h = i0 LEFT JOIN hr y ON y.series_id = s.series_id AND y.h = i0 + 1 LEFT JOIN hr z ON z.series_id = s.series_id AND z.h = last""")
def jon_13(t: Tables):
    e = t.events.select("event_id", F.floor(F.col("user_id") / 30.0).cast("int").alias("series_id"), F.hour("ts").alias("h"), "value",
                        (F.hour("ts") + F.minute("ts") / 60.0 + 0.25).alias("hours"))
    hourly = e.groupBy("series_id", "h").agg(F.avg("value").alias("u"), F.min("value").alias("v"))
    return P.wind_at(e.select("event_id", "series_id", "hours"), hourly).select("event_id", r("u").alias("u"), r("v").alias("v"))


def _scn(name: str) -> str:
    return f"('{name}', CAST('{P.scenario_scale(P.PRESETS[name])!r}' AS DOUBLE))"


_SWEEP = f"""
bg AS (SELECT area_id, day, greatest(15, least(35, quantile_cont(no2, 0.1))) AS b FROM cells GROUP BY 1, 2),
sc(scenario, k) AS (VALUES {', '.join(_scn(n) for n in P.PRESETS)}),
sw AS (SELECT scenario, area_id, day, row, col, no2 AS base, greatest(0, b + greatest(0, no2 - b) * k) AS sim FROM cells JOIN bg USING (area_id, day), sc)"""


@query("grd_17_scenario_sweep", f"WITH {_SWEEP} SELECT scenario, area_id, day, row, col, round(sim, 6) AS sim FROM sw")
def grd_17(t: Tables):
    return P.scenario_sweep(t.cells).select("scenario", *K, r("sim").alias("sim"))


@query("agg_18_compute_impact", f"""
WITH {_SWEEP}, j AS (SELECT sw.*, coalesce(population, 0) AS pop FROM sw LEFT JOIN static USING (area_id, row, col)),
g AS (SELECT scenario, area_id, day, max(base) AS bp, max(sim) AS sp, avg(base) AS bm, avg(sim) AS sm, CAST(coalesce(sum(pop) FILTER (base > 80), 0) AS BIGINT) AS be, CAST(coalesce(sum(pop) FILTER (sim > 80), 0) AS BIGINT) AS se,
 CAST(coalesce(sum(pop) FILTER (base > 25), 0) AS BIGINT) AS bw, CAST(coalesce(sum(pop) FILTER (sim > 25), 0) AS BIGINT) AS sw2, (sum(row * sim) / sum(sim) - sum(row * base) / sum(base)) * 0.25E0 AS dr, (sum(col * sim) / sum(sim) - sum(col * base) / sum(base)) * 0.25E0 AS dc FROM j GROUP BY 1, 2, 3),
h AS (SELECT *, CASE WHEN bp > 180 THEN 'CRITICAL' WHEN bp > 80 THEN 'EXCEEDANCE' ELSE 'COMPLIANT' END AS bc, CASE WHEN sp > 180 THEN 'CRITICAL' WHEN sp > 80 THEN 'EXCEEDANCE' ELSE 'COMPLIANT' END AS sc2 FROM g)
SELECT scenario, area_id, day, round(bp, 4) AS base_peak, round(sp, 4) AS sim_peak, round(sp - bp, 4) AS peak_change, round((sp - bp) / bp * 100, 4) AS peak_pct, round(sm - bm, 4) AS mean_change, round((sm - bm) / bm * 100, 4) AS mean_pct,
 be AS base_exposed, se AS sim_exposed, bw AS base_who_exposed, sw2 AS sim_who_exposed, round(sqrt(dr * dr + dc * dc), 4) AS shift_km, bc AS base_compliance, sc2 AS sim_compliance,
 sp < bp OR (sc2 <> bc AND bc IN ('CRITICAL', 'EXCEEDANCE') AND sc2 <> 'CRITICAL') AS improved FROM h""")
def agg_18(t: Tables):
    return rr(P.compute_impact(P.scenario_sweep(t.cells), t.static).drop("shift_heading"), 4)


@query("prj_17_normalise_channels", """
SELECT area_id, day, row, col, round(ln(1 + greatest(no2, 0)) / (1 + 1e-8), 6) AS no2, round(u10 / (5 + 1e-8), 6) AS wind_u, round(ln(1 + greatest(blh, 0)) / (1 + 1e-8), 6) AS blh FROM cells""")
def prj_17(t: Tables):
    return rr(P.normalise_channels(t.cells.select(*K, "no2", F.col("u10").alias("wind_u"), "blh"), ["no2", "wind_u", "blh"]))


@query("win_09_sequence_samples")
def win_09(t: Tables):
    return P.sequence_samples(G.densify_days(t.cells, t.grids), max_null=0.4)


@query("win_09_patch_samples", f"""
WITH {DENSE}, p AS (SELECT d.area_id, d.day, pr.v * 2 AS patch_row, pc.v * 2 AS patch_col, d.no2, d.u10, d.v10 FROM dense d JOIN grids USING (area_id), (SELECT unnest(range(10)) AS v) pr, (SELECT unnest(range(10)) AS v) pc
 WHERE d.row BETWEEN pr.v * 2 AND pr.v * 2 + 3 AND d.col BETWEEN pc.v * 2 AND pc.v * 2 + 3 AND pr.v * 2 + 4 <= height AND pc.v * 2 + 4 <= width),
b AS (SELECT area_id, patch_row, patch_col, day, count(*) FILTER (no2 IS NULL) AS n0, count(*) FILTER (u10 IS NULL) + count(*) FILTER (v10 IS NULL) AS nw, coalesce(sum(no2), 0) AS s, coalesce(sum(u10), 0) AS su FROM p GROUP BY 1, 2, 3, 4),
f AS (SELECT *, n0 + sum(n0) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) + sum(n0 + nw) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS absent,
 sum(s) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS input_no2, sum(su) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS input_u10,
 sum(s) OVER (w ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING) AS target_no2, lead(day, 7) OVER w AS last_day FROM b WINDOW w AS (PARTITION BY area_id, patch_row, patch_col ORDER BY day))
SELECT area_id, CAST(patch_row AS INT) AS patch_row, CAST(patch_col AS INT) AS patch_col, day AS start_day, 4 AS frames, 4 AS channels, 16 AS cells, 4 AS target_frames, round(absent / 256E0, 6) AS null_share,
 round(input_no2, 4) AS input_no2, round(input_u10, 4) AS input_u10, round(target_no2, 4) AS target_no2 FROM f WHERE last_day IS NOT NULL AND absent / 256E0 <= 0.3E0""")
def win_09_patches(t: Tables):
    """Patch samples of 4 x 4 cells by their shape, missing share and sums."""
    s = P.patch_samples(G.densify_days(t.cells, t.grids), t.grids, ("no2", "u10", "v10"), 4, 2)
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4)
    return s.select("area_id", "patch_row", "patch_col", "start_day", F.size("inputs").alias("frames"), F.size(F.col("inputs")[0]).alias("channels"), F.size(F.col("inputs")[0][0]).alias("cells"),
                    F.size("targets").alias("target_frames"), F.round("null_share", 6).alias("null_share"), total(F.flatten(F.transform("inputs", lambda f: f[0]))).alias("input_no2"),
                    total(F.flatten(F.transform("inputs", lambda f: f[1]))).alias("input_u10"), total(F.flatten("targets")).alias("target_no2"))


@query("udx_03_custom_scenario", f"""
WITH bg AS (SELECT area_id, day, greatest(15, least(35, quantile_cont(no2, 0.1))) AS b FROM cells GROUP BY 1, 2)
SELECT 'half' AS scenario, area_id, day, row, col, round(b * 0.9E0 + greatest(0, no2 - b) * CAST('{P.scenario_scale({"traffic": 0.5, "industrial": 0.5})!r}' AS DOUBLE), 6) AS sim FROM cells JOIN bg USING (area_id, day)""")
def udx_03(t: Tables):
    """A caller's own scenario."""
    own = {"half": {"traffic": 0.5, "industrial": 0.5, "background": 0.9}}
    return P.scenario_sweep(t.cells, own).select("scenario", *K, r("sim").alias("sim"))
