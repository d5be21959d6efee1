"""Queries over gridded cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridair.adapters import Tables
from gridair.functions import bands, units, wind
from gridair.operators import cells as G
from gridair.plans.registry import query

K = ["area_id", "day", "row", "col"]


def r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# Dense cells: every cell of every area on every day of the area's span.
DENSE = """
dsp AS (SELECT area_id, min(day) AS a, max(day) AS b FROM cells GROUP BY 1),
days AS (SELECT area_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM dsp),
sp AS (SELECT area_id, CAST(r.v AS INT) AS row, CAST(c.v AS INT) AS col, north - res * (r.v + 0.5E0) AS lat,
              west + res * (c.v + 0.5E0) AS lon
       FROM grids, (SELECT unnest(range(13)) AS v) r, (SELECT unnest(range(10)) AS v) c),
dense AS (SELECT d.area_id, d.day, sp.row, sp.col, c.no2, c.u10, c.v10, c.blh, sp.lat, sp.lon
          FROM days d JOIN sp USING (area_id)
          LEFT JOIN cells c ON c.area_id = d.area_id AND c.day = d.day AND c.row = sp.row AND c.col = sp.col)"""


def dense(t: Tables):
    return G.densify_days(t.cells, t.grids)


@query("grd_01_cell_spine", f"WITH {DENSE} SELECT area_id, row, col, round(lat, 6) AS lat, round(lon, 6) AS lon FROM sp")
def grd_01(t: Tables):
    return G.cell_spine(t.grids).withColumn("lat", r("lat")).withColumn("lon", r("lon"))


@query("grd_01_make_grid", """
WITH b AS (SELECT s_suppkey AS area_id, 70E0 AS west, 18E0 AS south, 70.1E0 + s_suppkey / 100E0 AS east,
                  18.2E0 + s_nationkey / 50E0 AS north FROM supplier)
SELECT area_id, west, north, 0.035E0 / 14 AS res,
       14 * greatest(1, CAST(ceil(round((east - west) / 0.035E0, 9)) AS INT)) AS width,
       14 * greatest(1, CAST(ceil(round((north - south) / 0.035E0, 9)) AS INT)) AS height FROM b""")
def grd_01b(t: Tables):
    b = t.supplier.select(F.col("s_suppkey").alias("area_id"), F.lit(70.0).alias("west"), F.lit(18.0).alias("south"),
                          (F.lit(70.1) + F.col("s_suppkey") / 100.0).alias("east"),
                          (F.lit(18.2) + F.col("s_nationkey") / 50.0).alias("north"))
    return G.refine(G.make_grid(b, 0.035), 14)


@query("jon_01_to_cell", """
SELECT point_id, CAST(floor((north - lat) / res) AS INT) AS row, CAST(floor((lon - west) / res) AS INT) AS col,
       floor((north - lat) / res) BETWEEN 0 AND height - 1 AND floor((lon - west) / res) BETWEEN 0 AND width - 1 AS inside
FROM points JOIN grids USING (area_id)""")
def jon_01(t: Tables):
    return G.to_cell(t.points, t.grids).select("point_id", "row", "col", "inside")


_ORDERS_AT = """
o AS (SELECT o_orderkey, area_id, lat, lon, DATE '2024-01-01' + CAST(o_orderkey % 83 AS INT) AS day
      FROM orders JOIN points ON point_id = o_custkey)"""


def _orders_at(t: Tables):
    return t.orders.join(t.points, F.col("point_id") == F.col("o_custkey")).select(
        "o_orderkey", "area_id", "lat", "lon",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 83).cast("int")).alias("day"))


@query("jon_02_sample_at_stations", f"""
WITH {_ORDERS_AT} SELECT o_orderkey, c.row, c.col, round(no2, 6) AS predicted FROM o JOIN grids USING (area_id)
JOIN cells c ON c.area_id = o.area_id AND c.day = o.day AND c.row = CAST(floor((north - lat) / res) AS INT)
     AND c.col = CAST(floor((lon - west) / res) AS INT)""")
def jon_02(t: Tables):
    return G.sample_at_stations(t.cells, _orders_at(t), t.grids).select("o_orderkey", "row", "col", r("predicted").alias("predicted"))


@query("src_03_area_span", """
SELECT area_id, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days FROM cells GROUP BY 1""")
def src_03(t: Tables):
    return G.area_span(G.check_one_row_per_cell(t.cells))


@query("src_04_normalise_units", """
WITH m AS (SELECT area_id, day, row, col, CASE WHEN area_id % 2 = 1 THEN no2 / 1000000 ELSE no2 END AS no2 FROM cells),
q AS (SELECT area_id, quantile_cont(abs(no2), 0.5) AS md FROM m GROUP BY 1)
SELECT area_id, day, row, col, round(CASE WHEN md < 0.01 THEN no2 * 1000000 ELSE no2 END, 6) AS no2
FROM m JOIN q USING (area_id)""")
def src_04(t: Tables):
    mixed = t.cells.select(*K, F.when(F.col("area_id") % 2 == 1, F.col("no2") / 1e6).otherwise(F.col("no2")).alias("no2"))
    return G.normalise_units(mixed).select(*K, r("no2").alias("no2"))


@query("src_06_densify_days", f"WITH {DENSE} SELECT area_id, day, row, col, no2, blh FROM dense")
def src_06(t: Tables):
    return dense(t).select(*K, "no2", "blh")


@query("prj_03_screen_clouds", """
SELECT row, col, ts, CASE WHEN cloud_fraction < 0.3E0 THEN no2 END AS no2 FROM global_obs""")
def prj_03(t: Tables):
    return G.screen_clouds(t.global_obs).select("row", "col", "ts", "no2")


@query("udx_01_screen_by_rule", """
SELECT row, col, ts, CASE WHEN u * u + v * v < 36 THEN no2 END AS no2 FROM global_obs""")
def udx_01(t: Tables):
    return G.screen(t.global_obs, lambda d: d["u"] * d["u"] + d["v"] * d["v"] < 36).select("row", "col", "ts", "no2")


@query("prj_05_column_to_surface", """
SELECT area_id, day, row, col, round(no2 * 46.0055E0 / greatest(blh, 50), 6) AS conc FROM cells""")
def prj_05(t: Tables):
    return t.cells.select(*K, r(units.column_to_surface(F.col("no2"), F.col("blh"))).alias("conc"))


@query("prj_06_fill_blh", f"""
WITH {DENSE} SELECT area_id, day, row, col,
 round(coalesce(blh, greatest(200, least(3000, 250 + 35 * greatest(0, least(45, 300E0 - row / 2E0 - 273.15E0)) + 90 * sqrt(2.25E0 + col * col / 100E0)))), 6) AS blh
FROM dense""")
def prj_06(t: Tables):
    est = wind.estimate_blh(F.lit(300.0) - F.col("row") / 2.0, F.lit(1.5), F.col("col") / 10.0)
    return dense(t).select(*K, r(F.coalesce("blh", est)).alias("blh"))


_C8 = "['N','NE','E','SE','S','SW','W','NW']"
_C16 = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"


@query("prj_08_wind_columns", f"""
WITH w AS (SELECT area_id, day, row, col, sqrt(u10 * u10 + v10 * v10) AS ws, (degrees(atan2(-u10, -v10)) + 360) % 360 AS f,
                  (degrees(atan2(u10, v10)) + 360) % 360 AS t FROM cells)
SELECT area_id, day, row, col, round(ws, 6) AS speed, round(f, 6) AS from_deg, round(t, 6) AS to_deg,
       ({_C8})[1 + CAST(floor((f + 22.5E0) / 45) AS INT) % 8] AS compass8,
       ({_C16})[1 + CAST(floor((f + 11.25E0) / 22.5E0) AS INT) % 16] AS compass16 FROM w""")
def prj_08(t: Tables):
    u, v = F.col("u10"), F.col("v10")
    f = wind.from_deg(u, v)
    return t.cells.select(*K, r(wind.speed(u, v)).alias("speed"), r(f).alias("from_deg"), r(wind.to_deg(u, v)).alias("to_deg"),
                          wind.compass(f).alias("compass8"), wind.compass(f, 16).alias("compass16"))


@query("prj_09_hazard_band", """
WITH x AS (SELECT area_id, day, row, col, no2 - 5 AS v FROM cells)
SELECT area_id, day, row, col,
       CASE WHEN v < 40 THEN 'Normal' WHEN v < 80 THEN 'Moderate' WHEN v < 180 THEN 'Unhealthy' ELSE 'Hazardous' END AS band,
       CASE WHEN v < 0 THEN 0 WHEN v < 40 THEN 1 WHEN v < 80 THEN 2 WHEN v < 180 THEN 3 ELSE 4 END AS code,
       CASE WHEN v < 40 THEN '#2e7d32' WHEN v < 80 THEN '#f9a825' WHEN v < 180 THEN '#ef6c00' ELSE '#c62828' END AS color,
       CASE WHEN v <= 40 THEN 'Normal' WHEN v <= 80 THEN 'Moderate' WHEN v <= 180 THEN 'Unhealthy' ELSE 'Hazardous' END AS shown
FROM x""")
def prj_09(t: Tables):
    v = F.col("no2") - 5
    return t.cells.select(*K, bands.hazard_band(v).alias("band"), bands.hazard_code(v).alias("code"),
                          bands.hazard_band(v, "color").alias("color"), bands.display_band(v).alias("shown"))


@query("prj_18_surface_indices", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS b8, l_tax * 100 + 20 AS b4, l_discount * 300 AS b11,
                  CAST(l_partkey % 12 AS INT) AS scl FROM lineitem),
i AS (SELECT *, (b8 - b4) / (b8 + b4) AS n, (b11 - b8) / (b11 + b8) AS d FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN scl NOT IN (3, 8, 9, 10, 11) THEN round(n, 6) END AS ndvi,
       CASE WHEN scl NOT IN (3, 8, 9, 10, 11) THEN CASE WHEN d > 0 AND n < 0.3 THEN 1E0 ELSE 0E0 END END AS built_up
FROM i""")
def prj_18(t: Tables):
    from gridair.operators.scenes import surface_indices
    s = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("b8"), (F.col("l_tax") * 100 + 20).alias("b4"),
                          (F.col("l_discount") * 300).alias("b11"), (F.col("l_partkey") % 12).cast("int").alias("scl"))
    return surface_indices(s).select("l_orderkey", "l_linenumber", r("ndvi").alias("ndvi"), "built_up")


@query("prj_19_scale_flux", """
SELECT area_id, day, row, col, round(no2 / 3600, 8) AS ssrd, round(no2 * 1000, 4) AS tp, round(no2 / 86400, 8) AS sshf FROM cells""")
def prj_19(t: Tables):
    x = F.col("no2")
    return t.cells.select(*K, r(units.scale_flux("ssrd", x), 8).alias("ssrd"), r(units.scale_flux("tp", x), 4).alias("tp"),
                          r(units.scale_flux("sshf", x, daily=True), 8).alias("sshf"))


@query("prj_20_overpass_utc_hour", "SELECT point_id, round((13.5E0 - lon / 15E0 + 48) % 24, 6) AS hour FROM points")
def prj_20(t: Tables):
    return t.points.select("point_id", r(units.overpass_utc_hour(F.col("lon"))).alias("hour"))


@query("prj_24_fill_day_mean", f"""
WITH {DENSE} SELECT area_id, day, row, col,
 round(coalesce(no2, avg(no2) OVER (PARTITION BY area_id, day), 45), 6) AS no2 FROM dense""")
def prj_24(t: Tables):
    return G.fill_day_mean(dense(t)).select(*K, r("no2").alias("no2"))


@query("prj_25_diurnal_wind", """
SELECT station_id, ts, round(4.5E0 + 2.5E0 * cos(2 * pi() * hour(ts) / 24), 6) AS u,
       round(3 + 1.8E0 * sin(2 * pi() * hour(ts) / 24), 6) AS v FROM stations_hourly""")
def prj_25(t: Tables):
    h = F.hour("ts").cast("double")
    return t.stations_hourly.select("station_id", "ts", r(wind.diurnal_u(h)).alias("u"), r(wind.diurnal_v(h)).alias("v"))


@query("agg_04_day_coverage", f"""
WITH {DENSE} SELECT area_id, day, round(count(no2) / CAST(count(*) AS DOUBLE), 6) AS coverage,
 CASE WHEN count(no2) / CAST(count(*) AS DOUBLE) >= 0.2 THEN 'model' ELSE 'fallback' END AS method FROM dense GROUP BY 1, 2""")
def agg_04(t: Tables):
    return G.day_coverage(dense(t)).withColumn("coverage", r("coverage"))


@query("agg_05_climatology", "SELECT area_id, row, col, round(avg(no2), 6) AS climatology FROM cells GROUP BY 1, 2, 3")
def agg_05(t: Tables):
    return G.climatology(t.cells).withColumn("climatology", r("climatology"))


@query("agg_05_day_mean", "SELECT area_id, day, round(avg(no2), 6) AS day_mean FROM cells GROUP BY 1, 2")
def agg_05b(t: Tables):
    return G.day_mean(t.cells).withColumn("day_mean", r("day_mean"))


@query("agg_07_block_mean", """
SELECT area_id, day, CAST(floor(row / 3E0) AS INT) AS row, CAST(floor(col / 3E0) AS INT) AS col, round(avg(no2), 6) AS no2
FROM cells GROUP BY 1, 2, 3, 4""")
def agg_07(t: Tables):
    return G.block_mean(t.cells, 3).withColumn("no2", r("no2"))


@query("agg_08_coarsen_valid", f"""
WITH {DENSE} SELECT area_id, day, CAST(floor(row / 3E0) AS INT) AS row, CAST(floor(col / 3E0) AS INT) AS col,
 round(count(no2) / CAST(count(*) AS DOUBLE), 6) AS valid_fraction,
 CASE WHEN count(no2) / CAST(count(*) AS DOUBLE) >= 0.5 THEN round(avg(no2), 6) END AS no2 FROM dense GROUP BY 1, 2, 3, 4""")
def agg_08(t: Tables):
    return G.coarsen_valid(dense(t), 3).withColumn("no2", r("no2")).withColumn("valid_fraction", r("valid_fraction"))


@query("agg_13_column_stats", f"""
WITH {DENSE}, f AS (SELECT area_id, day, coalesce(no2, avg(no2) OVER (PARTITION BY area_id, day), 45) AS x FROM dense),
g AS (SELECT area_id, day, round(avg(x), 6) AS filled_mean FROM f GROUP BY 1, 2)
SELECT area_id, day, round(avg(no2), 6) AS observed_mean, round(max(no2), 6) AS observed_max,
 round(1 - count(no2) / CAST(count(*) AS DOUBLE), 6) AS cloud_share, any_value(filled_mean) AS filled_mean
FROM dense JOIN g USING (area_id, day) GROUP BY 1, 2""")
def agg_13(t: Tables):
    d = dense(t)
    s = G.column_stats(d, G.fill_day_mean(d))
    return s.select("area_id", "day", *[r(c).alias(c) for c in ("observed_mean", "observed_max", "cloud_share", "filled_mean")])


@query("agg_28_median_composite", """
SELECT area_id, row, col, round(quantile_cont(no2, 0.5), 6) AS no2 FROM cells GROUP BY 1, 2, 3""")
def agg_28(t: Tables):
    return G.median_composite(t.cells, ["area_id", "row", "col"], "no2").withColumn("no2", r("no2"))


@query("agg_33_available_dates", """
SELECT area_id, list_sort(list(DISTINCT day)) AS days, count(DISTINCT day) AS n FROM cells GROUP BY 1""")
def agg_33(t: Tables):
    return G.available_dates(t.cells)


# Coarse fields without gaps for the resampling queries.
FILLED = DENSE + """,
filled AS MATERIALIZED (SELECT area_id, day, row, col, coalesce(no2, avg(no2) OVER (PARTITION BY area_id, day), 45) AS no2,
                  u10, v10, blh, lat, lon FROM dense)"""


def filled(t: Tables):
    return G.fill_day_mean(dense(t))


@query("jon_17_upsample_bilinear", f"""
WITH {FILLED}, s AS (SELECT unnest(range(2)) AS k),
f AS (SELECT area_id, day, row AS r0, col AS c0, row * 2 + a.k AS row, col * 2 + b.k AS col,
             CASE WHEN a.k = 0 THEN greatest(row - 1, 0) ELSE least(row + 1, 12) END AS r1,
             CASE WHEN b.k = 0 THEN greatest(col - 1, 0) ELSE least(col + 1, 9) END AS c1, no2 AS v00
      FROM filled, s a, s b)
SELECT f.area_id, f.day, CAST(f.row AS INT) AS row, CAST(f.col AS INT) AS col,
       round(0.75E0 * (0.75E0 * v00 + 0.25E0 * x.no2) + 0.25E0 * (0.75E0 * y.no2 + 0.25E0 * z.no2), 6) AS no2
FROM f JOIN filled x ON x.area_id = f.area_id AND x.day = f.day AND x.row = r0 AND x.col = c1
JOIN filled y ON y.area_id = f.area_id AND y.day = f.day AND y.row = r1 AND y.col = c0
JOIN filled z ON z.area_id = f.area_id AND z.day = f.day AND z.row = r1 AND z.col = c1""")
def jon_17(t: Tables):
    return G.upsample_bilinear(filled(t), 2, ["no2"]).withColumn("no2", r("no2"))


@query("jon_18_upsample_repeat", """
SELECT area_id, day, CAST(row * 2 + a.k AS INT) AS row, CAST(col * 2 + b.k AS INT) AS col, no2
FROM cells, (SELECT unnest(range(2)) AS k) a, (SELECT unnest(range(2)) AS k) b""")
def jon_18(t: Tables):
    return G.upsample_repeat(t.cells, 2, ["no2"])


@query("win_02_pixel_lags", f"""
WITH {DENSE} SELECT area_id, day, row, col, lag(no2, 1) OVER w AS lag1, lag(no2, 2) OVER w AS lag2 FROM dense
WINDOW w AS (PARTITION BY area_id, row, col ORDER BY day)""")
def win_02(t: Tables):
    return G.pixel_lags(dense(t)).select(*K, "lag1", "lag2")


_MOSAIC = """
mos AS (SELECT *, coalesce(quantile_cont(no2, 0.5) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
                           quantile_cont(no2, 0.5) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING),
                           quantile_cont(no2, 0.5) OVER (w ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) AS mosaic
        FROM dense WINDOW w AS (PARTITION BY area_id, row, col ORDER BY day))"""


@query("win_04_median_mosaic", f"WITH {DENSE}, {_MOSAIC} SELECT area_id, day, row, col, round(mosaic, 6) AS mosaic FROM mos")
def win_04(t: Tables):
    return G.median_mosaic(dense(t)).select(*K, r("mosaic").alias("mosaic"))


@query("win_05_recent_baseline", f"""
WITH {DENSE} SELECT area_id, day, row, col,
 round(CASE WHEN row_number() OVER w > 3 THEN quantile_cont(no2, 0.5) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END, 6) AS baseline
FROM dense WINDOW w AS (PARTITION BY area_id, row, col ORDER BY day)""")
def win_05(t: Tables):
    return G.recent_baseline(dense(t)).select(*K, r("baseline").alias("baseline"))


@query("win_07_neighbourhood_mean", f"""
WITH {DENSE} SELECT d.area_id, d.day, d.row, d.col,
 round(avg(n.no2) FILTER (abs(n.row - d.row) <= 1 AND abs(n.col - d.col) <= 1 AND NOT (n.row = d.row AND n.col = d.col)), 6) AS ring3,
 round(avg(n.no2) FILTER (NOT (n.row = d.row AND n.col = d.col)), 6) AS ring5
FROM dense d JOIN dense n ON n.area_id = d.area_id AND n.day = d.day AND abs(n.row - d.row) <= 2 AND abs(n.col - d.col) <= 2
GROUP BY 1, 2, 3, 4""")
def win_07(t: Tables):
    d = G.neighbourhood_mean(G.neighbourhood_mean(dense(t), 3, "ring3"), 5, "ring5")
    return d.select(*K, r("ring3").alias("ring3"), r("ring5").alias("ring5"))


@query("win_08_interpolate_linear", f"""
WITH {DENSE}, p AS (SELECT *, last_value(CASE WHEN no2 IS NOT NULL THEN day END IGNORE NULLS) OVER w AS bd,
   last_value(no2 IGNORE NULLS) OVER w AS bv, first_value(CASE WHEN no2 IS NOT NULL THEN day END IGNORE NULLS) OVER x AS ad,
   first_value(no2 IGNORE NULLS) OVER x AS av FROM dense
 WINDOW w AS (PARTITION BY area_id, row, col ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        x AS (PARTITION BY area_id, row, col ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT area_id, day, row, col,
 round(coalesce(no2, bv + (av - bv) * (CAST(day - bd AS DOUBLE) / nullif(ad - bd, 0)), bv, av), 6) AS no2 FROM p""")
def win_08(t: Tables):
    return G.interpolate_linear(dense(t)).select(*K, r("no2").alias("no2"))


@query("grd_07_gradient", """
SELECT area_id, row, col,
 round(CASE WHEN l IS NULL THEN rr - elevation WHEN rr IS NULL THEN elevation - l ELSE (rr - l) / 2 END, 6) AS gx,
 round(CASE WHEN u IS NULL THEN d - elevation WHEN d IS NULL THEN elevation - u ELSE (d - u) / 2 END, 6) AS gy
FROM (SELECT *, lag(elevation) OVER w AS l, lead(elevation) OVER w AS rr, lag(elevation) OVER v AS u, lead(elevation) OVER v AS d
      FROM static WINDOW w AS (PARTITION BY area_id, row ORDER BY col), v AS (PARTITION BY area_id, col ORDER BY row)) x""")
def grd_07(t: Tables):
    return G.gradient(t.static, "elevation").select("area_id", "row", "col", r("gx").alias("gx"), r("gy").alias("gy"))


@query("prj_22_terrain_wind")
def prj_22(t: Tables):
    w = G.climatology(t.cells, "u10").withColumnRenamed("climatology", "u10").join(
        G.climatology(t.cells, "v10").withColumnRenamed("climatology", "v10"), ["area_id", "row", "col"])
    full = t.static.join(w, ["area_id", "row", "col"]).join(G.pixel_size(t.grids), "area_id")
    return G.terrain_wind(full).select("area_id", "row", "col", "drag", "u_terrain", "v_terrain")


@query("jon_14_blend_days", """
SELECT a.area_id, a.day, a.row, a.col, round(coalesce(a.no2 * (1 - w) + b.no2 * w, a.no2), 6) AS blended
FROM (SELECT *, (row / 12E0) * (row / 12E0) * (3 - 2 * (row / 12E0)) AS w FROM cells) a
LEFT JOIN cells b ON b.area_id = a.area_id AND b.day = a.day + 1 AND b.row = a.row AND b.col = a.col""")
def jon_14(t: Tables):
    return G.blend_days(t.cells, F.col("row") / 12.0).select(*K, r("blended").alias("blended"))


@query("jon_15_upwind_value", f"""
WITH {FILLED}, w AS (SELECT area_id, day, avg(u10) AS u, avg(v10) AS v FROM cells GROUP BY 1, 2),
s AS (SELECT w.*, 5000 / (res * 111320E0 * cos(radians(north - height * res / 2))) * u / sqrt(u * u + v * v) AS cx,
             5000 / (res * 110574E0) * v / sqrt(u * u + v * v) AS cy
      FROM w JOIN grids USING (area_id) WHERE sqrt(u * u + v * v) > 1),
p AS (SELECT f.area_id, f.day, f.row, f.col, greatest(0, least(12, f.row + cy)) AS y, greatest(0, least(9, f.col - cx)) AS x
      FROM filled f JOIN s USING (area_id, day)),
k AS (SELECT *, CAST(floor(y) AS INT) AS y0, CAST(floor(x) AS INT) AS x0, least(CAST(floor(y) AS INT) + 1, 12) AS y1,
             least(CAST(floor(x) AS INT) + 1, 9) AS x1, y - floor(y) AS fy, x - floor(x) AS fx FROM p)
SELECT f.area_id, f.day, f.row, f.col, round((1 - fy) * ((1 - fx) * a.no2 + fx * b.no2) + fy * ((1 - fx) * c.no2 + fx * d.no2), 6) AS upwind
FROM filled f LEFT JOIN k USING (area_id, day, row, col)
LEFT JOIN filled a ON a.area_id = k.area_id AND a.day = k.day AND a.row = y0 AND a.col = x0
LEFT JOIN filled b ON b.area_id = k.area_id AND b.day = k.day AND b.row = y0 AND b.col = x1
LEFT JOIN filled c ON c.area_id = k.area_id AND c.day = k.day AND c.row = y1 AND c.col = x0
LEFT JOIN filled d ON d.area_id = k.area_id AND d.day = k.day AND d.row = y1 AND d.col = x1""")
def jon_15(t: Tables):
    return G.upwind_value(filled(t), G.wind_per_day(t.cells), t.grids).select(*K, r("upwind").alias("upwind"))


@query("grd_19_tile_patches", """
SELECT c.area_id, c.day, c.row, c.col, CAST(pr.v * 2 AS INT) AS patch_row, CAST(pc.v * 2 AS INT) AS patch_col
FROM cells c JOIN grids USING (area_id), (SELECT unnest(range(10)) AS v) pr, (SELECT unnest(range(10)) AS v) pc
WHERE c.row BETWEEN pr.v * 2 AND pr.v * 2 + 3 AND c.col BETWEEN pc.v * 2 AND pc.v * 2 + 3
  AND pr.v * 2 + 4 <= height AND pc.v * 2 + 4 <= width""")
def grd_19(t: Tables):
    return G.tile_patches(t.cells, t.grids, 4, 2).select(*K, "patch_row", "patch_col")
