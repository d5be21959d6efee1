"""Queries over the global grid: mosaics, samples, fluxes, regions, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridair.adapters import Tables
from gridair.operators import flux as X
from gridair.operators import places as P
from gridair.plans.q_stations import _NAMES, _named
from gridair.plans.registry import query

RES = 2.0


def r(c, n=6):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


@query("agg_09_latest_mosaic", """
WITH n AS (SELECT max(ts) AS now FROM global_obs),
o AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY ts DESC, no2 DESC, u DESC, v DESC) AS k FROM global_obs, n
      WHERE cloud_fraction < 0.3E0 AND ts > now - INTERVAL 72 HOUR AND no2 IS NOT NULL)
SELECT row, col, no2, ts, round(epoch(now - ts) / 3600E0, 6) AS age_h FROM o WHERE k = 1""")
def agg_09(t: Tables):
    now = t.global_obs.agg(F.max("ts")).scalar()
    return X.latest_mosaic(t.global_obs, now).select("row", "col", "no2", "ts", r("age_h").alias("age_h"))


@query("agg_10_snapshot_meta", """
WITH n AS (SELECT max(ts) AS now FROM global_obs)
SELECT max(ts) AS newest_obs, min(ts) AS oldest_obs,
       round(count(DISTINCT row * 1000 + col) / (180E0 * 90E0), 3) AS coverage FROM
 (SELECT row, col, max(ts) AS ts FROM global_obs, n WHERE cloud_fraction < 0.3E0 AND ts > now - INTERVAL 72 HOUR GROUP BY 1, 2) m""")
def agg_10(t: Tables):
    now = t.global_obs.agg(F.max("ts")).scalar()
    return X.snapshot_meta(X.latest_mosaic(t.global_obs, now), 180, 90)


# Field of the flux queries: mean clear value and mean wind per 2 degree cell.
_FIELD = """
fld AS (SELECT row, col, avg(no2) FILTER (cloud_fraction < 0.3E0) AS no2, avg(u) AS u, avg(v) AS v FROM global_obs GROUP BY 1, 2)"""


def field(t: Tables):
    return t.global_obs.groupBy("row", "col").agg(
        F.avg(F.when(F.col("cloud_fraction") < 0.3, F.col("no2"))).alias("no2"), F.avg("u").alias("u"), F.avg("v").alias("v"))


def _bilinear(src: str, ids: str) -> str:
    """SQL text: bilinear samples of fld at ``src(lat, lon, ids)``."""
    def val(f):
        c = [f"{x}.{f}" for x in "abcd"]
        mean = f"list_avg([{', '.join(c)}])"
        return (f"coalesce((1 - fy) * ((1 - fx) * a.{f} + fx * b.{f}) + fy * ((1 - fx) * c.{f} + fx * d.{f}), {mean}, 0) AS {f}")
    return f"""
bp AS (SELECT *, greatest(0, least(89, (90 - lat) / 2E0)) AS y, ((lon + 180) % 360 + 360) % 360 / 2E0 AS x FROM {src}),
bk AS (SELECT *, CAST(floor(y) AS INT) AS y0, CAST(least(89, floor(y) + 1) AS INT) AS y1, CAST(floor(x) AS INT) % 180 AS x0,
              (CAST(floor(x) AS INT) + 1) % 180 AS x1, y - floor(y) AS fy, x - floor(x) AS fx FROM bp),
smp AS (SELECT {ids}, {val('no2')}, {val('u')}, {val('v')} FROM bk
        LEFT JOIN fld a ON a.row = y0 AND a.col = x0 LEFT JOIN fld b ON b.row = y0 AND b.col = x1
        LEFT JOIN fld c ON c.row = y1 AND c.col = x0 LEFT JOIN fld d ON d.row = y1 AND d.col = x1)"""


_SPOTS = """
spots AS (SELECT o_orderkey AS id, 85E0 - (o_orderkey * 37 % 1700) / 10E0 AS lat, (o_orderkey * 53 % 4000) / 10E0 - 200E0 AS lon FROM orders)"""


def spots(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), (F.lit(85.0) - (k * 37 % 1700) / 10.0).alias("lat"), ((k * 53 % 4000) / 10.0 - 200.0).alias("lon"))


@query("jon_09_sample_bilinear", f"""
WITH {_FIELD}, {_SPOTS}, {_bilinear('spots', 'id')}
SELECT id, round(no2, 6) AS no2, round(u, 6) AS u, round(v, 6) AS v FROM smp""")
def jon_09(t: Tables):
    return X.sample_bilinear(spots(t), field(t), ["no2", "u", "v"], RES).select("id", r("no2").alias("no2"), r("u").alias("u"), r("v").alias("v"))


# Border segments: one per order, corridors are customers, regions are groups of 25 customers.
_SEGMENTS = """
seg AS (SELECT CAST(floor(o_custkey / 25E0) AS INT) AS region_id, o_custkey AS corridor_id, o_orderkey AS segment_id,
               60E0 + (o_orderkey * 53 % 700) / 10E0 AS lon1, 40E0 - (o_orderkey * 37 % 500) / 10E0 AS lat1,
               60E0 + (o_orderkey * 53 % 700) / 10E0 + (o_orderkey % 7 - 3) / 10E0 AS lon2,
               40E0 - (o_orderkey * 37 % 500) / 10E0 + (o_orderkey % 5 - 2) / 10E0 AS lat2 FROM orders)"""
_FLUX = f"""{_FIELD}, {_SEGMENTS},
sg AS (SELECT *, 6371000E0 * radians(lon2 - lon1) * greatest(0.05E0, cos(radians((lat1 + lat2) / 2))) AS dx,
              6371000E0 * radians(lat2 - lat1) AS dy FROM seg),
sl AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM sg),
sw AS (SELECT segment_id, lon1 + w * (lon2 - lon1) AS lon, lat1 + w * (lat2 - lat1) AS lat
       FROM sl, (SELECT unnest([0.1E0, 0.3E0, 0.5E0, 0.7E0, 0.9E0]) AS w) z WHERE len >= 1),
{_bilinear('sw', 'segment_id')},
sm AS (SELECT segment_id, avg(no2) AS no2, avg(u) AS u, avg(v) AS v FROM smp GROUP BY 1),
sf AS (SELECT sl.*, no2, u, v, greatest(0, no2) * (46.0055E0 * 1E-6) * (u * (-dy / len) + v * (dx / len)) * len * 86400 * 1E-6 AS f
       FROM sl LEFT JOIN sm USING (segment_id)),
sr AS (SELECT region_id, corridor_id, segment_id, coalesce(round(f, 2), 0) + 0 AS flux, coalesce(round(greatest(0, f), 2), 0) AS inflow,
              coalesce(round(greatest(0, -f), 2), 0) + 0 AS outflow, coalesce(round(no2, 2), 0) AS mean_no2, coalesce(round(u, 2), 0) + 0 AS mean_u,
              coalesce(round(v, 2), 0) + 0 AS mean_v, round(len / 1000, 1) AS len_km, round((lon1 + lon2) / 2, 4) AS mid_lon,
              round((lat1 + lat2) / 2, 4) AS mid_lat FROM sf),
co AS (SELECT region_id, corridor_id, round(sum(inflow), 2) AS inflow, round(sum(outflow), 2) AS outflow, avg(mean_no2) AS mean_no2,
              avg(mean_u) AS mu, avg(mean_v) AS mv, avg(mid_lon) AS mid_lon, avg(mid_lat) AS mid_lat FROM sr GROUP BY 1, 2),
cx AS (SELECT *, CASE WHEN inflow > outflow THEN inflow ELSE -outflow END AS flux FROM co),
mass_at AS (SELECT region_id, lat_min + i * (lat_max - lat_min) / 7E0 AS lat, lon_min + j * (lon_max - lon_min) / 7E0 AS lon,
                   (lat_max - lat_min) * 111000E0 / 7 * (lon_max - lon_min) * 111000E0 * cos(radians((lat_min + lat_max) / 2)) / 7 AS area
            FROM (SELECT region_id, min(lat1) AS lat_min, min(lat1) + 4 AS lat_max, min(lon1) AS lon_min, min(lon1) + 3 AS lon_max FROM seg GROUP BY 1) b,
                 (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(8)) AS j) c)"""


def segments(t: Tables):
    k = F.col("o_orderkey")
    lon, lat = F.lit(60.0) + (k * 53 % 700) / 10.0, F.lit(40.0) - (k * 37 % 500) / 10.0
    return t.orders.select(
        F.floor(F.col("o_custkey") / 25.0).cast("int").alias("region_id"), F.col("o_custkey").alias("corridor_id"), k.alias("segment_id"),
        lon.alias("lon1"), lat.alias("lat1"), (lon + (k % 7 - 3) / 10.0).alias("lon2"), (lat + (k % 5 - 2) / 10.0).alias("lat2"))


def regions(t: Tables):
    return segments(t).groupBy("region_id").agg(
        F.min("lat1").alias("lat_min"), (F.min("lat1") + 4).alias("lat_max"), F.min("lon1").alias("lon_min"), (F.min("lon1") + 3).alias("lon_max"))


@query("agg_21_segment_flux", f"WITH {_FLUX} SELECT * FROM sr")
def agg_21(t: Tables):
    return X.segment_flux(segments(t), field(t), RES)


@query("agg_21_corridor_flux", f"""
WITH {_FLUX} SELECT region_id, corridor_id, inflow, outflow, round(inflow - outflow, 2) + 0 AS net, flux, round(mean_no2, 6) AS mean_no2,
 round(sqrt(mu * mu + mv * mv), 6) AS wind_speed,
 CASE WHEN abs(flux) > 40 THEN 'severe' WHEN abs(flux) > 20 THEN 'high' WHEN abs(flux) > 8 THEN 'moderate' ELSE 'low' END AS intensity,
 CASE WHEN sum(inflow) OVER (PARTITION BY region_id) > 0 THEN round(inflow / sum(inflow) OVER (PARTITION BY region_id) * 100, 1) ELSE 0 END AS share_pct
FROM cx""")
def agg_21b(t: Tables):
    c = X.corridor_flux(X.segment_flux(segments(t), field(t), RES))
    return c.select("region_id", "corridor_id", "inflow", "outflow", "net", "flux", r("mean_no2").alias("mean_no2"),
                    r("wind_speed").alias("wind_speed"), "intensity", "share_pct")


@query("agg_22_ambient_mass", f"""
WITH {_FIELD}, {_SEGMENTS}, {_FLUX[_FLUX.index('mass_at AS'):]}, {_bilinear('mass_at', 'region_id, area')}
SELECT region_id, round(greatest(0.5E0, sum(greatest(0, no2) * (46.0055E0 * 1E-6) * area * 1E-6)), 6) AS ambient_mass,
       round(greatest(0.5E0, sum(greatest(0, no2) * (46.0055E0 * 1E-6) * area * 1E-6)) * 4.8E0, 6) AS turnover FROM smp GROUP BY 1""")
def agg_22(t: Tables):
    return X.ambient_mass(regions(t), field(t), RES).select("region_id", r("ambient_mass").alias("ambient_mass"), r("turnover").alias("turnover"))


def _region_flux(t: Tables):
    c = X.corridor_flux(X.segment_flux(segments(t), field(t), RES))
    return X.region_flux(c, X.ambient_mass(regions(t), field(t), RES))


_REGION_FLUX = f"""
WITH {_FLUX}, {_bilinear('mass_at', 'region_id, area').replace('bp AS', 'bp2 AS').replace('FROM bp)', 'FROM bp2)').replace('bk AS', 'bk2 AS').replace('FROM bk', 'FROM bk2').replace('smp AS', 'smp2 AS')},
am AS (SELECT region_id, greatest(0.5E0, sum(greatest(0, no2) * (46.0055E0 * 1E-6) * area * 1E-6)) * 4.8E0 AS turnover FROM smp2 GROUP BY 1),
rg AS (SELECT region_id, round(sum(inflow), 2) AS inflow, round(sum(outflow), 2) AS outflow FROM co GROUP BY 1),
x AS (SELECT rg.*, greatest(5, turnover - (inflow - outflow)) AS local_source FROM rg JOIN am USING (region_id))"""


@query("agg_21_region_flux", f"""
{_REGION_FLUX}
SELECT region_id, inflow, outflow, round(inflow - outflow, 2) + 0 AS net, round(local_source, 4) AS local_source,
       round(inflow / (inflow + local_source) * 100, 4) AS external_raw_pct,
       greatest(12, least(88, round(inflow / (inflow + local_source) * 100, 1))) AS external_pct FROM x""")
def agg_21c(t: Tables):
    return _region_flux(t).select("region_id", "inflow", "outflow", "net", r("local_source", 4).alias("local_source"),
                    r("external_raw_pct", 4).alias("external_raw_pct"), "external_pct")


@query("agg_23_gateway_flux", f"""
WITH {_FIELD}, {_SPOTS}, {_bilinear('spots', 'id')},
g AS (SELECT *, round(greatest(0, no2) * (46.0055E0 * 1E-6) * sqrt(u * u + v * v) * 10000 * 86400 * 1E-6, 1) AS flux FROM smp)
SELECT id, round(no2, 6) AS no2, round(sqrt(u * u + v * v), 6) AS wind_speed, flux,
       CASE WHEN flux > 35 THEN 'severe' WHEN flux > 18 THEN 'high' WHEN flux > 6 THEN 'moderate' ELSE 'low' END AS intensity FROM g""")
def agg_23(t: Tables):
    return X.gateway_flux(spots(t), field(t), RES).select("id", r("no2").alias("no2"), r("wind_speed").alias("wind_speed"), "flux", "intensity")


@query("top_05_rank_corridors", f"""
WITH {_FLUX} SELECT region_id, corridor_id, inflow, CAST(row_number() OVER (PARTITION BY region_id ORDER BY inflow DESC, corridor_id) AS INT) AS rank FROM co""")
def top_05(t: Tables):
    return X.rank_corridors(X.corridor_flux(X.segment_flux(segments(t), field(t), RES))).select("region_id", "corridor_id", "inflow", "rank")


@query("snk_08_flux_arrows", f"""
WITH {_FLUX}, a AS (SELECT *, (degrees(atan2(mu, mv)) + 360) % 360 AS wto, inflow >= outflow AS inn,
  avg(mid_lon) OVER (PARTITION BY region_id) AS clon, avg(mid_lat) OVER (PARTITION BY region_id) AS clat FROM cx),
b AS (SELECT *, greatest(0.2E0, cos(radians(clat))) AS cs, least(1, abs(flux) / 40) AS weight FROM a),
c AS (SELECT *, (mid_lon - clon) * cs AS ex0, mid_lat - clat AS ny0, sqrt(pow((mid_lon - clon) * cs, 2) + pow(mid_lat - clat, 2)) AS rr FROM b),
d AS (SELECT *, CASE WHEN rr < 0.02 THEN (CASE WHEN inn THEN -1 ELSE 1 END) * sin(radians(wto)) ELSE ex0 / rr END AS ex,
             CASE WHEN rr < 0.02 THEN (CASE WHEN inn THEN -1 ELSE 1 END) * cos(radians(wto)) ELSE ny0 / rr END AS ny,
             CASE WHEN inn THEN 1.1E0 + 0.9E0 * weight ELSE -0.2E0 END AS d1, CASE WHEN inn THEN -0.2E0 ELSE 1.1E0 + 0.9E0 * weight END AS d2 FROM c)
SELECT region_id, corridor_id, round(weight, 6) AS weight, round(mid_lon + ex * d1 / cs, 6) AS lon, round(mid_lat + ny * d1, 6) AS lat,
       round(mid_lon - 0.11E0 * sin(radians(wto)), 6) AS start_lon, round(mid_lat - 0.11E0 * cos(radians(wto)), 6) AS start_lat,
       round(mid_lon + 0.11E0 * sin(radians(wto)), 6) AS end_lon, round(mid_lat + 0.11E0 * cos(radians(wto)), 6) AS end_lat,
       round(mid_lon + ex * d2 / cs, 6) AS far_lon, round(mid_lat + ny * d2, 6) AS far_lat,
       concat(corridor_id, ' · ', CASE WHEN inn THEN '+' ELSE '−' END, format('{{:,.1f}}', abs(flux)), ' t/d') AS label FROM d""")
def snk_08(t: Tables):
    a = X.flux_arrows(X.corridor_flux(X.segment_flux(segments(t), field(t), RES)))
    return a.select("region_id", "corridor_id", r("weight").alias("weight"), r("display_start.lon").alias("lon"), r("display_start.lat").alias("lat"),
                    r("start.lon").alias("start_lon"), r("start.lat").alias("start_lat"), r("end.lon").alias("end_lon"), r("end.lat").alias("end_lat"),
                    r("display_end.lon").alias("far_lon"), r("display_end.lat").alias("far_lat"), "label")


@query("snk_08_headline", f"""
{_REGION_FLUX}
SELECT region_id, concat(CAST(CAST(round(greatest(12, least(88, round(inflow / (inflow + local_source) * 100, 1)))) AS INT) AS VARCHAR), '% of region ', region_id, '''s NO₂ today arrived from neighbouring jurisdictions.') AS headline FROM x""")
def snk_08b(t: Tables):
    return X.headline(_region_flux(t))


# --------------------------------------------------------------------------------------------- places
@query("jon_06_nearest_place", """
WITH d AS (SELECT p.point_id, p.lat, p.lon, q.name, sqrt(pow((p.lat - q.lat) * 110.57E0, 2) + pow((p.lon - q.lon) * 111.32E0 * cos(radians(p.lat)), 2)) AS km
           FROM points p LEFT JOIN pois q ON abs(p.lat - q.lat) < 0.1 AND abs(p.lon - q.lon) < 0.1),
b AS (SELECT point_id, any_value(lat) AS lat, any_value(lon) AS lon, min(km) FILTER (km <= 6) AS km, arg_min(name, km) FILTER (km <= 6) AS name FROM d GROUP BY 1)
SELECT point_id, coalesce(name, printf('%.3f°N, %.3f°E', lat, lon)) AS near, round(km, 6) AS near_km FROM b""")
def jon_06(t: Tables):
    return P.nearest_place(t.points, t.pois.select("name", "lat", "lon")).select("point_id", "near", r("near_km").alias("near_km"))


# City boxes from the points of interest of each area.
_BOXES = """
bx AS (SELECT concat('City', CAST(area_id AS VARCHAR), category) AS city, count(*) AS stations, round(avg(lon) - 0.15E0, 3) AS west,
              round(avg(lat) - 0.15E0, 3) AS south, round(avg(lon) + 0.15E0, 3) AS east, round(avg(lat) + 0.15E0, 3) AS north
       FROM pois GROUP BY area_id, category)"""


def boxes(t: Tables):
    return t.pois.groupBy(F.concat(F.lit("City"), F.col("area_id").cast("string"), F.col("category")).alias("city")).agg(
        F.count("*").alias("stations"), F.round(F.avg("lon") - 0.15, 3).alias("west"), F.round(F.avg("lat") - 0.15, 3).alias("south"),
        F.round(F.avg("lon") + 0.15, 3).alias("east"), F.round(F.avg("lat") + 0.15, 3).alias("north"))


@query("jon_07_area_for_point", f"""
WITH {_BOXES}, j AS (SELECT p.point_id, p.lat, p.lon, b.*, row_number() OVER (PARTITION BY point_id ORDER BY stations DESC NULLS LAST, city) AS k
 FROM points p LEFT JOIN bx b ON lon BETWEEN west AND east AND lat BETWEEN south AND north)
SELECT point_id, city, round(coalesce(west, lon - 0.12E0), 6) AS west, round(coalesce(south, lat - 0.12E0), 6) AS south,
 round(coalesce(east, lon + 0.12E0), 6) AS east, round(coalesce(north, lat + 0.12E0), 6) AS north FROM j WHERE k = 1""")
def jon_07(t: Tables):
    return P.area_for_point(t.points, boxes(t)).select("point_id", "city", *[r(c).alias(c) for c in ("west", "south", "east", "north")])


@query("jon_08_match_runs", f"""
WITH {_BOXES}, q AS (SELECT point_id AS request_id, DATE '2024-01-01' + CAST(point_id % 83 AS INT) AS day, lon - 0.1E0 AS west, lat - 0.08E0 AS south,
  lon + 0.1E0 AS east, lat + 0.08E0 AS north FROM points),
s AS (SELECT city AS run_id, west, south, east, north, DATE '2024-01-01' + CAST(stations * 3 AS INT) AS start_day, DATE '2024-01-31' + CAST(stations * 3 AS INT) AS end_day FROM bx),
p AS (SELECT request_id, day, run_id, greatest(0, least(q.east, s.east) - greatest(q.west, s.west)) * greatest(0, least(q.north, s.north) - greatest(q.south, s.south))
        / ((q.east - q.west) * (q.north - q.south)) AS overlap, least(greatest(day, start_day), end_day) AS use_day FROM q, s)
SELECT request_id, run_id, round(overlap, 6) AS overlap, use_day, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CAST(use_day <> day AS INT),
 abs(use_day - day), round(overlap, 9) DESC, run_id) AS INT) AS rank FROM p WHERE overlap >= 0.5""")
def jon_08(t: Tables):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("point_id") % 83).cast("int"))
    q = t.points.select(F.col("point_id").alias("request_id"), day.alias("day"), (F.col("lon") - 0.1).alias("west"),
                        (F.col("lat") - 0.08).alias("south"), (F.col("lon") + 0.1).alias("east"), (F.col("lat") + 0.08).alias("north"))
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("stations") * 3).cast("int"))
    s = boxes(t).select(F.col("city").alias("run_id"), "west", "south", "east", "north", first.alias("start_day"), F.date_add(first, 30).alias("end_day"))
    return P.match_runs(q, s).select("request_id", "run_id", r("overlap").alias("overlap"), "use_day", "rank")


@query("jon_21_covering_period", """
WITH w AS (SELECT o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1),
s AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) - 600 AS lo, CAST(o_orderdate AS DATE) + 1500 AS hi FROM orders),
j AS (SELECT w.*, s.lo AS stored_lo, s.hi AS stored_hi, row_number() OVER (PARTITION BY w.k ORDER BY s.hi - s.lo, s.lo) AS rn FROM w JOIN s ON w.k = s.k AND s.lo <= w.lo AND s.hi >= w.hi)
SELECT k, lo, hi, stored_lo, stored_hi FROM j WHERE rn = 1""")
def jon_21(t: Tables):
    d = F.to_date("o_orderdate")
    w = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    s = t.orders.select(F.col("o_custkey").alias("k"), F.date_sub(d, 600).alias("lo"), F.date_add(d, 1500).alias("hi")).distinct()
    return P.covering_period(w, s, ["k"])


# Regions: a hexagon with a square hole around each supplier.
_VERTS = """
vt AS (SELECT s_suppkey AS region_id, 0 AS polygon, 0 AS ring, k AS seq, -150E0 + (s_suppkey * 67 % 300) + 7 * cos(radians(60E0 * k + 10)) AS lon,
              60E0 - (s_suppkey * 41 % 120) + 6 * sin(radians(60E0 * k + 10)) AS lat FROM supplier, (SELECT unnest(range(6)) AS k) z
       UNION ALL
       SELECT s_suppkey, 0, 1, k, -150E0 + (s_suppkey * 67 % 300) + 2.5E0 * cos(radians(90E0 * k + 20)), 60E0 - (s_suppkey * 41 % 120) + 2.5E0 * sin(radians(90E0 * k + 20))
       FROM supplier, (SELECT unnest(range(4)) AS k) z),
eg AS (SELECT region_id, ring, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2
       FROM vt WINDOW w AS (PARTITION BY region_id, ring ORDER BY seq))"""


def vertices(t: Tables):
    def ring(ring, n, rx, ry, turn):
        a = F.radians(F.lit(360.0 / n) * F.col("k") + turn)
        return (t.supplier.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
                .select(F.col("s_suppkey").alias("region_id"), F.lit(0).alias("polygon"), F.lit(ring).alias("ring"), F.col("k").alias("seq"),
                        (F.lit(-150.0) + (F.col("s_suppkey") * 67 % 300) + rx * F.cos(a)).alias("lon"),
                        (F.lit(60.0) - (F.col("s_suppkey") * 41 % 120) + ry * F.sin(a)).alias("lat")))
    return ring(0, 6, 7.0, 6.0, 10.0).unionByName(ring(1, 4, 2.5, 2.5, 20.0))


def _inside(src: str, ids: str) -> str:
    return f"""
bb AS (SELECT region_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM vt WHERE ring = 0 GROUP BY 1),
cand AS (SELECT {ids}, lon, lat, region_id FROM {src} JOIN bb ON lon BETWEEN w AND e AND lat BETWEEN s AND n),
ins AS (SELECT {ids}, region_id FROM (SELECT {ids}, region_id, ring, sum(CAST((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 AS INT)) % 2 AS odd
        FROM cand JOIN eg USING (region_id) WHERE y1 <> y2 GROUP BY {ids}, region_id, ring) q
        GROUP BY {ids}, region_id HAVING coalesce(max(CASE WHEN ring = 0 THEN odd END), 0) = 1 AND coalesce(max(CASE WHEN ring = 1 THEN odd END), 0) = 0)"""


@query("jon_12_points_in_regions", f"WITH {_VERTS}, {_SPOTS}, {_inside('spots', 'id')} SELECT id, region_id FROM ins")
def jon_12(t: Tables):
    return P.points_in_regions(spots(t), vertices(t), ["id"])


_GRID = """
gr AS (SELECT CAST(r.v AS INT) AS row, CAST(c.v AS INT) AS col, fld.no2, 90 - (r.v + 0.5E0) * 2 AS lat, -180 + (c.v + 0.5E0) * 2 AS lon
       FROM (SELECT unnest(range(90)) AS v) r CROSS JOIN (SELECT unnest(range(180)) AS v) c LEFT JOIN fld ON fld.row = r.v AND fld.col = c.v)"""


def global_grid(t: Tables):
    """Every 2 degree cell, null where unobserved."""
    spine = t.spark.range(90 * 180).select((F.col("id") / 180).cast("int").alias("row"), (F.col("id") % 180).cast("int").alias("col"))
    return spine.join(field(t), ["row", "col"], "left")


@query("agg_20_region_stats", f"""
WITH {_FIELD}, {_VERTS}, {_GRID}, {_inside('gr', 'row, col')}, bg AS (SELECT greatest(1, quantile_cont(no2, 0.5)) AS b FROM fld),
s AS (SELECT region_id, count(*) AS cells, count(no2) AS seen, avg(no2) AS mean, max(no2) AS mx FROM ins JOIN gr USING (row, col) GROUP BY 1)
SELECT region_id, cells, seen, round(mean, 6) AS mean, round(mx, 6) AS max, round(mean / b, 6) AS ratio,
 CASE WHEN seen / CAST(cells AS DOUBLE) >= 0.03 AND (mean / b >= 2.2 OR mx >= 8 * b) THEN 'high'
      WHEN seen / CAST(cells AS DOUBLE) >= 0.03 AND mean / b >= 1.35 THEN 'elevated' ELSE 'background' END AS level FROM s, bg""")
def agg_20(t: Tables):
    s = X.region_stats(global_grid(t).select("row", "col", "no2"), vertices(t), RES)
    return s.select("region_id", "cells", "seen", r("mean").alias("mean"), r("max").alias("max"), r("ratio").alias("ratio"), "level")


@query("prj_26_ocean_name", f"""
WITH {_SPOTS} SELECT id, CASE WHEN lat > 66 THEN 'Arctic Ocean' WHEN lat < -60 THEN 'Southern Ocean' WHEN lon >= 20 AND lon < 120 AND lat < 30 THEN 'Indian Ocean'
 WHEN lon >= -70 AND lon < 20 THEN 'Atlantic Ocean' WHEN lon >= -100 AND lon < -70 AND lat > 8 THEN 'Atlantic Ocean' ELSE 'Pacific Ocean' END AS ocean FROM spots""")
def prj_26(t: Tables):
    return spots(t).select("id", P.ocean_name(F.col("lat"), F.col("lon")).alias("ocean"))


@query("prj_26_with_continent", """
SELECT s_suppkey AS id, n_name AS country, r_name AS continent, CASE WHEN n_nationkey % 4 = 0 THEN concat('Republic of ', n_name) ELSE n_name END AS display_name
FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def prj_26b(t: Tables):
    lookup = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("continent"))
    names = t.nation.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("country"), F.concat(F.lit("Republic of "), "n_name").alias("display_name"))
    src = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("country"))
    return P.with_continent(src, lookup, names).select("id", "country", "continent", "display_name")


@query("jon_16_missing_from", f"""
WITH {_NAMES} SELECT station_name FROM n WHERE station_name NOT IN (SELECT concat('Site ', CAST(l_suppkey AS VARCHAR), ', ', n_name, ' - AG', CAST(n_nationkey % 3 AS VARCHAR))
 FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > (SELECT avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) z)) h
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)""")
def jon_16(t: Tables):
    from gridair.operators.levels import missing_from
    q = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    busy = q.where(F.col("q") > q.agg(F.avg("q")).scalar())
    names = (busy.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
             .select(F.concat(F.lit("Site "), F.col("l_suppkey").cast("string"), F.lit(", "), "n_name", F.lit(" - AG"),
                              (F.col("n_nationkey") % 3).cast("string")).alias("station_name")))
    return missing_from(_named(t).select("station_name"), names, ["station_name"])
