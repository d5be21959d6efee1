"""Queries over monitoring stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridair.adapters import Tables
from gridair.functions import bands, dates
from gridair.operators import stations as S
from gridair.plans.registry import query


def r(c, n=4):
    return F.round(c if not isinstance(c, str) else F.col(c), n)


# hourly readings screened to the overpass window.  The readings are sparse (about two per station day), so
# one of the window's hours is enough here; the default of 75 % is covered by the unit tests.
@query("agg_01_station_daily", """
WITH f AS (SELECT * FROM stations_hourly WHERE hour(ts) >= 12 AND hour(ts) < 16 AND no2 >= 0 AND no2 < 1000),
g AS (SELECT station_id, CAST(ts AS DATE) AS day, avg(no2) AS m, count(no2) AS n FROM f GROUP BY 1, 2)
SELECT station_id, day, round(m, 4) AS no2, n AS n_readings,
       CASE WHEN m >= 180 THEN 'Hazardous' WHEN m >= 80 THEN 'Unhealthy' WHEN m >= 40 THEN 'Moderate'
            ELSE 'Normal' END AS band
FROM g WHERE n >= ceil(0.25 * 4)""")
def agg_01(t: Tables):
    d = S.station_daily(t.stations_hourly, 12, 16, min_completeness=0.25)
    return d.select("station_id", "day", r("no2").alias("no2"), "n_readings", bands.hazard_band(F.col("no2")).alias("band"))


@query("prj_01_filter_hours", """
SELECT station_id, ts, no2 FROM stations_hourly WHERE hour(ts) >= 12 AND hour(ts) < 16""")
def prj_01(t: Tables):
    return S.filter_hours(t.stations_hourly).select("station_id", "ts", "no2")


@query("prj_02_filter_faults", """
SELECT station_id, ts, no2 FROM stations_hourly
WHERE no2 >= 0 AND no2 < 1000 AND lat IS NOT NULL AND lon IS NOT NULL""")
def prj_02(t: Tables):
    return S.filter_faults(t.stations_hourly).select("station_id", "ts", "no2")


@query("prj_04_exclude_periods", """
SELECT station_id, day, no2 FROM stations_daily d
WHERE NOT EXISTS (SELECT 1 FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, min(CAST(o_orderdate AS DATE)) + 40 AS hi
                                 FROM orders GROUP BY o_orderpriority) p WHERE d.day BETWEEN p.lo AND p.hi)""")
def prj_04(t: Tables):
    p = (t.orders.groupBy("o_orderpriority").agg(F.min(F.to_date("o_orderdate")).alias("lo"))
         .select("lo", F.date_add("lo", 40).alias("hi")))
    return S.exclude_periods(t.stations_daily, p).select("station_id", "day", "no2")


@query("win_01_frozen_flag", """
SELECT station_id, day, coalesce(abs(no2 - lag(no2) OVER (PARTITION BY station_id ORDER BY day)) < 0.05, false)
       AS frozen FROM stations_daily""")
def win_01(t: Tables):
    return S.frozen_flag(t.stations_daily).select("station_id", "day", "frozen")


@query("agg_02_station_stats", """
SELECT station_id, count(no2) AS n, round(avg(no2), 4) AS mean, round(stddev_samp(no2), 4) AS std,
       round(quantile_cont(no2, 0.5), 4) AS median, round(stddev_samp(no2) / avg(no2), 4) AS cv
FROM stations_daily GROUP BY 1""")
def agg_02(t: Tables):
    return S.station_stats(t.stations_daily).select(
        "station_id", "n", *[r(c).alias(c) for c in ("mean", "std", "median", "cv")])


_PAIRS = """
s AS (SELECT station_id, min(lat) AS lat, min(lon) AS lon, quantile_cont(no2, 0.5) AS median FROM {src} GROUP BY 1),
j AS (SELECT a.station_id AS a_id, b.station_id AS b_id, a.median AS am, b.median AS bm,
             sqrt(pow((a.lat - b.lat) * 110.57E0, 2)
                  + pow((a.lon - b.lon) * 111.32E0 * cos(radians(a.lat)), 2)) AS km
      FROM s a JOIN s b ON a.station_id < b.station_id)"""


# The derived stations lie up to 50 km apart and read alike, so the pair rule is exercised with a wider radius
# and a lower ratio; the defaults are covered by the unit tests.
@query("jon_05_inconsistent_pairs", "WITH " + _PAIRS.format(src="stations_daily") + """
SELECT CASE WHEN am < bm THEN a_id ELSE b_id END AS lo_id, CASE WHEN am < bm THEN b_id ELSE a_id END AS hi_id,
       round(km, 4) AS km, round(least(am, bm), 4) AS lo_median, round(greatest(am, bm), 4) AS hi_median
FROM j WHERE km <= 40 AND greatest(am, bm) > 1.02 * least(am, bm)""")
def jon_05(t: Tables):
    p = S.inconsistent_pairs(S.station_stats(t.stations_daily), 40.0, 1.02)
    return p.select("lo_id", "hi_id", *[r(c).alias(c) for c in ("km", "lo_median", "hi_median")])


_QC = """
z AS (SELECT *, coalesce(abs(no2 - lag(no2) OVER (PARTITION BY station_id ORDER BY day)) < 0.05, false) AS frozen
      FROM stations_daily),
c AS (SELECT * FROM z WHERE NOT frozen),
st AS (SELECT station_id, count(*) AS n, stddev_samp(no2) / avg(no2) AS cv, quantile_cont(no2, 0.5) AS median,
              min(lat) AS lat, min(lon) AS lon FROM c GROUP BY 1),
s1 AS (SELECT *, CASE WHEN n < 330 THEN 'few_days' WHEN cv < 0.5 THEN 'flat' END AS r1 FROM st),
nm AS (SELECT quantile_cont(median, 0.5) AS network FROM s1 WHERE r1 IS NULL),
s2 AS (SELECT s1.*, network, coalesce(r1, CASE WHEN median < 0.93 * network THEN 'low' END) AS r2 FROM s1, nm),
pr AS (SELECT a.station_id AS a_id, b.station_id AS b_id, a.median AS am, b.median AS bm FROM s2 a JOIN s2 b
       ON a.station_id < b.station_id AND a.r2 IS NULL AND b.r2 IS NULL
       AND sqrt(pow((a.lat - b.lat) * 110.57E0, 2)
                + pow((a.lon - b.lon) * 111.32E0 * cos(radians(a.lat)), 2)) <= 20),
lo AS (SELECT DISTINCT CASE WHEN am < bm THEN a_id ELSE b_id END AS station_id FROM pr
       WHERE greatest(am, bm) > 1.05 * least(am, bm)),
v AS (SELECT s2.*, CASE WHEN r2 IS NULL AND lo.station_id IS NOT NULL THEN 'neighbour' ELSE r2 END AS reason
      FROM s2 LEFT JOIN lo USING (station_id))"""
_LIMITS = dict(min_cv=0.5, min_days=330, low_fraction=0.93, neighbour_km=20.0, neighbour_ratio=1.05)


@query("agg_03_quality_control", "WITH " + _QC + """
SELECT c.station_id, c.day, round(c.no2, 6) AS no2 FROM c JOIN v USING (station_id) WHERE v.reason IS NULL""")
def agg_03(t: Tables):
    return S.quality_control(t.stations_daily, **_LIMITS).select("station_id", "day", r("no2", 6).alias("no2"))


@query("agg_03_qc_verdicts", "WITH " + _QC + """
SELECT station_id, n, round(cv, 4) AS cv, round(median, 4) AS median, reason FROM v""")
def agg_03b(t: Tables):
    return S.qc_verdicts(t.stations_daily, **_LIMITS).select(
        "station_id", "n", r("cv").alias("cv"), r("median").alias("median"), "reason")


@query("agg_32_qc_report", "WITH " + _QC + """
SELECT (SELECT count(*) FROM z) AS rows_in, (SELECT count(*) FROM z WHERE frozen) AS frozen_rows,
       (SELECT count(*) FROM c JOIN v USING (station_id) WHERE reason IS NULL) AS rows_out,
       count(*) AS stations_in, count(*) FILTER (reason IS NULL) AS stations_out,
       round(max(network), 4) AS network_median,
       count(*) FILTER (reason = 'few_days') AS dropped_few_days, count(*) FILTER (reason = 'flat') AS dropped_flat,
       count(*) FILTER (reason = 'low') AS dropped_low, count(*) FILTER (reason = 'neighbour') AS dropped_neighbour
FROM v""")
def agg_32(t: Tables):
    return S.qc_report(t.stations_daily, **_LIMITS).withColumn("network_median", r("network_median"))


@query("jon_04_neighbour_mean", """
WITH s AS (SELECT DISTINCT station_id, lat, lon FROM stations_daily),
p AS (SELECT a.station_id AS a_id, b.station_id AS b_id FROM s a JOIN s b ON
      sqrt(pow((a.lat - b.lat) * 110.57E0, 2) + pow((a.lon - b.lon) * 111.32E0 * cos(radians(a.lat)), 2)) < 100
      AND sqrt(pow((a.lat - b.lat) * 110.57E0, 2) + pow((a.lon - b.lon) * 111.32E0 * cos(radians(a.lat)), 2)) > 0)
SELECT d.station_id, d.day, round(avg(o.no2), 8) AS neighbour_mean, count(o.no2) AS neighbours
FROM stations_daily d LEFT JOIN p ON p.a_id = d.station_id
LEFT JOIN stations_daily o ON o.station_id = p.b_id AND o.day = d.day GROUP BY 1, 2""")
def jon_04(t: Tables):
    sites = t.stations_daily.select("station_id", "lat", "lon").distinct()
    return S.neighbour_mean(t.stations_daily, sites).withColumn("neighbour_mean", r("neighbour_mean", 8))


@query("agg_30_national_day_median", """
SELECT station_id, day, round(quantile_cont(no2, 0.5) OVER (PARTITION BY day), 4) AS day_median,
       round(avg(no2) OVER (PARTITION BY station_id), 4) AS station_mean FROM stations_daily""")
def agg_30(t: Tables):
    return S.national_day_median(t.stations_daily).select(
        "station_id", "day", r("day_median").alias("day_median"), r("station_mean").alias("station_mean"))


@query("win_03_station_lags", """
SELECT station_id, day, lag(no2, 1) OVER w AS lag1, lag(no2, 2) OVER w AS lag2 FROM stations_daily
WINDOW w AS (PARTITION BY station_id ORDER BY day)""")
def win_03(t: Tables):
    return S.station_lags(t.stations_daily).select("station_id", "day", "lag1", "lag2")


@query("win_06_mean_anomaly", """
SELECT station_id, day, round(no2 - avg(no2) OVER (PARTITION BY station_id), 4) + 0 AS anomaly FROM stations_daily""")
def win_06(t: Tables):
    return S.mean_anomaly(t.stations_daily, ["station_id"], "no2").select("station_id", "day", r("anomaly").alias("anomaly"))


@query("win_12_share_of", """
SELECT station_id, day, round(no2 / sum(no2) OVER (PARTITION BY city), 8) AS share FROM stations_daily""")
def win_12(t: Tables):
    return S.share_of(t.stations_daily, ["city"], "no2").select("station_id", "day", r("share", 8).alias("share"))


@query("prj_07_calendar_features", """
SELECT station_id, day, round(sin(2 * pi() * dayofyear(day) / 365.25E0), 6) AS doy_sin,
       round(cos(2 * pi() * dayofyear(day) / 365.25E0), 6) AS doy_cos,
       CAST(isodow(day) - 1 AS INT) AS day_of_week, CAST(isodow(day) >= 6 AS INT) AS weekend,
       month(day) IN (11, 12, 1, 2) AS winter, least(2030, CAST(floor(year(day) / 5E0) * 5 AS INT)) AS epoch
FROM stations_daily""")
def prj_07(t: Tables):
    d = F.col("day")
    return t.stations_daily.select(
        "station_id", "day", r(dates.doy_sin(d), 6).alias("doy_sin"), r(dates.doy_cos(d), 6).alias("doy_cos"),
        dates.day_of_week(d).alias("day_of_week"), dates.weekend(d).alias("weekend"),
        dates.in_season(d, [11, 12, 1, 2]).alias("winter"), dates.population_epoch(d).alias("epoch"))


@query("jon_03_training_table", """
WITH daily AS (SELECT concat('ST', CAST(CAST(floor(o_custkey / 37E0) AS INT) AS VARCHAR)) AS station_id,
                      CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders,
                      CASE WHEN count(*) % 5 = 0 THEN NULL ELSE CAST(max(o_orderkey) AS DOUBLE) END AS column_value
               FROM orders GROUP BY 1, 2),
st AS (SELECT station_id, count(*) AS n_days FROM stations_daily GROUP BY 1)
SELECT station_id, day, round(no2, 6) AS no2, n_orders, column_value, n_days
FROM stations_daily JOIN daily USING (station_id, day) JOIN st USING (station_id) WHERE column_value IS NOT NULL""")
def jon_03(t: Tables):
    k = F.concat(F.lit("ST"), F.floor(F.col("o_custkey") / 37.0).cast("int").cast("string"))
    daily = t.orders.groupBy(k.alias("station_id"), F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("n_orders"),
        F.when(F.count("*") % 5 != 0, F.max("o_orderkey").cast("double")).alias("column_value"))
    static = t.stations_daily.groupBy("station_id").agg(F.count("*").alias("n_days"))
    return S.training_table(t.stations_daily, daily, static, ["no2", "column_value"]).select(
        "station_id", "day", r("no2", 6).alias("no2"), "n_orders", "column_value", "n_days")


# Prediction compared with the observation: the station's previous value.
_PRED = """
p AS (SELECT station_id, day, no2, lag(no2) OVER (PARTITION BY station_id ORDER BY day) AS pred FROM stations_daily)"""


def _pred(t: Tables):
    return S.station_lags(t.stations_daily).select("station_id", "city", "day", "no2", F.col("lag1").alias("pred"))


_METRICS = """count(pred) AS n, round(1 - sum(pow(pred - no2, 2)) / (var_pop(no2) * count(*)), 4) AS r2,
       round(sqrt(avg(pow(pred - no2, 2))), 4) AS rmse, round(avg(abs(pred - no2)), 4) AS mae,
       round(avg(pred - no2), 4) + 0 AS mbe, round(corr(no2, pred), 4) AS pearson_r"""


@query("agg_14_regression_metrics", f"""
WITH {_PRED} SELECT station_id, {_METRICS} FROM p WHERE pred IS NOT NULL GROUP BY 1""")
def agg_14(t: Tables):
    m = S.regression_metrics(_pred(t), "no2", "pred", ["station_id"]).where("n > 0")
    return m.select("station_id", "n", *[r(c).alias(c) for c in ("r2", "rmse", "mae", "mbe", "pearson_r")])


@query("agg_15_summarize_predictions", f"""
WITH {_PRED}, q AS (SELECT * FROM p WHERE pred IS NOT NULL),
m AS (SELECT station_id, avg(no2) AS no2, avg(pred) AS pred, count(*) AS n, corr(no2, pred) AS wr FROM q GROUP BY 1),
d AS (SELECT q.no2 - m.no2 AS no2, q.pred - m.pred AS pred FROM q JOIN m USING (station_id)),
w AS (SELECT round(quantile_cont(wr, 0.5), 4) AS median_within_station_r FROM m WHERE n > 5)
SELECT * FROM (SELECT 'overall' AS part, {_METRICS} FROM q UNION ALL
SELECT 'station_mean_spatial', {_METRICS} FROM m UNION ALL SELECT 'temporal_anomaly', {_METRICS} FROM d) x, w""")
def agg_15(t: Tables):
    return S.summarize_predictions(_pred(t)).select("part", "n", *[
        r(c).alias(c) for c in ("r2", "rmse", "mae", "mbe", "pearson_r", "median_within_station_r")])


@query("mod_13_trend_slope", """
WITH x AS (SELECT station_id, CAST(day - DATE '1995-01-01' AS DOUBLE) AS x, no2 AS y FROM stations_daily),
g AS (SELECT station_id, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS b FROM x GROUP BY 1),
e AS (SELECT station_id, sqrt(sum(pow(y - (slope * x + b), 2)) / (max(n) - 2) / regr_sxx(y, x)) AS se
      FROM x JOIN g USING (station_id) GROUP BY 1)
SELECT station_id, n, round(slope, 6) AS slope, round(slope / se, 4) AS t,
       CASE WHEN abs(slope / se) <= 2 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction
FROM g JOIN e USING (station_id)""")
def mod_13(t: Tables):
    d = t.stations_daily.withColumn("x", F.datediff("day", F.lit("1995-01-01").cast("date")).cast("double"))
    return S.trend_slope(d, ["station_id"], "x", "no2").withColumn("slope", r("slope", 6)).withColumn("t", r("t"))


@query("win_10_date_blocks", """
SELECT day, CAST(ntile(5) OVER (ORDER BY day) - 1 AS INT) AS date_block
FROM (SELECT DISTINCT day FROM stations_daily) d""")
def win_10(t: Tables):
    return S.date_blocks(t.stations_daily)


@query("win_10_station_groups", "SELECT station_id, CAST((row_number() OVER (ORDER BY md5(station_id), station_id) - 1) % 5 AS INT) AS station_group FROM (SELECT DISTINCT station_id FROM stations_daily) s")
def win_10b(t: Tables):
    return S.station_groups(t.stations_daily)


@query("mod_07_space_time_folds", """
WITH d AS (SELECT day, ntile(5) OVER (ORDER BY day) - 1 AS date_block FROM (SELECT DISTINCT day FROM stations_daily) x),
i AS (SELECT station_id, CAST((row_number() OVER (ORDER BY md5(station_id), station_id) - 1) % 5 AS INT) AS station_group
      FROM (SELECT DISTINCT station_id FROM stations_daily) x),
f AS (SELECT s.station_id, s.day, CAST(d.date_block AS INT) AS date_block, station_group
      FROM stations_daily s JOIN d USING (day) JOIN i USING (station_id))
SELECT a.station_group, a.date_block, count(*) AS test_rows,
       (SELECT count(*) FROM f b WHERE b.station_group <> a.station_group AND b.date_block <> a.date_block) AS train_rows
FROM f a GROUP BY 1, 2""")
def mod_07(t: Tables):
    return S.fold_sizes(S.space_time_folds(t.stations_daily))


@query("mod_08_group_folds", """
SELECT city AS test_group, count(*) AS test_rows, (SELECT count(*) FROM stations_daily) - count(*) AS train_rows
FROM stations_daily GROUP BY 1 HAVING (SELECT count(DISTINCT city) FROM stations_daily) > 1""")
def mod_08(t: Tables):
    return S.group_folds(t.stations_daily, "city")


@query("set_02_holdout_split", "SELECT CAST('0x' || substr(md5(concat(station_id, '|', CAST(day AS VARCHAR))), 1, 8) AS BIGINT) % 1000 < 100 AS holdout, count(*) AS n FROM stations_daily GROUP BY 1")
def set_02(t: Tables):
    return (S.holdout_flag(t.stations_daily, ["station_id", "day"]).groupBy("holdout")
            .agg(F.count("*").alias("n")))


_NAMES = """
n AS (SELECT concat('Site ', CAST(s_suppkey AS VARCHAR), ', ', n_name, ' - AG', CAST(s_nationkey % 3 AS VARCHAR)) AS station_name,
             n_name, 10E0 + (s_suppkey * 13 % 300) / 10E0 AS lat, 70E0 + (s_suppkey * 17 % 300) / 10E0 AS lon
      FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _named(t: Tables):
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.concat(F.lit("Site "), F.col("s_suppkey").cast("string"), F.lit(", "), F.col("n_name"), F.lit(" - AG"),
                 (F.col("s_nationkey") % 3).cast("string")).alias("station_name"), "n_name",
        (F.lit(10.0) + (F.col("s_suppkey") * 13 % 300) / 10.0).alias("lat"),
        (F.lit(70.0) + (F.col("s_suppkey") * 17 % 300) / 10.0).alias("lon"))


@query("prj_13_city_of", f"WITH {_NAMES} SELECT station_name, n_name AS city, lower(n_name) AS city_key FROM n")
def prj_13(t: Tables):
    from gridair.functions import strings
    c = strings.city_of(F.col("station_name"))
    return _named(t).select("station_name", c.alias("city"), strings.city_key(c).alias("city_key"))


@query("prj_14_slug", f"""
WITH {_NAMES} SELECT station_name, upper(trim(regexp_replace(station_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug,
regexp_replace(lower(station_name), '[^a-z0-9]+', '', 'g') AS norm FROM n""")
def prj_14(t: Tables):
    from gridair.functions import strings
    return _named(t).select("station_name", strings.slug(F.col("station_name")).alias("slug"),
                            strings.normalise_name(F.col("station_name")).alias("norm"))


@query("agg_19_city_boxes", f"""
WITH {_NAMES}, g AS (SELECT n_name AS city, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS y0, max(lat) AS y1,
                            min(lon) AS x0, max(lon) AS x1, count(*) AS stations FROM n GROUP BY 1),
h AS (SELECT *, least(greatest(greatest(lon - x0, x1 - lon) + 0.06E0, 0.15E0), 0.45E0) AS hx,
             least(greatest(greatest(lat - y0, y1 - lat) + 0.06E0, 0.15E0), 0.45E0) AS hy FROM g)
SELECT city, lower(city) AS key, stations, round(lat, 6) AS lat, round(lon, 6) AS lon, round(lon - hx, 3) AS west,
       round(lat - hy, 3) AS south, round(lon + hx, 3) AS east, round(lat + hy, 3) AS north FROM h""")
def agg_19(t: Tables):
    return S.city_boxes(_named(t)).withColumn("lat", r("lat", 6)).withColumn("lon", r("lon", 6))


@query("top_08_suggest_city", """
WITH c AS (SELECT DISTINCT lower(p_name) AS city FROM part),
u AS (SELECT DISTINCT concat(split_part(p_name, ' ', 1), 'xy') AS name FROM part),
m AS (SELECT u.name, city FROM u JOIN c ON contains(city, substr(u.name, 1, 4)))
SELECT name, city, rank FROM (SELECT name, city, CAST(row_number() OVER (PARTITION BY name ORDER BY city) AS INT) AS rank
                              FROM m) x WHERE rank <= 8""")
def top_08(t: Tables):
    cities = t.part.select(F.lower("p_name").alias("city"), F.lower("p_name").alias("key")).distinct()
    unknown = t.part.select(F.concat(F.substring_index("p_name", " ", 1), F.lit("xy")).alias("name"))
    return S.suggest_city(unknown, cities)


# Candidates scored against the observation; the previous value is a diagnostic and not selectable.
@query("top_06_select_model", """
WITH p AS (SELECT no2, lag(no2) OVER w AS m1, lag(no2, 2) OVER w AS m2, avg(no2) OVER (PARTITION BY station_id) AS m3
           FROM stations_daily WINDOW w AS (PARTITION BY station_id ORDER BY day)),
s AS (SELECT 'lag1' AS model, sqrt(avg(pow(m1 - no2, 2))) AS rmse, false AS selectable FROM p
      UNION ALL SELECT 'lag2', sqrt(avg(pow(m2 - no2, 2))), true FROM p
      UNION ALL SELECT 'mean', sqrt(avg(pow(m3 - no2, 2))), true FROM p)
SELECT model AS selected, round(rmse, 4) AS rmse FROM s WHERE selectable ORDER BY rmse LIMIT 1""")
def top_06(t: Tables):
    d = S.mean_anomaly(S.station_lags(t.stations_daily), ["station_id"], "no2")
    long = d.select("no2", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(c).alias("pred"), F.lit(sel).alias("selectable"))
        for n, c, sel in (("lag1", "lag1", False), ("lag2", "lag2", True), ("mean", "group_mean", True))])).alias("c"))
    scored = S.regression_metrics(long.select("no2", "c.*"), "no2", "pred", ["model", "selectable"])
    return S.select_model(scored).withColumn("rmse", r("rmse"))


@query("agg_31_multi_level", """
SELECT city, station_id, count(*) AS n, round(avg(no2), 4) AS no2,
       CAST(grouping(city) * 2 + grouping(station_id) AS BIGINT) AS level
FROM stations_daily GROUP BY ROLLUP (city, station_id)""")
def agg_31(t: Tables):
    from gridair.operators.levels import multi_level
    return multi_level(t.stations_daily, ["city", "station_id"], F.count("*").alias("n"), r(F.avg("no2")).alias("no2"))


@query("prj_11_acceptance", f"""
WITH {_PRED}, m AS (SELECT station_id, {_METRICS} FROM p WHERE pred IS NOT NULL GROUP BY 1)
SELECT station_id, coalesce(r2 >= 0.6 AND rmse <= 15, false) AS passed, round((rmse - 80) / 80 * 100, 3) AS pct FROM m""")
def prj_11(t: Tables):
    m = S.regression_metrics(_pred(t), "no2", "pred", ["station_id"]).where("n > 0")
    return m.select("station_id", bands.acceptance(r("r2"), r("rmse")).alias("passed"),
                    r(bands.pct_vs(r("rmse"), 80.0), 3).alias("pct"))
