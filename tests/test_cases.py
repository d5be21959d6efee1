"""Behaviour of the operators on small, hand-made cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridair.functions import bands, strings
from gridair.operators import attribution as A
from gridair.operators import cells as G
from gridair.operators import facts as X
from gridair.operators import flux as U
from gridair.operators import forecast as P
from gridair.operators import models as M
from gridair.operators import spatial as Z
from gridair.operators import stations as S
from gridair.operators import text as T
from gridair.sources import ingest as I
from gridair.streaming import jobs as J
from tests.test_exact import field, grid, to_array


def test_hourly_stations_need_three_quarters_of_the_window(spark):
    rows = [("A", 19.0, 72.8, dt.datetime(2025, 11, 1, h), 100.0 if 12 <= h < 16 else 10.0) for h in range(24)]
    rows += [("A", 19.0, 72.8, dt.datetime(2025, 11, 2, h), 50.0) for h in (12, 13)]
    df = spark.createDataFrame(rows, "station_id string, lat double, lon double, ts timestamp, no2 double")
    got = S.station_daily(df).collect()
    assert [(r["day"].day, r["no2"]) for r in got] == [(1, 100.0)]
    assert [r["no2"] for r in S.station_daily(df, None, None).collect()] == [25.0]
    daily = df.groupBy("station_id", "lat", "lon", F.to_date("ts").cast("timestamp").alias("ts")).agg(F.avg("no2").alias("no2"))
    assert S.station_daily(daily).count() == 2  # daily data is used as it is


def test_quality_control_keeps_the_good_stations(spark):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(40):
        day = str(dt.date(2025, 1, 1) + dt.timedelta(days=d))
        for i, sid in enumerate(("GOOD1", "GOOD2", "GOOD3")):
            rows.append((sid, day, 19.0 + 0.2 * i, 72.8, float(40 + 15 * math.sin(d) + rng.normal(0, 3))))
        rows.append(("FLAT", day, 19.9, 72.8, float(30 + 0.2 * (d % 2))))
        rows.append(("LOW", day, 20.1, 72.8, float(3 + 2 * rng.random())))
        rows.append(("NEIGHBOUR", day, 19.003, 72.8, float(11 + 4 * math.sin(d) + rng.normal(0, 0.5))))
    df = spark.createDataFrame(rows, "station_id string, day string, lat double, lon double, no2 double").withColumn("day", F.to_date("day"))
    assert {r[0] for r in S.quality_control(df).select("station_id").distinct().collect()} == {"GOOD1", "GOOD2", "GOOD3"}
    why = {r["station_id"]: r["reason"] for r in S.qc_verdicts(df).collect()}
    assert (why["FLAT"], why["LOW"], why["NEIGHBOUR"]) == ("flat", "low", "neighbour")


def test_station_names(spark):
    names = [("Bandra, Mumbai - MPCB", "Mumbai"), ("Sector - 125, Noida - UPPCB", "Noida"), ("Collectorate - Gaya - BSPCB", "Gaya"), ("Worli", "Worli")]
    df = spark.createDataFrame(names, "name string, city string")
    assert all(r[0] == r[1] for r in df.select(strings.city_of(F.col("name")), "city").collect())
    keys = spark.createDataFrame([(" Bombay ",), ("New   Delhi",), ("Pune",)], "n string").select(strings.city_key(F.col("n"))).collect()
    assert [r[0] for r in keys] == ["mumbai", "delhi", "pune"]


def test_report_rows_match_by_name(spark):
    rep = spark.createDataFrame([("Bandra, Mumbai - MPCB", "01-11-2025 12:00", "41.5"), ("Bandra, Mumbai - MPCB", "01-11-2025 13:00", "NA"), ("Nowhere", "01-11-2025 12:00", "9")],
                                "station string, from_date string, value string")
    coords = spark.createDataFrame([("Bandra Mumbai MPCB", 19.06, 72.83)], "station_name string, lat double, lon double")
    rows = I.match_coordinates(I.clean_report_rows(rep), coords).collect()
    assert len(rows) == 1 and rows[0]["station_id"] == "BANDRA_MUMBAI_MPCB" and rows[0]["no2"] == 41.5
    assert [r[0] for r in I.skipped_stations(rep, coords).collect()] == ["Nowhere"]


def test_missing_day_and_units(spark):
    a = np.full((4, 5), 1.2e-4)
    a[0, 0] = np.nan
    cells = field(spark, a, "2025-11-01").unionByName(field(spark, a, "2025-11-03"))
    d = G.densify_days(G.normalise_units(cells), grid(spark, 4, 5)).groupBy("day").agg(F.count("no2").alias("n"), F.max("no2").alias("m")).orderBy("day").collect()
    assert [r["n"] for r in d] == [19, 0, 19] and d[0]["m"] == pytest.approx(120.0)
    twice = cells.unionByName(cells)
    with pytest.raises(Exception, match="two values"):
        G.check_one_row_per_cell(twice).collect()


def test_status_and_bands(spark):
    rows = [(30.0, 0.0, "normal"), (30.0, 0.10, "elevated"), (55.0, 0.0, "elevated"), (95.0, 0.6, "critical"), (200.0, 1.0, "critical_spike")]
    df = spark.createDataFrame(rows, "m double, s double, want string")
    assert all(r[0] == r[1] for r in df.select(bands.classify_status(F.col("m"), F.col("s")), "want").collect())
    v = spark.createDataFrame([(-1.0,), (40.0,), (180.0,), (None,)], "v double").select(bands.hazard_band(F.col("v")), bands.hazard_code(F.col("v"))).collect()
    assert [tuple(r) for r in v] == [("Normal", 0), ("Moderate", 2), ("Hazardous", 4), ("Normal", 0)]


def test_trend_separates_weather_from_emissions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(30):
        blh, ws = 800 + 300 * rng.normal(), abs(3 + rng.normal())
        rows.append((0, dt.date(2025, 1, 1) + dt.timedelta(days=d), 40 + 0.5 * d - 0.02 * (blh - 800) - 4 * (ws - 3) + rng.normal(0, 0.5), blh, ws))
    t = M.weather_adjusted_trend(spark.createDataFrame(rows, "area_id int, day date, no2 double, blh double, wind_speed double")).first()
    assert t["direction"] == "rising" and abs(t["slope_adjusted_week"] - 3.5) < 0.6 and t["weather_r2"] > 0.3


def test_planted_spike_is_an_anomaly(spark):
    rng = np.random.default_rng(7)
    days, h, w = [], 24, 24
    for k in range(6):
        a = 40 + rng.normal(0, 1, (h, w))
        if k == 5:
            a[8:15, 8:15] = a.max() + 120
        days.append(field(spark, a, f"2025-11-0{k + 1}"))
    cells = days[0]
    for d in days[1:]:
        cells = cells.unionByName(d)
    cells = cells.withColumn("u10", F.lit(3.0)).withColumn("v10", F.lit(1.0)).withColumn("blh", F.lit(600.0))
    static = G.cell_spine(grid(spark, h, w)).select("area_id", "row", "col").withColumns({n: F.rand(3) for n in ("road_density", "night_lights", "ghsl_built")}).withColumn("power_plants", F.lit(0.0))
    static = static.withColumn("road_density", F.when(F.col("row").between(5, 17) & F.col("col").between(5, 17), 0.0).otherwise(F.col("road_density")))
    static = static.withColumn("night_lights", F.when(F.col("row").between(5, 17), 0.0).otherwise(F.col("night_lights")))
    found = [r for r in Z.anomalies(cells, grid(spark, h, w), static).collect() if r["day"].day == 6]
    assert len(found) == 1
    a = found[0]
    assert {"exceedance", "spike"} <= set(a["kinds"]) and a["severity"] == "high" and a["reasons"][0] == "unlisted" and 8 <= a["row"] < 15
    hot = [r for r in Z.hotspots(cells.select("area_id", "day", "row", "col", "no2"), grid(spark, h, w)).collect() if r["day"].day == 6 and r["rank"] == 1][0]
    assert 8 <= hot["row"] < 15 and hot["value"] > 150


def test_forecast_scores_of_a_perfect_forecast(spark):
    a = 20 + 80 * np.exp(-((np.arange(16)[:, None] - 8) ** 2 + (np.arange(16)[None, :] - 8) ** 2) / 20)
    f = field(spark, a, name="value").withColumn("horizon", F.lit(3.0))
    m = P.forecast_metrics(f, f, grid(spark, 16, 16)).first()
    assert m["rmse"] == 0 and m["r2"] == 1 and m["iou"] == 1 and m["mass_error"] == 0 and m["displacement_km"] == 0 and m["ssim"] == pytest.approx(1)


def test_drift_moves_with_the_wind_and_keeps_mass(spark):
    a = np.full((60, 60), np.nan)
    a[40, 10] = 1000.0
    cells = field(spark, a).withColumn("u10", F.lit(3.0)).withColumn("v10", F.lit(2.0))
    g = grid(spark, 60, 60, 0.0025)
    out = P.drift_projection(cells, g, (1.0,), persistent=False).collect()
    dx, dy = 0.0025 * 111320 * math.cos(math.radians(19.0 - 60 * 0.0025 / 2)), 0.0025 * 110574
    assert len(out) == 1 and (out[0]["row"], out[0]["col"]) == (round(40 - 7200 / dy), round(10 + 10800 / dx))
    assert out[0]["value"] == pytest.approx(1000 * math.exp(-0.25))
    kept = P.conserve_mass(P.drift_projection(cells, g, (1.0,)), cells).agg(F.sum("value")).first()[0]
    assert kept == pytest.approx(1000.0)


def test_impact_of_cleaner_air(spark):
    rows = [("s", 0, "2025-01-01", i, j, 85.0, 60.0) for i in range(20) for j in range(20)]
    df = spark.createDataFrame(rows, "scenario string, area_id int, day string, row int, col int, base double, sim double")
    r = P.compute_impact(df).first()
    assert r["peak_change"] == -25 and r["base_compliance"] == "EXCEEDANCE" and r["sim_compliance"] == "COMPLIANT" and r["improved"] and r["sim_exposed"] == 0


def test_scenarios_scale_the_peak(spark):
    a = np.full((16, 16), 50.0)
    a[8, 8] = 120.0
    out = P.scenario_sweep(field(spark, a), {"less": {"traffic": 0.6}, "more": {"traffic": 1.5}, "same": {}}).groupBy("scenario").agg(F.max("sim").alias("m")).collect()
    m = {r["scenario"]: r["m"] for r in out}
    assert m["less"] < m["same"] < m["more"] and m["same"] == pytest.approx(120.0)


def test_contributions_sum_to_hundred(spark):
    rows = [(1, "road_density", 4.1, 0.8), (1, "wind_speed", -2.8, 1.2), (1, "built_up", 1.7, 0.7), (1, "blh", -0.9, 250.0)]
    c = A.contributions(spark.createDataFrame(rows, "instance_id int, feature string, value double, actual double")).orderBy("rank").collect()
    assert c[0]["feature"] == "road_density" and c[0]["percentage"] > 40 and sum(r["percentage"] for r in c) == pytest.approx(100, abs=0.2)
    assert c[0]["sentence"].startswith("Dense road density contributed 43%, Low wind speed contributed 30%")


def test_poi_elements(spark):
    motorway = ",".join(f'{{"lat":{19 + k / 1000},"lon":72.8}}' for k in range(50))
    texts = ['{"type":"node","id":1,"lat":19.0,"lon":72.9,"tags":{"landuse":"industrial","industrial":"oil_mill"}}',
             '{"type":"way","id":2,"center":{"lat":19.1,"lon":72.9},"tags":{"power":"plant","plant:source":"gas","name":"P"}}',
             '{"type":"node","id":3,"lat":19.2,"lon":72.9,"tags":{"man_made":"works","product":"steel"}}', '{"type":"node","id":6,"tags":{"man_made":"works"}}',
             f'{{"type":"way","id":4,"geometry":[{motorway}],"tags":{{"highway":"motorway","ref":"NH48"}}}}',
             '{"type":"way","id":5,"geometry":[{"lat":19.0,"lon":72.8},{"lat":19.1,"lon":72.8}],"tags":{"railway":"rail"}}']
    e = I.parse_elements(spark.createDataFrame([(t,) for t in texts], "payload string"))
    p = {r["id"]: r for r in I.poi_points(e).collect()}
    assert set(p) == {"osm-node-1", "osm-way-2", "osm-node-3"} and p["osm-way-2"]["category"] == "POWER_PLANT" and p["osm-way-2"]["details"].startswith("Power plant (gas).")
    assert p["osm-node-1"]["details"].startswith("Industrial area (oil mill).")
    line = {r["id"]: r for r in I.poi_lines(e).collect()}
    assert line["osm-way-4"]["factor"] == 0.85 and line["osm-way-5"]["kind"] == "railway"
    path = line["osm-way-4"]["path"]
    assert len(path) < 50 and path[-1]["lat"] == pytest.approx(19.049)


def test_haze_summary(spark):
    now = dt.datetime(2025, 11, 1, 12)
    df = spark.createDataFrame([(now - dt.timedelta(hours=2), 0.2), (now - dt.timedelta(hours=1), 0.7), (now - dt.timedelta(hours=90), 0.9)], "ts timestamp, haze_index double")
    r = X.haze_summary(df, F.lit(now)).first()
    assert (r["n"], r["latest_class"], r["max"]) == (2, "dense", 0.7)


def test_inspection_of_near_far_and_airport_sites(spark):
    sites = spark.createDataFrame([("near", 1, 19.09, 72.89, 3.0, 270.0, None), ("far", 1, 19.40, 73.20, 3.0, 270.0, None), ("airport", 2, 28.56, 77.12, 3.0, 270.0, None)],
                                  "site_id string, area_id int, lat double, lon double, wind_ms double, wind_from double, haze_class string")
    bases = spark.createDataFrame([(1, 19.0760, 72.8777), (2, 28.57, 77.13)], "area_id int, lat double, lon double")
    airports = spark.createDataFrame([(28.5562, 77.1)], "lat double, lon double")
    p = {r["site_id"]: r for r in T.inspection_plans(sites, bases, airports).collect()}
    assert p["near"]["decision"] == "go" and p["near"]["zone"] == "green"
    assert p["far"]["decision"] == "no_go" and p["far"]["issues"] == ["battery"] and p["far"]["forward_decision"] == "go"
    km = math.hypot((p["far"]["forward_lat"] - 19.40) * 111.2, (p["far"]["forward_lon"] - 73.20) * 111.2 * math.cos(math.radians(19.4)))
    assert km == pytest.approx(3.0, abs=0.05)
    assert p["airport"]["decision"] == "conditional" and p["airport"]["zone"] == "yellow"


def test_topic_guard(spark):
    rows = [(1, 0, "what is the NO2 level today"), (2, 0, "is the polution dangeros for asthma"), (3, 0, "give me a pasta recipe"), (4, 0, "write a python program"), (5, 1, "why?"), (6, 0, "why?")]
    m = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    got = {r["conv_id"]: r["on_topic"] for r in T.score_relevance(m, T.default_vocabulary(spark), has_history=F.col("turn") > 0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_requests_and_coordinates(spark):
    m = spark.createDataFrame([("Forecast Mumbai for 6 hr on 25/11/2025",), ("report please",), ("Pinpoint (19.027°S, 72.838°E)",), ("95, 300",)], "text string")
    r = T.missing_fields(T.parse_requests(m, F.lit(dt.date(2025, 11, 30)))).collect()
    assert r[0]["intent"] == "forecast" and r[0]["forecast_hours"] == 6 and r[0]["observation_date"] == dt.date(2025, 11, 25) and r[0]["missing_fields"] == []
    assert r[1]["missing_fields"] == ["bbox", "observation_date", "location"]
    c = [x[0] for x in m.select(T.parse_coordinates(F.col("text"))).collect()]
    assert (c[2]["lat"], c[2]["lon"]) == (-19.027, 72.838) and c[3] is None


def _world(spark, u, v):
    n = spark.range(90 * 180).select((F.col("id") / 180).cast("int").alias("row"), (F.col("id") % 180).cast("int").alias("col"))
    return n.withColumns({"no2": F.lit(40.0), "u": F.lit(float(u)), "v": F.lit(float(v))})


def test_flux_across_and_along_a_border(spark):
    seg = spark.createDataFrame([(1, 1, 1, 77.0, 28.0, 77.0, 29.0)], "region_id int, corridor_id int, segment_id int, lon1 double, lat1 double, lon2 double, lat2 double")
    across = U.segment_flux(seg, _world(spark, -5, 0), 2.0).first()
    along = U.segment_flux(seg, _world(spark, 0, 5), 2.0).first()
    assert across["inflow"] > 0 and across["outflow"] == 0 and along["flux"] == 0
    assert across["flux"] == pytest.approx(40 * 46.0055e-6 * 5 * math.radians(1) * 6_371_000 * 86400 * 1e-6, abs=0.01)


def test_neighbourhood_mean_ignores_missing(spark):
    a = np.array([[2.0, np.nan], [np.nan, 2.0]])
    assert np.all(to_array(G.neighbourhood_mean(field(spark, a), 3, "r"), "r", 2, 2) == 2.0)
    b = np.full((4, 4), np.nan)
    b[1, 2] = 7.0
    assert np.all(to_array(Z.fill_nearest(field(spark, b)), "no2", 4, 4) == 7.0)


def test_sequence_samples_have_the_right_shape(spark):
    days = [field(spark, np.full((2, 2), 10.0 + k), f"2025-11-0{k + 1}") for k in range(9)]
    dense = days[0]
    for d in days[1:]:
        dense = dense.unionByName(d)
    s = P.sequence_samples(dense).collect()
    assert len(s) == 2 * 4 and all(len(r["inputs"]) == 4 and len(r["targets"]) == 4 for r in s)
    first = [r for r in s if r["start_day"].day == 2][0]
    assert first["inputs"] == [11, 12, 13, 14] and first["prev_no2"] == [10, 11, 12, 13] and first["targets"] == [15, 16, 17, 18]


def test_patches_cover_the_grid(spark):
    g = grid(spark, 8, 8)
    c = G.cell_spine(g).select("area_id", "row", "col")
    t = G.tile_patches(c, g, 4, 2)
    assert t.select("patch_row", "patch_col").distinct().count() == 9 and t.count() == 9 * 16


def test_late_readings_are_counted(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "station_id string, lat double, lon double, ts timestamp, no2 double").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put("a", [("A", 19.0, 72.8, dt.datetime(2025, 1, d, h), 30.0) for d in (1, 2, 3) for h in (12, 13, 14, 15)])
    schema = spark.read.parquet(str(tmp_path / "in" / "a")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = J.daily_means(stream)

    def run():
        q = out.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        return J.dropped_rows(q)
    assert run() == 0
    put("b", [("A", 19.0, 72.8, dt.datetime(2025, 1, 1, 12), 99.0), ("A", 19.0, 72.8, dt.datetime(2025, 1, 5, 13), 30.0)])
    assert run() >= 1
    days = sorted((r["day"].day, r["no2"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert days[0] == (1, 30.0) and (2, 30.0) in days


def test_missing_stays_missing(spark):
    from gridair.functions import bands, geo, units, wind
    one = spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 100D AS c, 1.2345D AS v")
    x = F.col("x")
    row = one.select(units.clip(x, 0, 1), units.column_to_surface(F.col("c"), x), units.frame_confidence(F.lit(10.0), x), units.lead_confidence(x),
                     wind.estimate_blh(x, x, x), bands.clamp_index(x), bands.haze_class(x)).first()
    assert list(row) == [None] * 7
    assert list(one.select(geo.snap_down(F.col("v"), 0.001), geo.snap_up(F.col("v"), 0.05)).first()) == [1.234, 1.25]


def test_nan_is_no_value_of_a_quantile(spark):
    from gridair.functions.quantiles import exact_quantiles
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 3.0)], "k int, v double")
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).first().m == 2.0


def test_holes(spark):
    from gridair.operators import cells, spatial
    line = spark.createDataFrame([(0, 0, c, float(c)) for c in (0, 1, 2, 6, 7)], "area_id int, row int, col int, no2 double")
    got = {r.col: r.gx for r in cells.gradient(line, "no2").collect()}
    assert got == {c: 1.0 for c in (0, 1, 2, 6, 7)}
    with pytest.raises(Exception, match="holes"):
        spatial.gaussian_smooth(line, 1.0, {"no2": "s"}, keys=("area_id",)).collect()
