"""Operators built for scale against plain computations on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridair.functions import quantiles
from gridair.functions.quantiles import exact_quantiles
from gridair.operators import cells as G
from gridair.operators import models as M
from gridair.operators import near
from gridair.operators import spatial as Z
from gridair.operators import stations as S
from gridair.operators import text as T


def field(spark, a, day="2024-01-01", area=0, name="no2"):
    rows = [(area, day, i, j, None if np.isnan(v) else float(v)) for i, r in enumerate(a) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, f"area_id int, day string, row int, col int, {name} double").withColumn("day", F.to_date("day"))


def to_array(df, name, h, w):
    out = np.full((h, w), np.nan)
    for r in df.select("row", "col", name).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def grid(spark, h, w, res=0.0025, west=72.8, north=19.0):
    return spark.createDataFrame([(0, west, north, res, w, h)], "area_id int, west double, north double, res double, width int, height int")


def test_a_hot_slice_is_ranked_in_parts(spark):
    """All values of the hot group lie in one slice of the first histogram: no part holds more than a few times the root of them."""
    rng = np.random.default_rng(4)
    values = [float(v) for v in 100.0 + rng.random(9000) * 1e-3]
    df = spark.createDataFrame([(0, v) for v in values] + [(1, 5.0), (1, 7.0)], "k int, v double")
    assert df.where("k = 0").select(quantiles._slice(F.col("v"))).distinct().count() == 1
    parts = quantiles._part(F.col("v"), F.lit(min(values)), F.lit(max(values)), F.lit(95))
    assert df.where("k = 0").groupBy(parts.alias("p")).count().agg(F.max("count")).first()[0] < 5 * 95
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert [got[0][n] for n in probs] == pytest.approx(np.quantile(values, list(probs.values())), abs=1e-12)
    assert got[1]["c"] == 6.0


def test_neighbour_mean_keeps_small_values_beside_a_huge_one(spark):
    sites = spark.createDataFrame([("a", 19.0, 72.8), ("b", 19.001, 72.8), ("c", 19.0, 72.801), ("d", 19.3, 72.8)], "station_id string, lat double, lon double")
    obs = spark.createDataFrame([("a", 1e18), ("b", 2.0), ("c", 4.0), ("d", None)], "station_id string, no2 double").withColumn("day", F.lit("2024-01-01"))
    got = {r["station_id"]: (r["m"], r["neighbours"]) for r in near.radius_mean(obs, sites, 100.0, "no2", "m").collect()}
    assert got["a"] == (3.0, 2) and got["b"][1] == got["c"][1] == 2 and got["d"][1] == 3


def test_air_off_open_water_is_no_upwind_comparison(spark):
    h = w = 40
    a = np.full((h, w), 40.0)
    a[18:23, 22:27] = 300.0  # five kilometres east of the western half
    cells = field(spark, a).withColumn("u10", F.lit(3.0)).withColumn("v10", F.lit(0.0)).withColumn("blh", F.lit(600.0))
    spine = G.cell_spine(grid(spark, h, w)).select("area_id", "row", "col").withColumns({n: F.lit(0.0) for n in ("road_density", "night_lights", "ghsl_built", "power_plants")})
    kinds = {}
    for name, sea in (("land", -1), ("sea", 15)):
        static = spine.withColumn("ndvi", F.when(F.col("col") < sea, -0.2).otherwise(0.4))
        found = Z.anomalies(cells, grid(spark, h, w), static).collect()
        assert len(found) == 1 and found[0]["upwind"] == pytest.approx(40.0, abs=1e-6)
        kinds[name] = set(found[0]["kinds"])
    assert kinds == {"land": {"exceedance", "local_source"}, "sea": {"exceedance"}}


def test_quantiles_equal_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [(0, float(v)) for v in np.round(rng.normal(0, 50, 4000), 1)] + [(k, float(v)) for k in range(1, 6) for v in rng.lognormal(3, 2, 7)] + [(9, 4.0), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for k in {r[0] for r in rows}:
        v = [x for g, x in rows if g == k and x is not None]
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()[0] == pytest.approx(np.median([x for _, x in rows if x is not None]))


def test_radius_mean_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    n = 60
    lat, lon = 19 + rng.normal(0, 0.9, n), 73 + rng.normal(0, 0.9, n)
    lat[:20], lon[:20] = 19.0, 73.0  # a crowd at one place
    lat[20:25], lon[20:25] = 19.001, 73.0
    v = rng.normal(40, 10, n)
    rows = [(f"S{i}", "2024-01-01", float(v[i]) if i % 7 else None) for i in range(n)]
    obs = spark.createDataFrame(rows, "station_id string, day string, no2 double")
    sites = spark.createDataFrame([(f"S{i}", float(lat[i]), float(lon[i])) for i in range(n)], "station_id string, lat double, lon double")
    got = {r["station_id"]: r for r in S.neighbour_mean(obs, sites, 100.0).collect()}
    for i in range(n):
        km = np.hypot((lat[i] - lat) * 110.57, (lon[i] - lon) * 111.32 * np.cos(np.radians(lat[i])))
        near = [v[j] for j in range(n) if 0 < km[j] < 100 and j % 7]
        assert got[f"S{i}"]["neighbours"] == len(near)
        if near:
            assert got[f"S{i}"]["neighbour_mean"] == pytest.approx(np.mean(near))


def test_components_follow_a_snake(spark):
    a = np.zeros((9, 9))
    a[0, :] = a[2, :] = a[4, :] = a[6, :] = 1
    a[1, 8] = a[3, 0] = a[5, 8] = 1
    a[8, 0] = a[8, 2] = 1
    f = field(spark, a).where("no2 > 0")
    sizes = sorted(r[1] for r in Z.label_components(f).groupBy("component").count().collect())
    assert sizes == [1, 1, int(a.sum()) - 2]


def test_nearest_fill_is_exact(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(50, 10, (8, 11))
    a[rng.random(a.shape) < 0.8] = np.nan
    got = to_array(Z.fill_nearest(field(spark, a)), "no2", *a.shape)
    known = np.argwhere(~np.isnan(a))
    for i in range(8):
        for j in range(11):
            r, c = min(map(tuple, known), key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p[0], p[1]))
            assert got[i, j] == a[r, c]
    assert Z.fill_nearest(field(spark, np.full((2, 2), np.nan))).where("no2 IS NOT NULL").count() == 0


def test_smoothing_keeps_a_constant_and_the_total(spark):
    a = np.zeros((15, 20))
    a[7, 9] = 100.0
    s = to_array(Z.gaussian_smooth(field(spark, a), 1.0, {"no2": "s"}), "s", 15, 20)
    assert s.sum() == pytest.approx(100.0) and np.unravel_index(s.argmax(), s.shape) == (7, 9)
    c = to_array(Z.gaussian_smooth(field(spark, np.full((4, 6), 7.0)), 6.0, {"no2": "s"}), "s", 4, 6)
    assert np.allclose(c, 7.0)


def test_bilinear_keeps_block_means_of_planes(spark):
    a = np.add.outer(np.arange(6.0) * 3, np.arange(5.0))
    up = to_array(G.upsample_bilinear(field(spark, a), 4, ["no2"]), "no2", 24, 20)
    mid = up.reshape(6, 4, 5, 4).mean(axis=(1, 3))
    assert np.allclose(mid[1:-1, 1:-1], a[1:-1, 1:-1])
    back = to_array(G.block_mean(G.upsample_bilinear(field(spark, a), 4, ["no2"]), 4), "no2", 6, 5)
    assert np.allclose(back, mid)


def test_backprojection_meets_the_coarse_field(spark):
    rng = np.random.default_rng(4)
    a = rng.uniform(20, 80, (5, 6))
    coarse = field(spark, a, name="no2_filled")
    fine = field(spark, np.kron(a, np.ones((3, 3))) * rng.uniform(0.5, 1.5, (15, 18)), name="pred")
    before = np.abs(to_array(G.block_mean(fine, 3, "pred"), "pred", 5, 6) - a).max()
    out = M.backproject(fine, coarse, 3, 5)
    after = np.abs(to_array(G.block_mean(out, 3, "pred"), "pred", 5, 6) - a).max()
    assert after < 0.1 * before


def test_pyramid_keeps_observed_and_leaves_no_gap(spark):
    a = np.full((18, 36), np.nan)
    a[3, 4], a[10, 30], a[17, 0] = 10.0, 40.0, 25.0
    rows = [(i, j, None if np.isnan(v) else float(v)) for i, r in enumerate(a) for j, v in enumerate(r)]
    g = spark.createDataFrame(rows, "row int, col int, no2 double")
    out = to_array(Z.pyramid_fill(g, 36, 18), "filled", 18, 36)
    assert not np.isnan(out).any() and out[3, 4] == 10 and out[10, 30] == 40 and 10 <= out.min() <= out.max() <= 40
    conf = {(r["row"], r["col"]): r for r in Z.gap_confidence(g, 36).collect()}
    assert conf[3, 4]["confidence"] == 1.0 and conf[3, 3]["gap"] == 1 and conf[17, 35]["gap"] == 1 and conf[0, 20]["confidence"] == 0.0


def test_gap_fill_leaves_nothing_missing_and_keeps_observed(spark):
    rng = np.random.default_rng(5)
    days = []
    for k in range(8):
        a = 50 + 10 * np.sin(np.arange(6))[:, None] + rng.normal(0, 2, (6, 5)) + k
        a[rng.random(a.shape) < (0.95 if k == 3 else 0.3)] = np.nan
        days.append(field(spark, a, f"2024-01-0{k + 1}"))
    dense = days[0]
    for d in days[1:]:
        dense = dense.unionByName(d)
    out, model = M.gap_fill(dense, grid(spark, 6, 5, 0.035), M.GapFillSettings(trees=5, depth=4, passes=1))
    rows = out.collect()
    assert model is not None and len(rows) == 240 and all(r["no2_filled"] is not None for r in rows)
    assert all((r["fill_flag"] == 0) == (r["no2"] is not None) and (r["no2"] is None or r["no2"] == r["no2_filled"]) for r in rows)
    assert {r["fill_flag"] for r in rows if r["day"].day == 4} & {2, 3}
    empty = field(spark, np.full((2, 2), np.nan))
    with pytest.raises(Exception, match="no clear observation"):
        M.gap_fill(empty, grid(spark, 2, 2), M.GapFillSettings())[0].collect()


def test_greedy_picks_keep_their_distance(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 100, (20, 20))
    top = sorted(Z.separated_top(field(spark, a), grid(spark, 20, 20, 0.01), n=4, degrees=0.038).collect(), key=lambda r: r["rank"])
    work, picks = a.copy(), []
    rr, cc = np.mgrid[0:20, 0:20]
    for _ in range(4):
        i, j = np.unravel_index(work.argmax(), work.shape)
        picks.append((i, j))
        work[np.round(((rr - i) ** 2 + (cc - j) ** 2) * 1e-4, 8) < 0.038 ** 2] = -1
    assert [(r["row"], r["col"]) for r in top] == picks


def test_grounding_matches_pairwise_tolerance(spark):
    texts = spark.createDataFrame([(1, "mean 57.2 and peak 1,210"), (2, "it reads 333 today"), (3, "no numbers")], "doc_id long, text string")
    facts = spark.createDataFrame([(1, 57.0), (1, 1200.0), (2, 300.0), (2, 340.0)], "doc_id long, value double")
    got = {r["doc_id"]: r for r in T.grounded(texts, facts).collect()}
    assert got[1]["grounded"] and not got[3]["ungrounded"] and got[2]["grounded"] == (abs(333 - 340) <= 0.02 * 340)


def test_lines_cover_every_cell_they_touch(spark):
    g = grid(spark, 10, 10, 0.1, 70.0, 20.0)
    path = [(19.95, 70.02), (19.31, 70.97), (19.31, 70.35)]
    lines = spark.createDataFrame([(1, path)], "id int, path array<struct<lat: double, lon: double>>")
    got = {(r["row"], r["col"]) for r in Z.line_cells(lines, g).collect()}
    want = set()
    for (a, b), (c, d) in zip(path, path[1:]):
        for k in range(200001):
            t = (k + 0.5) / 200001
            want.add((math.floor((20.0 - (a + t * (c - a))) / 0.1), math.floor(((b + t * (d - b)) - 70.0) / 0.1)))
    assert got == want
