"""Distance joins near the poles and across the date line beside all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridair.functions import geo
from gridair.operators import stations as S
from gridair.operators.near import within_radius


def places(n=150):
    rng = np.random.default_rng(12)
    lat = np.concatenate([rng.uniform(77.6, 78.4, n), rng.uniform(-0.5, 0.5, n), rng.uniform(88.5, 90, n), rng.uniform(-90, -89.2, n), [90.0, -90.0, 90.0, 75.0, 73.0, 0.0, 0.0]])
    lon = np.concatenate([rng.uniform(-180, 180, n) * 0.02 + 15, np.where(rng.uniform(size=n) < 0.5, rng.uniform(179.3, 180, n), rng.uniform(-180, -179.3, n)), rng.uniform(-180, 180, n), rng.uniform(-180, 180, n),
                          [0.0, 50.0, 170.0, 180.0, -180.0, 179.99, -179.99]])
    return lat, lon


def great_circle(lat, lon):
    p, q = np.radians(lat), np.radians(lon)
    h = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.minimum(1, np.sqrt(h)))


def flat(lat, lon):
    way = np.abs(lon[:, None] - lon)
    way = np.where(way > 180, 360 - way, way)
    return np.hypot((lat[:, None] - lat) * 110.57, way * 111.32 * np.cos(np.radians(lat))[:, None])


@pytest.mark.parametrize("km", [2.5, 40.0, 300.0])
def test_great_circles(spark, km):
    lat, lon = places()
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [(-1, None, 1.0)], "id long, lat double, lon double")
    s = p.select(F.col("id").alias("other"), F.col("lat").alias("src_lat"), F.col("lon").alias("src_lon"))
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("src_lat"), F.col("src_lon"))
    rows = [(r.id, r.other) for r in within_radius(p, s, km).where(d <= km).select("id", "other").collect()]
    want = set(zip(*np.nonzero(great_circle(lat, lon) <= km)))
    assert len(rows) == len(set(rows)) and set(rows) == want and (len(lat) - 2, len(lat) - 1) in want


@pytest.mark.parametrize("km", [5.0, 60.0])
def test_neighbour_means(spark, km):
    lat, lon = places(60)
    n = len(lat)
    v = np.random.default_rng(1).normal(40, 10, n)
    obs = spark.createDataFrame([(f"S{i}", "2024-01-01", float(v[i])) for i in range(n)], "station_id string, day string, no2 double")
    sites = spark.createDataFrame([(f"S{i}", float(lat[i]), float(lon[i])) for i in range(n)], "station_id string, lat double, lon double")
    got = {r["station_id"]: r for r in S.neighbour_mean(obs, sites, km).collect()}
    d = flat(lat, lon)
    same = (lat[:, None] == lat) & (lon[:, None] == lon)
    for i in range(n):
        near = [v[j] for j in range(n) if d[i, j] < km and not same[i, j]]
        assert got[f"S{i}"]["neighbours"] == len(near), (lat[i], lon[i])
        if near:
            assert got[f"S{i}"]["neighbour_mean"] == pytest.approx(np.mean(near))
