"""Sinks with a folder a key: the tasks write and place the files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gridair.sources import sinks as W

GRID = "area_id int, west double, north double, res double, width int, height int"


def _cells(spark, areas=3):
    return spark.range(areas * 1000).selectExpr("cast(id % %d as int) area_id" .replace("%d", str(areas)), "date_add(date'2024-01-01', cast(id % 2 as int)) day",
                                                "cast(id / 30 as int) row", "cast(id % 30 as int) col", "if(id % 7 = 0, null, id / 3D) no2")


def test_a_failed_run_leaves_what_was_there(spark, tmp_path):
    """A run that fails replaces nothing and leaves no staged files; one that ends replaces all."""
    grids = spark.createDataFrame([(a, 60.0, 30.0, 0.035, 30, 200) for a in range(3)], GRID)
    path = str(tmp_path / "csv")
    W.write_points_csv(_cells(spark), grids, path)
    read = lambda: sorted(map(str, spark.read.option("header", True).schema("lon double, lat double, no2 double, area_id int, day date").csv(path).collect()))
    before = read()
    with pytest.raises(Exception, match="broken"):
        W.write_points_csv(_cells(spark).withColumn("no2", F.when(F.col("row") == 90, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.lit(1.0))), grids, path)
    assert read() == before and len(before) > 2000
    assert [x for x in os.listdir(path) if x.startswith("_")] == ["_SUCCESS"]
    W.write_points_csv(_cells(spark).where("area_id = 1"), grids, path)
    assert sorted(x for x in os.listdir(path) if "=" in x) == ["area_id=1"]


def test_folders_and_rows_are_those_of_sparks_own_writer(spark, tmp_path):
    names = ["a/b", "x=y", "", None, "ä {1}[2]^", "%", "plain", "q\"'*:?\\#"]
    rows = spark.createDataFrame([(n, d, k, float(k), [k], dt.datetime(2024, 1, 1, 3)) for n in names for d in (None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)) for k in range(5)],
                                 "area string, day date, k long, v double, list array<long>, ts timestamp").repartition(7)
    keys = ("area", "day")
    W.write_daily(rows, str(tmp_path / "own"), keys)
    rows.write.partitionBy(*keys).parquet(str(tmp_path / "spark"))
    folders = lambda kind: {os.path.relpath(d, tmp_path / kind) for d, _, files in os.walk(tmp_path / kind) if any(f.startswith("part-") for f in files)}
    assert folders("own") == folders("spark") and len(folders("own")) == 21
    own, plain = (spark.read.parquet(str(tmp_path / kind)) for kind in ("own", "spark"))
    assert dict(own.dtypes) == dict(plain.dtypes)
    held = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert held(own) == held(plain)
    # Only the folders that come again are replaced, whoever has written them.
    more = rows.where("area = 'plain' and day = '2024-01-02'").withColumn("v", F.lit(-1.0))
    for kind in ("own", "spark"):
        W.write_daily(more, str(tmp_path / kind), keys)
        after = spark.read.parquet(str(tmp_path / kind))
        assert after.count() == rows.count() and after.where("v = -1").count() == 5


def test_spark_has_no_folder_to_commit(spark, tmp_path, monkeypatch):
    """Its committer goes through the folders one by one on the driver."""
    def called(*_):
        raise AssertionError("partitioned by Spark's writer")
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.partitionBy", called)
    W.write_daily(_cells(spark), str(tmp_path / "daily"))
    assert spark.read.parquet(str(tmp_path / "daily")).count() == 3000
