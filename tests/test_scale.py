"""What grows with the input: files of a sink, state of a stream, what is written between rounds."""

import glob
import os

import numpy as np
from pyspark.sql import functions as F

from gridair.operators import cells as G
from gridair.operators import models as M
from gridair.operators import places as P
from gridair.operators import stations as S
from gridair.session import ensure_checkpoint_dir
from gridair.sources import sinks as W
from gridair.streaming import jobs as J


def test_a_folder_has_one_file_whatever_the_tasks(spark, tmp_path):
    rows = spark.range(0, 600, 1, 12).select((F.col("id") % 3).cast("int").alias("area_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("day"),
                                             (F.col("id") / 30).cast("int").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.col("id").cast("double").alias("no2"))
    grids = spark.createDataFrame([(a, 60.0, 30.0, 0.035, 30, 20) for a in range(3)], "area_id int, west double, north double, res double, width int, height int")
    W.write_daily(rows, str(tmp_path / "daily"))
    W.write_points_csv(rows, grids, str(tmp_path / "csv"))
    for kind in ("daily", "csv"):
        folders = glob.glob(str(tmp_path / kind / "area_id=*" / "day=*"))
        assert len(folders) == 6
        assert all(len(glob.glob(f"{f}/part-*")) == 1 for f in folders)
    assert spark.read.parquet(str(tmp_path / "daily")).count() == 600


def test_backprojection_writes_nothing_between_rounds(spark):
    rng = np.random.default_rng(5)
    coarse, fine = rng.random((4, 5)) * 50, rng.random((8, 10)) * 50
    table = lambda a, name: spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], f"area_id int, row int, col int, {name} double").withColumn("day", F.lit("2024-01-01").cast("date"))
    folder = ensure_checkpoint_dir(spark)
    before = set(os.listdir(folder.removeprefix("file:")))
    inside = lambda: {f for d, _, fs in os.walk(folder.removeprefix("file:")) for f in fs}
    files = inside()
    got = {(r["row"], r["col"]): r["pred"] for r in M.backproject(table(fine, "pred").withColumn("tag", F.col("row")), table(coarse, "no2_filled"), 2, 3).collect() if r["tag"] == r["row"]}
    assert before == set(os.listdir(folder.removeprefix("file:"))) and files == inside()
    want = fine.copy()
    for _ in range(3):
        gap = np.pad(coarse - want.reshape(4, 2, 5, 2).mean(axis=(1, 3)), 1, mode="edge")
        for r in range(8):
            for c in range(10):
                y, x, v, u = r // 2 + 1, c // 2 + 1, (-1 if r % 2 == 0 else 1), (-1 if c % 2 == 0 else 1)
                want[r, c] += 0.75 * (0.75 * gap[y, x] + 0.25 * gap[y, x + u]) + 0.25 * (0.75 * gap[y + v, x] + 0.25 * gap[y + v, x + u])
    assert len(got) == 80
    assert all(abs(got[r, c] - want[r, c]) < 1e-9 for r in range(8) for c in range(10))


def test_fine_rows_meet_their_flag_without_a_join(spark):
    coarse = spark.createDataFrame([(1, r, c, float(r + c), float(r % 2)) for r in range(2) for c in range(3)], "area_id int, row int, col int, x double, flag double").withColumn("day", F.lit("2024-01-01").cast("date"))
    up = G.upsample_bilinear(coarse, 2, ["x"], repeat=["flag"])
    assert {(r["row"], r["flag"]) for r in up.collect()} == {(0, 0.0), (1, 0.0), (2, 1.0), (3, 1.0)}
    assert "Join" not in up._jdf.queryExecution().optimizedPlan().toString()


def test_a_stream_keeps_its_state_in_the_parts_asked_for(spark, tmp_path):
    spark.range(40).selectExpr("timestamp_seconds(id) AS ts", "id % 4 AS k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k long").parquet(str(tmp_path / "in")).groupBy("k").count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with J.state_store(spark, None, 3):
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, i: b.count()).trigger(availableNow=True).start()
        q.awaitTermination()
    assert len([d for d in os.listdir(tmp_path / "state" / "state" / "0") if d.isdigit()]) == 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_regions_meet_points_without_broadcast(spark):
    """Two polygons with a hole each, a repeated point, and a plan that sends no unfolded side to the driver."""
    ring = lambda region, polygon, ring, x, y, h: [(region, polygon, ring, k, x + h * a, y + h * b) for k, (a, b) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)])]
    vertices = spark.createDataFrame([*ring(1, 0, 0, 0.0, 0.0, 5.0), *ring(1, 0, 1, 0.0, 0.0, 2.0), *ring(1, 1, 0, 3.0, 0.5, 4.0), *ring(1, 1, 1, 3.0, 0.5, 1.0), *ring(2, 0, 0, 50.0, 0.0, 3.0)],
                                     "region_id int, polygon int, ring int, seq int, lon double, lat double")
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 3.2, 0.6), (3, -4.5, 0.1), (4, 6.5, 0.6), (5, 49.1, 2.5), (6, 20.0, 0.0), (7, 49.1, 2.5), (7, 49.1, 2.5), (8, None, 1.0), (9, -1.5, 0.5)],
                                   "id int, lon double, lat double")
    found = P.points_in_regions(points, vertices, ["id"])
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _records_shuffled(plan):
    """Records that all exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _records_shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _records_shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(_records_shuffled(children.apply(i)) for i in range(children.size()))


def test_neighbour_means_shuffle_readings_and_no_pairs(spark):
    """With ten times the stations in the same place there are a hundred times the pairs, but no more rows a reading to deal out."""
    shuffled = {}
    for n in (60, 600):
        sites = spark.range(n).selectExpr("concat('S', id) station_id", f"19 + (id * 7919 % {n}) / {n}.0D * 1.5 lat", f"73 + (id * 104729 % {n}) / {n}.0D * 1.5 lon")
        obs = sites.crossJoin(spark.range(4).selectExpr("date_add(date'2024-01-01', cast(id as int)) day")).selectExpr("station_id", "day", "cast(length(station_id) as double) no2")
        got = S.neighbour_mean(obs, sites, 100.0)
        assert len(got.collect()) == 4 * n
        shuffled[n] = _records_shuffled(got._jdf.queryExecution().executedPlan())
    assert all(shuffled[n] < 8 * 4 * n for n in shuffled), shuffled


def test_surface_features_of_stations_are_dealt_out_once(spark):
    """Fine cells of all days go to their pixel and stay there: neither the mean over the days nor the stations move them again."""
    days, areas, width = 6, 3, 8
    grids = spark.createDataFrame([(a, 70.0 + a, 20.0, 0.1, width, width) for a in range(areas)], "area_id int, west double, north double, res double, width int, height int")
    coarse = (G.cell_spine(grids).select("area_id", "row", "col").crossJoin(spark.range(days).selectExpr("date_add(date'2024-01-01', cast(id as int)) day"))
              .selectExpr("area_id", "day", "row", "col", "cast(1 + row * 3 + col + dayofmonth(day) as double) no2_filled", "500D + col blh", "1D u10", "2D v10", "cast(row % 2 as int) fill_flag"))
    fine_grids = G.refine(grids, 2)
    static = G.cell_spine(fine_grids).select("area_id", "row", "col", (F.col("row") * 100 + F.col("col")).cast("double").alias("population"))
    obs = spark.createDataFrame([("a", 0, 19.99, 70.01, 1, 5.0), ("a", 0, 19.99, 70.01, 3, 6.0), ("b", 2, 19.26, 72.31, 2, 7.0), ("b", 2, 19.26, 72.31, 40, 8.0), ("c", 1, 19.9, 75.0, 1, 9.0)],
                                "station_id string, area_id int, lat double, lon double, d int, no2 double").withColumn("day", F.expr("date_add(date'2024-01-01', d - 1)")).drop("d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        column = G.upsample_bilinear(coarse.withColumnRenamed("no2_filled", "column"), 2, ["column"])
        want = {(r.area_id, r.day, r.row, r.col): r.column for r in column.collect()}
        table = M.station_table(M.surface_features(column, coarse, static, 2), obs, fine_grids)
        rows = table.collect()
        shuffled = _records_shuffled(table._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.station_id, r.day.day, r.row, r.col, r.no2) for r in rows) == [("a", 1, 0, 0, 5.0), ("a", 3, 0, 0, 6.0), ("b", 2, 14, 6, 7.0)]
    for r in rows:
        assert r.column == want[r.area_id, r.day, r.row, r.col] and r.population == r.row * 100 + r.col
        days_of_pixel = [v for k, v in want.items() if (k[0], k[2], k[3]) == (r.area_id, r.row, r.col)]
        assert len(days_of_pixel) == days and abs(r.pbl_conc_anom / (r.column - np.mean(days_of_pixel)) - r.pbl_conc / r.column) < 1e-9
    assert shuffled < 3.5 * len(want), (shuffled, len(want))
