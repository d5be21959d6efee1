"""The source protocols: contract, filters on folders, tasks."""

import datetime as dt

import pytest

from gridair.sources import protocol as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("protocol") / "cells")
    rows = [(a, dt.date(2024, 1, 1 + d), r, 0, float(a + d + r), "extra") for a in range(4) for d in range(6) for r in range(5)] + [(None, dt.date(2024, 1, 1), 0, 0, 1.0, "x")]
    df = spark.createDataFrame(rows, "area_id int, day date, row int, col int, no2 double, note string")
    df.repartition("area_id", "day").write.partitionBy("area_id", "day").parquet(path)
    S.register(spark)
    return path


def read(spark, folder, kind="satellite"):
    return spark.read.format("gridair").option("kind", kind).load(folder)


def test_all_rows_with_the_columns_of_the_contract(spark, folder):
    df = read(spark, folder)
    assert df.dtypes == [("row", "int"), ("col", "int"), ("no2", "double"), ("area_id", "int"), ("day", "date")]
    assert df.count() == 121 and df.where("area_id is null").count() == 1
    same = spark.read.parquet(folder).select("row", "col", "no2", "area_id", "day")
    assert df.exceptAll(same).count() == same.exceptAll(df).count() == 0


def test_filters_leave_folders_out(spark, folder, monkeypatch):
    reader = S.ProtocolReader(folder, "satellite")
    monkeypatch.setattr(S, "TASK_BYTES", 1)
    assert len(reader.partitions()) == 25
    filters = [S.EqualTo(("area_id",), 2), S.GreaterThanOrEqual(("day",), dt.date(2024, 1, 4)), S.EqualTo(("row",), 1)]
    assert list(reader.pushFilters(filters)) == filters[2:]
    tasks = reader.partitions()
    assert len(tasks) == 3 and all("area_id=2" in p for t in tasks for p, _ in t.files)
    df = read(spark, folder).where("area_id in (1, 2) and day < date'2024-01-03' and row = 4")
    assert sorted((r.area_id, r.day.day, r.no2) for r in df.collect()) == [(1, 1, 5.0), (1, 2, 6.0), (2, 1, 6.0), (2, 2, 7.0)]
    assert read(spark, folder).where("area_id = 77").count() == 0


def test_a_table_that_breaks_its_contract_says_which_column(spark, folder):
    with pytest.raises(Exception, match="missing columns: .*u10"):
        read(spark, folder, "weather").collect()
    with pytest.raises(Exception, match="kind must be one of"):
        read(spark, folder, "other").collect()


def test_a_level_left_out_is_read_and_filtered_in_the_files(spark, folder, tmp_path):
    path = str(tmp_path / "days")
    spark.read.parquet(folder).repartition("day").write.partitionBy("day").parquet(path)
    df = read(spark, path)
    assert df.dtypes == [("row", "int"), ("col", "int"), ("no2", "double"), ("area_id", "int"), ("day", "date")]
    same = spark.read.parquet(folder).select("row", "col", "no2", "area_id", "day")
    assert df.exceptAll(same).count() == same.exceptAll(df).count() == 0
    for rule in ("area_id = 2 and day >= date'2024-01-04'", "area_id in (1, 3)", "area_id > 1 and area_id <= 3", "area_id < 1", "area_id >= 3", "area_id is null", "area_id % 2 = 1"):
        assert sorted(df.where(rule).collect(), key=str) == sorted(same.where(rule).collect(), key=str), rule
    reader = S.ProtocolReader(path, "satellite")
    assert list(reader.pushFilters([S.EqualTo(("area_id",), 2), S.EqualTo(("day",), dt.date(2024, 1, 4))])) == []
    assert all("day=2024-01-04" in p for t in reader.partitions() for p, _ in t.files)


def test_files_of_the_satellite_source_do_not_follow_areas(spark, tmp_path, monkeypatch):
    """Each area and day had a folder of its own: 40 areas on 3 days gave 120 files."""
    import glob
    from gridair.plans import q_sources as Q
    from gridair.streaming import jobs

    class Given:
        def __init__(self):
            self.spark = spark

        def table(self, name):
            return spark.range(40 * 3 * 4).selectExpr("cast(id % 40 as int) area_id", "date_add(date'2024-01-19', cast(floor(id / 40) % 3 as int)) day",
                                                      "cast(floor(id / 120) as int) row", "0 col", "cast(id as double) no2")
    monkeypatch.setattr(jobs, "work_folder", lambda s, kind: str(tmp_path))
    got = {(r.area_id, r.row): (r.n, r["mean"]) for r in Q.udx_04a(Given()).collect()}
    assert got == {(a, row): (2, sum(a + 40 * d + 120 * row for d in (1, 2)) / 2) for a in range(0, 40, 2) for row in range(4)}
    assert len(glob.glob(f"{tmp_path}/table/day=*")) == 3 and len(glob.glob(f"{tmp_path}/table/**/*.parquet", recursive=True)) <= 3 + 8
