"""National training: folds by group, a ledger that a stopped run goes on from, scores from held-out rows."""

import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gridair.operators import models as M
from gridair.operators import ledger as L
from gridair.operators import national as N


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(f"ST{s}", None if s == 5 else f"City{s % 2}", 19.0 + s, 72.0, dt.date(2023 + d // 20, 1, 1) + dt.timedelta(days=d % 20), float(x), float(2 * x + rng.normal(0, 0.1)))
            for s in range(6) for d in range(40) for x in [rng.uniform(5, 50)]]
    df = spark.createDataFrame(rows, "station_id string, city string, lat double, lon double, day date, column double, no2 double")
    return df.withColumn("year", F.year("day")).withColumn("noise", F.rand(3))


def recipes(learn=None):
    line = M.direct(LinearRegression)
    return {r.name: r for r in (M.Recipe("line", ("column",), learn or line), M.Recipe("noise", ("noise",), line), M.Recipe("unfair", ("no2",), line, may_win=False))}


class Stop(Exception):
    pass


def test_a_stopped_run_goes_on(spark, table, tmp_path):
    plain, calls, lock = M.direct(LinearRegression), [], threading.Lock()

    def counted(limit):
        def learn(df, inputs, target):
            with lock:
                calls.append(1)
                if len(calls) > limit:
                    raise Stop
            return plain(df, inputs, target)
        return learn
    folder = str(tmp_path)
    with pytest.raises(Stop):
        N.train_national(table, recipes(counted(5)), folder, n=2, in_flight=2)
    run = N.train_national(table, recipes(), folder, n=2, in_flight=3)
    calls.clear()
    t, designs, skipped = N.designs_of(table, 2)
    fits = sum(map(len, designs.values()))
    assert not skipped and {k: len(f) for k, f in designs.items()} == {"unseen_stations_and_dates": len(designs[N.BLOCKED]), "unseen_cities": 3, "unseen_years": 2}
    # All fits are there now: none runs again, also with another learner.
    ledger = L.Ledger(spark, next(str(p) for p in tmp_path.iterdir() if p.name.startswith("fits-")))
    assert len(ledger.done()) == 3 * fits
    assert L.run_fits(t, recipes(counted(0)), designs, ledger) == 0
    assert run.selected == "line" and set(run.report.select("model").distinct().toPandas()["model"]) == {"line", "noise", "unfair"}
    assert run.model.predict(table).where("abs(pred - no2) > 1").count() == 0
    cover = N.fold_coverage(run.held_out).collect()
    assert all(r.repeated_rows == 0 for r in cover)
    for design in designs:
        assert sum(r.predicted_rows for r in cover if r.design == design and r.model == "line") == 240
    assert {(r.fold, r.train_rows) for r in cover if r.design == "unseen_cities"} == {("None", 200), ("City0", 120), ("City1", 160)}


def test_an_uncommitted_fit_does_not_count(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, 1.0, "x", 3)], L.HELD_OUT)
    ledger.write(("d", "m", 0), rows)
    ledger.write(("d", "m", 1), rows)
    (tmp_path / "design=d" / "model=m" / "fold=1" / "_SUCCESS").unlink()
    assert ledger.done() == {("d", "m", 0)} and ledger.rows(L.HELD_OUT).count() == 1
    ledger.write(("d", "m", 1), rows)
    assert ledger.rows(L.HELD_OUT).count() == 2
    assert L.Ledger(spark, str(tmp_path / "none")).rows(L.HELD_OUT).count() == 0


def test_a_design_of_one_group_is_skipped(spark, table):
    one = table.withColumn("city", F.lit("A"))
    assert N.designs_of(one, 2)[2] == ["unseen_cities"]


def test_scores_by_group_equal_scores_of_each(spark, table):
    from gridair.operators import stations as S
    df = table.withColumn("pred", F.col("no2") + F.col("noise"))
    grouped = {(r.year, r.part): r for r in S.summarize_predictions(df, by=["year"]).collect()}
    for year in (2023, 2024):
        for r in S.summarize_predictions(df.where(F.col("year") == year)).collect():
            got = grouped[year, r.part]
            assert got.n == r.n and all(abs(got[c] - r[c]) < 1e-9 for c in ("r2", "rmse", "mae", "mbe", "median_within_station_r"))
