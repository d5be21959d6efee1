"""Greedy picks, balanced groups and covering periods beside plain computations."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridair.operators import places as P
from gridair.operators import spatial as Z
from gridair.operators import stations as S
from tests.test_exact import field, grid

rnd = random.Random(4)


@pytest.mark.parametrize("ties", [False, True])
def test_picks_equal_repeated_maxima(spark, ties):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 4, (25, 30)).astype(float) if ties else rng.uniform(0, 9, (25, 30))
    f = field(spark, a).withColumn("x", F.lit(1))
    for n, radius in ((1, 3), (6, 5), (40, 2)):
        far = lambda c, p, r=radius: ((c["row"] - p["row"]) * (c["row"] - p["row"]) + (c["col"] - p["col"]) * (c["col"] - p["col"])) > r * r
        df = Z._greedy(f, n, "no2", ["x"], far, Z._disk(radius))
        got = [(r["row"], r["col"]) for r in sorted(df.collect(), key=lambda r: r["rank"])]
        work, want, (rr, cc) = a.copy(), [], np.mgrid[0:25, 0:30]
        while len(want) < n and work.max() >= 0:
            i, j = np.unravel_index(work.argmax(), work.shape)
            want.append((i, j))
            work[(rr - i) ** 2 + (cc - j) ** 2 <= radius ** 2] = -1
        assert got == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2 and "WindowGroupLimit" in plan and "RDD" not in plan.replace("ExistingRDD", "").replace("ScalaRDD", "")


def test_picks_of_a_centre_grid(spark):
    assert Z.separated_top(field(spark, np.full((3, 3), np.nan)), grid(spark, 3, 3)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 5, 7])
def test_groups_differ_by_one_station_at_most(spark, n):
    df = spark.createDataFrame([(f"S{i}",) for i in range(203)] * 2, "station_id string").repartition(5)
    got = S.station_groups(df, n)
    sizes = sorted(r["count"] for r in got.groupBy("station_group").count().collect())
    assert sum(sizes) == 203 and len(sizes) == n and sizes[-1] - sizes[0] <= 1
    assert got.exceptAll(S.station_groups(df.repartition(2), n)).count() == 0
    assert S.station_groups(df.limit(0), n).count() == 0


def test_covering_periods_beside_all_pairs(spark):
    day = lambda d: None if d is None else dt.date(1969, 12, 1) + dt.timedelta(days=d)
    stored = [(k, rnd.randint(0, 60), None) for k in range(8) for _ in range(rnd.randint(0, 25))] + [(99, rnd.randint(0, 30), None) for _ in range(2000)]
    stored = [(k, a, a + rnd.randint(0, 50)) for k, a, _ in stored]
    wanted = [(k, a, a + rnd.randint(0, 30)) for k in [*range(10), 99] for a in (rnd.randint(0, 80) for _ in range(20))] + [(1, None, 5), (2, 5, None)]
    frame = lambda rows: spark.createDataFrame([(k, day(a), day(b)) for k, a, b in rows], "k long, lo date, hi date")
    df = P.covering_period(frame(wanted), frame([*stored, (1, None, 3)]), ["k"])
    want = {}
    for k, a, b in wanted:
        over = [(y - x, x, y) for s, x, y in stored if a is not None and b is not None and s == k and x <= a and y >= b]
        if over:
            want[k, day(a), day(b)] = (day(min(over)[1]), day(min(over)[2]))
    assert {(r.k, r.lo, r.hi): (r.stored_lo, r.stored_hi) for r in df.collect()} == want and len(want) > 40
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    far = [(1, dt.date(1, 1, 1), dt.date(9999, 12, 31))]
    assert P.covering_period(spark.createDataFrame(far, "k long, lo date, hi date"), spark.createDataFrame(far, "k long, lo date, hi date"), ["k"]).count() == 1


def test_patch_samples_are_rejected_patch_by_patch(spark):
    from gridair.operators import forecast as T
    rng = np.random.default_rng(3)
    days = [rng.uniform(1, 50, (6, 6)) for _ in range(10)]
    for d in days:
        d[:3, :3] = np.where(rng.uniform(size=(3, 3)) < 0.9, np.nan, d[:3, :3])
    dense = field(spark, days[0], "2025-11-01")
    for k, d in enumerate(days[1:], 2):
        dense = dense.unionByName(field(spark, d, f"2025-11-{k:02d}"))
    got = {(r.patch_row, r.patch_col, r.start_day.day): r for r in T.patch_samples(dense, grid(spark, 6, 6), ("no2",), 3, 3, 2, 3).collect()}
    for pr in (0, 3):
        for pc in (0, 3):
            for start in range(6):
                b = [d[pr:pr + 3, pc:pc + 3].ravel() for d in days[start:start + 5]]
                inputs = [[b[0], b[0]], [b[1], b[0]]]
                share = np.isnan(np.array(inputs)).mean()
                r = got.get((pr, pc, start + 1))
                assert (r is not None) == (share <= 0.3)
                if r:
                    assert r.null_share == pytest.approx(share)
                    assert np.array_equal(np.array(r.inputs), np.nan_to_num(np.array(inputs))) and np.array_equal(np.array(r.targets), np.nan_to_num(np.array(b[2:])))
    assert {k[:2] for k in got} >= {(0, 3), (3, 0), (3, 3)} and len(got) < 24


def test_refinement_does_not_reach_over_a_hole(spark):
    from gridair.operators import cells as G
    line = field(spark, np.array([[0.0, 10.0, 20.0, 30.0, 40.0, 50.0]] * 3))
    whole = {(r.row, r.col): r.no2 for r in G.upsample_bilinear(line, 2, ["no2"]).collect()}
    holed = {(r.row, r.col): r.no2 for r in G.upsample_bilinear(line.where("NOT (row = 1 AND col = 2)"), 2, ["no2"]).collect()}
    assert whole[2, 3] == 12.5 and len(holed) == len(whole) - 4
    # Fine cells that lean on the hole are missing; the others are as before.
    lean = {(r, c) for r in (1, 2, 3, 4) for c in (3, 4, 5, 6)} - {(r, c) for r in (2, 3) for c in (4, 5)}
    assert {k for k, v in holed.items() if v is None} == lean and all(holed[k] == whole[k] for k in holed if k not in lean)
