"""Steps whose tasks would hold more and more rows as tables grow: they are dealt into a given number of parts."""

import datetime as dt
import math

from pyspark.sql import functions as F

from gridair.operators import cells as G
from gridair.operators import forecast as P
from gridair.operators import spatial as Z

GRID = "area_id int, west double, north double, res double, width int, height int"


def _most(df):
    """Rows of the fullest part, and all of them."""
    n = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(n), sum(n)


def _cells(spark, areas=16):
    return spark.range(areas * 100).selectExpr("cast(floor(id / 100) as int) area_id", "date_add(date'2024-01-01', cast(floor(id / 1000000) as int)) day", "cast(floor(id % 100 / 10) as int) row", "cast(id % 10 as int) col",
                                               "cast(1 + id % 7 as double) no2", "cast(id % 3 as double) - 1 as u10", "cast(id % 5 as double) - 2 as v10")


def _grids(spark, areas=16):
    return spark.createDataFrame([(a, 70.0 + 0.4 * a, 20.0, 0.035, 10, 10) for a in range(areas)], GRID)


def test_frames_are_summed_in_as_many_parts_as_given(spark):
    """Sums of few rows were put into one part, whatever the session's number; it then grew with the table."""
    most, total = _most(P.drift_projection(_cells(spark), _grids(spark), (1.0, 3.0)))
    assert total > 3000 and most < total / 4


def test_frames_are_those_of_a_plain_sum(spark):
    cells, grids = _cells(spark, 2).collect(), {g.area_id: g for g in _grids(spark, 2).collect()}
    for persistent in (True, False):
        want = {}
        for c in cells:
            g = grids[c.area_id]
            dx, dy = g.res * 111320.0 * math.cos(math.radians(g.north - g.height * g.res / 2)), g.res * 110574.0
            for h in (1.0, 3.0):
                w = math.exp(-h / 4)
                to = [(math.floor(c.row - c.v10 * h * 3600 / dy + 0.5), math.floor(c.col + c.u10 * h * 3600 / dx + 0.5), c.no2 * w)] + [(c.row, c.col, c.no2 * (1 - w))] * persistent
                for r, k, v in to:
                    if 0 <= r < 10 and 0 <= k < 10:
                        want[c.area_id, c.day, h, r, k] = want.get((c.area_id, c.day, h, r, k), 0.0) + v
        rows = P.drift_projection(_cells(spark, 2), _grids(spark, 2), (1.0, 3.0), persistent=persistent)
        assert rows.columns == ["area_id", "day", "horizon", "row", "col", "value"]
        got = {tuple(r)[:5]: r.value for r in rows.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lines_are_cut_in_as_many_parts_as_given(spark):
    """A line that meets a grid in several tiles is cut once, and its cells are not gathered in one part."""
    point = lambda la, lo: f"named_struct('lat', {la}, 'lon', {lo})"
    lines = spark.range(400).selectExpr("id", f"array({point('20.6D - id / 1000', '69.9D')}, {point('18.9D', '76.5D')}) as path")
    grids = _grids(spark).withColumn("width", F.lit(40)).withColumn("height", F.lit(40))
    cells = Z.line_cells(lines, grids)
    most, total = _most(cells)
    assert total == cells.distinct().count() > 5000 and most < total / 4


def test_a_line_and_a_grid_over_many_tiles_meet_once(spark):
    rows = spark.createDataFrame([(1, [(19.9, 70.1), (17.2, 73.3)]), (1, [(19.9, 70.1), (17.2, 73.3)]), (None, [(17.2, 73.3), (19.9, 70.1)]), (3, [(19.0, 71.0)])],
                                 "id int, path array<struct<lat: double, lon: double>>")
    grid = spark.createDataFrame([(0, 70.0, 20.0, 0.1, 40, 40), (0, 70.0, 20.0, 0.1, 40, 40)], GRID)
    got = Z.line_cells(rows, grid).collect()
    assert len(got) == len(set(got))
    one = {(r.row, r.col) for r in got if r.id == 1}
    want = {(math.floor((20.0 - la) / 0.1), math.floor((lo - 70.0) / 0.1)) for la, lo in ((19.9 - 2.7 * (k + 0.5) / 20000, 70.1 + 3.2 * (k + 0.5) / 20000) for k in range(20000))}
    assert want <= one and len(one) <= len(want) + 2 and one == {(r.row, r.col) for r in got if r.id is None}


def test_fine_cells_are_refined_in_as_many_parts_as_given(spark):
    """The lines of few areas were sorted in one part, with all that is around each cell."""
    fine = G.upsample_bilinear(_cells(spark, 64), 2, ["no2", "u10"])
    most, total = _most(fine)
    assert total == 64 * 400 and most < total / 2
