"""Whole-field operators: smoothing, nearest fill, hotspots, components, clusters, pyramids, roads, anomalies.

Fields are handled line by line.  A grid line holds ``width`` or ``height`` values, which bounds every array
below; days, areas and lines are spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import bands
from gridair.functions.arrays import labels
from gridair.functions.quantiles import exact_quantiles
from gridair.operators import cells as G
from gridair.operators.facts import source_tags
from gridair.operators.flux import corner_table
from gridair.operators.near import within_radius
from gridair.operators.places import nearest_place
from gridair.schemas import CELL_KEY, DAY_KEY
from gridair.session import cut_lineage


# --------------------------------------------------------------------------------------------- smoothing
def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def _line_filter(kernel: list[float]):
    """Arrow-batched convolution of grid lines, mirrored at both ends."""
    k = np.asarray(kernel)
    radius = len(k) // 2

    @F.pandas_udf("array<double>")
    def smooth(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lines:
            out = [None] * len(batch)
            width = batch.map(len)
            for n in width.unique():  # lines of equal length are filtered together, tap by tap
                where = np.flatnonzero(width.to_numpy() == n)
                x = np.pad(np.stack(batch.iloc[where].to_list()).astype("float64"), ((0, 0), (radius, radius)), mode="symmetric")
                y = sum(k[i] * x[:, i:i + n] for i in range(len(k)))
                for i, line in zip(where, y, strict=True):
                    out[i] = line
            yield pd.Series(out, dtype="object")

    return smooth


def gaussian_smooth(cells: DataFrame, sigma: float, columns: dict[str, str], keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Gaussian smoothing (cut at four sigma, mirrored edges) of ``columns`` {source: result}, along columns then
    rows.  ``cells`` holds every cell of each grid without missing values; a line with a hole raises."""
    smooth = _line_filter(gaussian_kernel(sigma))
    names = list(columns.values())

    def field(name: str):
        return lambda x: x[name]

    out = cells.select(*keys, "row", "col", *[F.col(s).cast("double").alias(r) for s, r in columns.items()])
    for across, along in (("row", "col"), ("col", "row")):
        packed = out.groupBy(*keys, across).agg(F.sort_array(F.collect_list(F.struct(along, *names))).alias("_line"))
        # A hole would be closed up silently, so that cells beyond it came to lie too near.
        whole = F.element_at("_line", -1)[along] - F.element_at("_line", 1)[along] + 1 == F.size("_line")
        packed = packed.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a grid line has holes: fill them before smoothing")).cast("boolean")))
        parts = packed.select(*keys, across, F.transform("_line", field(along)).alias("_at"),
                              *[smooth(F.transform("_line", field(n))).alias(n) for n in names])
        out = (parts.select(*keys, across, F.explode(F.arrays_zip("_at", *names)).alias("_z"))
               .select(*keys, across, F.col("_z._at").alias(along), *[F.col(f"_z.{n}").alias(n) for n in names]))
    return cells.join(out, [*keys, "row", "col"])


# --------------------------------------------------------------------------------------------- nearest fill
def _nearest_filter():
    """Arrow-batched lookup of the nearest valid cell along grid lines (self-contained, so that workers need only
    numpy and pandas)."""

    @F.pandas_udf("array<double>")
    def nearest(row: pd.Series, source_rows: pd.Series, values: pd.Series) -> pd.Series:
        out = [None] * len(row)
        width = source_rows.map(len).to_numpy()
        for n in np.unique(width):  # lines of equal length together, in pieces of bounded work space
            lines = np.flatnonzero(width == n)
            piece = max(1, 2_000_000 // int(n * min(n, 512)))
            cols = np.arange(n)
            for a in range(0, len(lines), piece):
                at = lines[a:a + piece]
                sr = np.stack(source_rows.iloc[at].to_list()).astype("float64")
                v = np.stack(values.iloc[at].to_list()).astype("float64")
                known = np.isfinite(sr)
                down2 = np.where(known, (sr - row.iloc[at].to_numpy()[:, None].astype("float64")) ** 2, np.inf)
                order = np.where(known, sr * (n + 1.0) + cols[None, :], np.inf)
                best = np.empty(sr.shape)
                for lo in range(0, n, 512):
                    here = np.arange(lo, min(lo + 512, n))
                    d2 = (here[:, None] - cols[None, :]) ** 2 + down2[:, None, :]
                    tied = d2 == d2.min(axis=2, keepdims=True)
                    pick = np.where(tied, order[:, None, :], np.inf).argmin(axis=2)
                    best[:, here] = np.take_along_axis(v, pick, axis=1)
                best[~known.any(axis=1)] = np.nan
                for i, line in zip(at, best, strict=True):
                    out[i] = line
        return pd.Series(out, dtype="object")

    return nearest


def fill_nearest(dense: DataFrame, value: str = "no2", keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Missing cells take the nearest valid cell of their day (ties: northern, then western source).

    Exact in two sweeps: the nearest valid row within each column by windows, then the best column along each
    line that has a gap.  Days without any valid cell stay missing.
    """
    w = Window.partitionBy(*keys, "col").orderBy("row")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("row").alias("r"), F.col(value).alias("v")))
    up = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys, "col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    down = F.last(known, ignorenulls=True).over(back)
    c = dense.select(*keys, "row", "col", value).withColumn("_u", up).withColumn("_d", down)
    closer_up = F.coalesce(F.col("row") - F.col("_u.r") <= F.col("_d.r") - F.col("row"), F.col("_u").isNotNull())
    c = c.withColumn("_s", F.when(closer_up, F.col("_u")).otherwise(F.col("_d")))
    lines = (c.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("col", F.col("_s.r").alias("r"), F.col("_s.v").alias("v")))).alias("_l"),
                                         F.count_if(F.col(value).isNull()).alias("_gaps"))
             .where(F.col("_gaps") > 0))
    got = lines.select(*keys, "row", F.transform("_l", lambda x: x["col"]).alias("_c"), _nearest_filter()(
        "row", F.transform("_l", lambda x: x["r"].cast("double")), F.transform("_l", lambda x: x["v"])).alias("_v"))
    filled = (got.select(*keys, "row", F.explode(F.arrays_zip("_c", "_v")).alias("_z"))
              .select(*keys, "row", F.col("_z._c").alias("col"), F.nanvl(F.col("_z._v"), F.lit(None).cast("double")).alias("_near")))
    return (dense.join(filled, [*keys, "row", "col"], "left").withColumn(value, F.coalesce(value, "_near")).drop("_near"))


def window_max(cells: DataFrame, half: int, value: str, name: str, keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Maximum over the (2 half + 1)-square around each cell: along columns, then rows."""
    w, v = (G._line(keys, a).rangeBetween(-half, half) for a in ("col", "row"))
    return cells.withColumn(name, F.max(value).over(w)).withColumn(name, F.max(name).over(v))


# --------------------------------------------------------------------------------------------- greedy top-n
def _greedy(field: DataFrame, n: int, score: str, keep: list[str], apart, disk: Column | int, keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Repeated maximum with suppression around earlier picks, in one shuffle.

    ``apart(cell, pick)`` says whether a cell is far enough from a pick; a pick can suppress at most ``disk`` cells, so
    the ``n`` picks are among a group's ``n * disk`` highest cells.  These are listed in order and folded once: a cell that
    is apart from every pick so far becomes the next one.  Ties go to the northern, then western cell.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "row", "col"))
    cell = F.struct(F.col(score).alias("s"), (-F.col("row")).alias("nr"), (-F.col("col")).alias("nc"), "row", "col", *keep)
    high = field.withColumn("_n", place).where(F.col("_n") <= disk * n).groupBy(*keys).agg(F.sort_array(F.collect_list(cell), asc=False).alias("_c"))
    none = F.slice("_c", F.lit(1), F.lit(0))
    fold = F.aggregate("_c", none, lambda picks, c: F.when((F.size(picks) < n) & F.forall(picks, lambda p: apart(c, p)), F.concat(picks, F.array(c))).otherwise(picks))
    return (high.select(*keys, F.posexplode(fold).alias("_at", "_p"))
            .select(*keys, (F.col("_at") + 1).alias("rank"), "_p.row", "_p.col", F.col("_p.s").alias(score), *[F.col(f"_p.{k}").alias(k) for k in keep]))


def _disk(cells: Column | float) -> Column | int:
    """Cells of the square around a disk of that many cells radius: no fewer than the disk has."""
    if isinstance(cells, (int, float)):
        return (2 * math.ceil(cells) + 1) ** 2
    return F.pow(F.ceil(cells) * 2 + 1, F.lit(2.0))


def hotspots(cells: DataFrame, grids: DataFrame, static: DataFrame | None = None, places: DataFrame | None = None, n: int = 3,
             sigma: float = 2.0, separation: int = 10, value: str = "no2") -> DataFrame:
    """The ``n`` highest places of the smoothed field per area and day, at least ``separation`` cells apart, with
    the window maximum, its band, likely sources and the nearest named place.  ``cells`` is dense; missing cells
    take the day's mean."""
    mean = G.day_mean(cells, value)
    full = cells.join(mean, list(DAY_KEY)).withColumn("_v", F.coalesce(value, "day_mean")).where(F.col("_v").isNotNull())
    field = gaussian_smooth(full.select(*CELL_KEY, "_v"), sigma, {"_v": "smooth"})
    field = window_max(field, 2, "_v", "peak").select(*CELL_KEY, "smooth", "peak")
    far = lambda c, p: ((c["row"] - p["row"]) * (c["row"] - p["row"]) + (c["col"] - p["col"]) * (c["col"] - p["col"])) > separation ** 2
    top = G.with_centre(_greedy(field, n, "smooth", ["peak"], far, _disk(separation)), grids)
    top = (top.withColumn("lat", F.round("lat", 4)).withColumn("lon", F.round("lon", 4)).withColumn("value", F.round("peak", 1))
           .withColumn("band", bands.hazard_band(F.col("peak"), "key")))
    if static is not None:
        tags = source_tags(smoothed_layers(static, sigma)).select("area_id", "row", "col", F.col("tags").alias("sources"))
        top = top.join(tags, ["area_id", "row", "col"], "left").withColumn("sources", F.coalesce("sources", F.array(F.lit("background"))))
    if places is not None:
        top = nearest_place(top.withColumn("point_id", F.concat_ws("|", *DAY_KEY, "rank")), places).drop("point_id", "near_km")
    return top.drop("peak")


def separated_top(cells: DataFrame, grids: DataFrame, places: DataFrame | None = None, n: int = 8, degrees: float = 0.038,
                  value: str = "no2") -> DataFrame:
    """The ``n`` highest cells per area and day that lie at least ``degrees`` apart, with severity and locality."""
    c = G.with_centre(cells.where(F.col(value).isNotNull()).select(*CELL_KEY, value), grids)
    c = c.withColumn("lat", F.round("lat", 4)).withColumn("lon", F.round("lon", 4))
    apart = lambda a, p: ((a["lat"] - p["lat"]) * (a["lat"] - p["lat"]) + (a["lon"] - p["lon"]) * (a["lon"] - p["lon"])) >= degrees ** 2
    # One cell more than the distance: centres are rounded to four decimals.
    c = c.join(grids.select("area_id", F.col("res").alias("_res")), "area_id")
    top = _greedy(c, n, value, ["lat", "lon"], apart, _disk(F.lit(degrees) / F.col("_res") + 1)).withColumn(value, F.round(value, 1)).withColumn("severity", bands.severity(F.col(value)))
    if places is None:
        return top
    near = within_radius(top.select(*DAY_KEY, "rank", "lat", "lon"),
                         places.select("name", F.col("lat").alias("src_lat"), F.col("lon").alias("src_lon")), 9.0)
    d2 = (F.col("lat") - F.col("src_lat")) * (F.col("lat") - F.col("src_lat")) + (F.col("lon") - F.col("src_lon")) * (F.col("lon") - F.col("src_lon"))
    best = (near.withColumn("_d2", d2).where(F.col("_d2") < 0.005).groupBy(*DAY_KEY, "rank").agg(F.min(F.struct("_d2", "name")).alias("_n")))
    text = F.format_string("Grid Cluster (%.3f°N, %.3f°E)", F.col("lat"), F.col("lon"))
    return top.join(best, [*DAY_KEY, "rank"], "left").withColumn("name", F.coalesce("_n.name", text)).drop("_n")


def smoothed_layers(static: DataFrame, sigma: float, layers: tuple[str, ...] = ("road_density", "night_lights", "ghsl_built", "power_plants")) -> DataFrame:
    """Static layers with missing values as zero, smoothed in place."""
    zero = static.select("area_id", "row", "col", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_{n}") for n in layers])
    s = gaussian_smooth(zero, sigma, {f"_{n}": n for n in layers}, keys=("area_id",))
    return s.select("area_id", "row", "col", *layers)


def focal_layers(static: DataFrame, layers: tuple[str, ...], sigmas: tuple[int, ...] = (2, 6)) -> DataFrame:
    """Static layers with their smoothed versions ``<layer>_s<sigma>``."""
    out = static
    for s in sigmas:
        out = gaussian_smooth(out, float(s), {n: f"{n}_s{s}" for n in layers}, keys=("area_id",))
    return out


# --------------------------------------------------------------------------------------------- components
def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``label`` (smallest node id of the component) for every ``node`` of ``nodes``, per ``keys``.

    Alternates large-star and small-star steps until the edges stop changing; the number of rounds grows with
    the logarithm of the longest component.  Every round is checkpointed.
    """
    e = cut_lineage(edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # large star: every larger neighbour is attached to the smallest node around
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its smaller neighbours are attached to the smallest of them
        low2 = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        e = cut_lineage(large.join(low2, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low2.select(*keys, "u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    up = e.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return nodes.select(*keys, "node").join(up, [*keys, "node"], "left").withColumn("label", F.coalesce("label", "node"))


def label_components(flagged: DataFrame, keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """``component`` of flagged cells joined through their four neighbours.

    Cells of a line are first merged into runs by a window, so that only runs and their vertical contacts enter
    the iteration.  A node is ``row * 2^31 + first column`` of a run.
    """
    w = Window.partitionBy(*keys, "row").orderBy("col")
    c = flagged.withColumn("_g", F.col("col") - F.row_number().over(w))
    starts = c.groupBy(*keys, "row", "_g").agg(F.min("col").alias("_first"))
    c = c.join(starts, [*keys, "row", "_g"]).withColumn("node", F.col("row").cast("bigint") * (1 << 31) + F.col("_first")).drop("_g", "_first")
    c = cut_lineage(c)
    below = c.select(*keys, (F.col("row") - 1).alias("row"), "col", F.col("node").alias("b"))
    edges = c.select(*keys, "row", "col", F.col("node").alias("a")).join(below, [*keys, "row", "col"]).select(*keys, "a", "b").distinct()
    lab = connected_components(c.select(*keys, "node").distinct(), edges, list(keys))
    return c.join(lab, [*keys, "node"]).withColumnRenamed("label", "component").drop("node")


def cloud_zones(imputed: DataFrame, grids: DataFrame, res: float, eps: float = 0.045, min_points: int = 3,
                keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Density clusters of imputed cells: centre, radius in metres (2200..4500) and size per cluster.

    Cells lie on a regular grid, so the cells within ``eps`` are a fixed set of offsets looked up by key.
    """
    reach = int(eps / res + 1e-9)
    steps = [(j, i) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1) if (j * j + i * i) * res * res <= eps * eps * (1 + 1e-9)]
    pts = imputed.select(*keys, "row", "col").distinct().withColumn("node", F.col("row").cast("bigint") * (1 << 31) + F.col("col"))
    around = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j, i in steps]))
    shifted = (pts.withColumn("_o", around).select(*keys, F.col("node").alias("a"), (F.col("row") + F.col("_o.j")).alias("row"), (F.col("col") + F.col("_o.i")).alias("col")))
    pairs = cut_lineage(shifted.join(pts.withColumnRenamed("node", "b"), [*keys, "row", "col"]).select(*keys, "a", "b"))
    core = cut_lineage(pairs.groupBy(*keys, F.col("a").alias("node")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points).select(*keys, "node"))
    as_ = lambda n: core.select(*keys, F.col("node").alias(n))
    edges = pairs.join(as_("a"), [*keys, "a"], "left_semi").join(as_("b"), [*keys, "b"], "left_semi")
    lab = cut_lineage(connected_components(core, edges, list(keys)))
    # A cell belongs to its own cluster or, on a cluster's border, to the smallest cluster it touches.
    touch = pairs.join(lab.select(*keys, F.col("node").alias("b"), "label"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("_t"))
    member = (pts.join(touch, [*keys, "node"]).join(lab, [*keys, "node"], "left").withColumn("label", F.coalesce("label", "_t")))
    at = G.with_centre(member.select(*keys, "row", "col", "label"), grids)
    centre = at.groupBy(*keys, "label").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"), F.count("*").alias("cells"))
    far = F.max(F.sqrt((F.col("lat") - F.col("clat")) * (F.col("lat") - F.col("clat")) + (F.col("lon") - F.col("clon")) * (F.col("lon") - F.col("clon"))))
    out = at.join(centre, [*keys, "label"]).groupBy(*keys, "label", "clat", "clon", "cells").agg(far.alias("_f"))
    return out.select(*keys, "label", F.round("clat", 4).alias("lat"), F.round("clon", 4).alias("lon"), "cells",
                      F.greatest(F.lit(2200), F.least(F.lit(4500), F.floor(F.col("_f") * 111000).cast("int"))).alias("radius_m"))


# --------------------------------------------------------------------------------------------- pyramid
def pyramid_fill(grid: DataFrame, width: int, height: int, value: str = "no2") -> DataFrame:
    """``filled``: gaps of a global grid from coarser and coarser averages, longitude wrapped.

    ``grid`` holds every cell.  Each level has a quarter of the cells of the one below, and every step up looks
    up four corners through one equi-join.
    """
    level = grid.select("row", "col", F.coalesce(value, F.lit(0.0)).alias("v"), F.col(value).isNotNull().cast("double").alias("w"))
    stack = [(level, width, height)]
    w, h = width, height
    while w > 2 and h > 2:
        w, h = math.ceil(w / 2), math.ceil(h / 2)
        half = lambda c: F.floor(F.col(c) / F.lit(2.0)).cast("int").alias(c)
        s = F.sum("w")
        level = cut_lineage(level.groupBy(half("row"), half("col")).agg(
            F.when(s > 0, F.sum(F.col("v") * F.col("w")) / F.nullif(s, F.lit(0.0))).otherwise(F.lit(0.0)).alias("v"), F.least(F.lit(1.0), s).alias("w")))
        stack.append((level, w, h))
    top, _, _ = stack[-1]
    total = top.agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    up = top.select("row", "col", F.coalesce(total.scalar(), F.lit(0.0)).alias("v"))
    for k in range(len(stack) - 2, -1, -1):
        fine, _, _ = stack[k]
        _, cw, ch = stack[k + 1]
        corners = corner_table(up, ["v"], cw, ch).withColumnsRenamed({f"v_{c}": f"_v{c}" for c in ("00", "01", "10", "11")})
        y = F.greatest(F.lit(0.0), F.least(F.lit(ch - 1.0), (F.col("row") + 0.5) / 2 - 0.5))
        x = (F.col("col") + 0.5) / 2 - 0.5
        f = (fine.withColumn("_r0", F.floor(y).cast("int")).withColumn("_c0", F.pmod(F.floor(x), F.lit(cw)).cast("int"))
             .withColumn("_fy", y - F.floor(y)).withColumn("_fx", x - F.floor(x)))
        one = F.lit(1.0)
        blend = ((one - F.col("_fx")) * (one - F.col("_fy")) * F.col("_v00") + F.col("_fx") * (one - F.col("_fy")) * F.col("_v01")
                 + (one - F.col("_fx")) * F.col("_fy") * F.col("_v10") + F.col("_fx") * F.col("_fy") * F.col("_v11"))
        wk = F.least(one, F.col("w"))
        up = cut_lineage(f.join(corners, ["_r0", "_c0"], "left").select("row", "col", (wk * F.col("v") + (one - wk) * blend).alias("v")))
    return grid.join(up.withColumnRenamed("v", "filled"), ["row", "col"])


def gap_confidence(grid: DataFrame, width: int, cap: int = 8, value: str = "no2") -> DataFrame:
    """Grid distance (four neighbours, longitude wrapped, at most ``cap``) to the nearest observed cell and the
    confidence 1 when observed, 0.85 (1 - d / (cap + 1)) up to ``cap``, 0 beyond.

    Distance is the smallest sum of a vertical and a horizontal step, found by one window along columns and one
    along rows whose ends are repeated across the date line.
    """
    v = Window.partitionBy("col").orderBy("row")
    seen = F.when(F.col(value).isNotNull(), F.col("row"))
    up = F.col("row") - F.last(seen, ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    down = F.last(seen, ignorenulls=True).over(back) - F.col("row")
    g = grid.withColumn("_g", F.least(up, down))
    around = F.filter(F.array(F.col("col"), F.when(F.col("col") < cap, F.col("col") + width), F.when(F.col("col") >= width - cap, F.col("col") - width)), lambda x: x.isNotNull())
    ring = g.select("row", "_g", F.explode(around).alias("_x"))
    w = Window.partitionBy("row").orderBy("_x")
    west = F.min(F.col("_g") - F.col("_x")).over(w.rangeBetween(-cap, 0)) + F.col("_x")
    east = F.min(F.col("_g") + F.col("_x")).over(w.rangeBetween(0, cap)) - F.col("_x")
    d = ring.withColumn("_d", F.least(west, east)).where(F.col("_x").between(0, width - 1)).select("row", F.col("_x").alias("col"), "_d")
    dist = F.coalesce(F.least("_d", F.lit(cap + 1)), F.lit(cap + 1)).cast("int")
    return (grid.join(d, ["row", "col"]).withColumn("gap", dist).drop("_d")
            .withColumn("confidence", F.when(F.col("gap") == 0, 1.0).when(F.col("gap") > cap, 0.0).otherwise(F.lit(0.85) * (F.lit(1.0) - F.col("gap") / (cap + 1.0)))))


# --------------------------------------------------------------------------------------------- roads
def line_cells(lines: DataFrame, grids: DataFrame, step: float = 0.5) -> DataFrame:
    """Cells each line passes through, per area: ``lines(id, path)`` against every grid its box meets.

    A segment is cut where it crosses the grid's lines; the middle of each piece names its cell.  A segment and a grid
    meet once, in the first tile that both have; the number of parts is given, so that no few tasks cut what many should.
    """
    seg = (lines.select("id", F.posexplode("path").alias("i", "p"), "path").where(F.col("i") < F.size("path") - 1)
           .select("id", "i", F.col("p.lon").alias("x0"), F.col("p.lat").alias("y0"), F.get("path", F.col("i") + 1)["lon"].alias("x1"), F.get("path", F.col("i") + 1)["lat"].alias("y1")))
    tiles = lambda a, b: F.sequence(F.floor(F.least(a, b) / step).cast("long"), F.floor(F.greatest(a, b) / step).cast("long"))
    first = lambda a, b: F.floor(F.least(a, b) / step).cast("long")
    s = (seg.withColumn("_fx", first(F.col("x0"), F.col("x1"))).withColumn("_fy", first(F.col("y0"), F.col("y1")))
         .withColumn("_tx", F.explode(tiles(F.col("x0"), F.col("x1")))).withColumn("_ty", F.explode(tiles(F.col("y0"), F.col("y1")))))
    east, south = F.col("west") + F.col("width") * F.col("res"), F.col("north") - F.col("height") * F.col("res")
    g = (grids.select("area_id", "west", "north", "res", "width", "height")
         .withColumn("_gx", first(F.col("west"), east)).withColumn("_gy", first(south, F.col("north")))
         .withColumn("_tx", F.explode(tiles(F.col("west"), east))).withColumn("_ty", F.explode(tiles(south, F.col("north")))))
    once = (F.col("_tx") == F.greatest("_fx", "_gx")) & (F.col("_ty") == F.greatest("_fy", "_gy"))
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = s.join(g, ["_tx", "_ty"]).where(once).drop("_tx", "_ty", "_fx", "_fy", "_gx", "_gy").repartition(parts, "area_id", "id")
    gx = lambda x: (x - F.col("west")) / F.col("res")
    gy = lambda y: (F.col("north") - y) / F.col("res")
    j = j.withColumn("a0", gx(F.col("x0"))).withColumn("a1", gx(F.col("x1"))).withColumn("b0", gy(F.col("y0"))).withColumn("b1", gy(F.col("y1")))

    def cuts(p: str, q: str) -> Column:
        lo, hi = F.ceil(F.least(p, q)).cast("int"), F.floor(F.greatest(p, q)).cast("int")
        return F.when((hi >= lo) & (F.col(p) != F.col(q)), F.transform(F.sequence(lo, hi), lambda k: (k - F.col(p)) / (F.col(q) - F.col(p)))).otherwise(F.array().cast("array<double>"))

    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts("a0", "a1"), cuts("b0", "b1"))))
    mids = F.zip_with(F.slice(ts, F.lit(1), F.size(ts) - 1), F.slice(ts, F.lit(2), F.size(ts) - 1), lambda p, q: (p + q) / 2.0)
    m = j.withColumn("_m", F.explode(mids))
    col = F.floor(F.col("a0") + F.col("_m") * (F.col("a1") - F.col("a0"))).cast("int")
    row = F.floor(F.col("b0") + F.col("_m") * (F.col("b1") - F.col("b0"))).cast("int")
    return (m.select("area_id", "id", row.alias("row"), col.alias("col"), "width", "height")
            .where(F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1))
            .select("area_id", "id", "row", "col").distinct())


def road_density(lines: DataFrame, grids: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Class-weighted road cells, smoothed, relative to the area's 99.5th percentile and cut at 1."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.ROAD_WEIGHTS.items() for x in kv]), F.lower("highway")), F.lit(C.ROAD_WEIGHT_OTHER))
    weight = lines.select("id", w.alias("_w"))
    raw = line_cells(lines, grids).join(weight, "id").groupBy("area_id", "row", "col").agg(F.sum("_w").alias("roads"))
    spine = G.cell_spine(grids).select("area_id", "row", "col").join(raw, ["area_id", "row", "col"], "left").fillna(0.0, ["roads"])
    dens = gaussian_smooth(spine, sigma, {"roads": "_d"}, keys=("area_id",))
    peak = exact_quantiles(dens, ["area_id"], "_d", {"_p": 0.995})
    d = F.when(F.col("_p") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_d") / F.nullif("_p", F.lit(0.0))))).otherwise(F.col("_d"))
    return dens.join(peak, "area_id").select("area_id", "row", "col", "roads", d.alias("road_density"))


# --------------------------------------------------------------------------------------------- anomalies
def anomalies(cells: DataFrame, grids: DataFrame, static: DataFrame, places: DataFrame | None = None, top: int = 5,
              value: str = "no2") -> DataFrame:
    """Connected places per area and day above the daily limit (exceedance) or far above their own last week
    (spike), whether the excess is local (far above the upwind air, which must not come off open water), likely reasons, severity, and the ``top``
    by severity and excess.  ``cells`` is dense with u10, v10 and blh."""
    mean = G.day_mean(cells, value)
    full = cells.join(mean, list(DAY_KEY)).where(F.col("day_mean").isNotNull()).withColumn("_v", F.coalesce(value, "day_mean"))
    field = gaussian_smooth(full.select(*CELL_KEY, "_v"), 1.0, {"_v": "smooth"}).select(*CELL_KEY, "smooth")
    q = exact_quantiles(cells, list(DAY_KEY), value, {"_p75": 0.75, "_p90": 0.90})

    # Own recent level; pixels without any value take the area's mean of the same days.
    base = G.recent_baseline(cells.select(*CELL_KEY, value), value=value)
    days = cells.groupBy(*DAY_KEY).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy("area_id").orderBy("day")
    past = w.rowsBetween(-C.SPIKE_BASELINE_DAYS, -1)
    days = days.select(*DAY_KEY, F.when(F.row_number().over(w) > 3, F.sum("_s").over(past) / F.nullif(F.sum("_n").over(past), F.lit(0))).alias("_past"))
    base = base.join(days, list(DAY_KEY)).where(F.col("_past").isNotNull()).select(*CELL_KEY, F.coalesce("baseline", "_past").alias("_b"))
    base = gaussian_smooth(base, 1.0, {"_b": "baseline"}).select(*CELL_KEY, "baseline")

    wind = G.wind_per_day(cells)
    water = F.coalesce(F.col("ndvi") < 0.0, F.lit(False)) if "ndvi" in static.columns else F.lit(False)
    field = (field.join(static.select("area_id", "row", "col", water.cast("double").alias("_water")), ["area_id", "row", "col"], "left")
             .fillna(0.0, ["_water"]))
    field = G.upwind_value(field, wind, grids, value="smooth", also={"_water": "_upwind_water"})
    f = (field.join(q, list(DAY_KEY)).join(base, list(CELL_KEY), "left")
         .join(cells.select(*CELL_KEY, F.col(value).isNotNull().alias("_valid")), list(CELL_KEY)))
    ok = F.col("_valid") & (F.col("_water") == 0.0)
    fair = F.coalesce(F.col("_upwind_water") <= C.UPWIND_WATER_SHARE, F.lit(True))  # clean sea air is no comparison
    s = F.col("smooth")
    over = lambda c: F.coalesce(s - F.col(c) > F.greatest(F.lit(15.0), 0.5 * F.col(c)), F.lit(False))
    f = (f.withColumn("exceedance", ok & (s > C.NAAQS_24H)).withColumn("spike", ok & over("baseline") & (s > F.col("_p75")))
         .withColumn("local_source", ok & fair & over("upwind") & (s > F.col("_p90"))))
    flagged = f.where(F.col("exceedance") | F.col("spike")).select(*CELL_KEY, "smooth", "baseline", "upwind", "exceedance", "spike", "local_source")
    comp = label_components(flagged)
    peak = F.max(F.struct("smooth", (-F.col("row")).alias("nr"), (-F.col("col")).alias("nc"), "baseline", "upwind", "exceedance", "spike", "local_source")).alias("_p")
    g = comp.groupBy(*DAY_KEY, "component").agg(F.count("*").alias("cells"), peak).where(F.col("cells") >= 2)
    g = g.select(*DAY_KEY, "component", "cells", (-F.col("_p.nr")).alias("row"), (-F.col("_p.nc")).alias("col"), F.col("_p.smooth").alias("_s"),
                 F.col("_p.baseline").alias("baseline"), F.col("_p.upwind").alias("upwind"),
                 labels((F.col("_p.exceedance"), "exceedance"), (F.col("_p.spike"), "spike"), (F.col("_p.local_source"), "local_source")).alias("kinds"))

    # Weather of the day against the period, and the layers at the peak.
    blh = cells.groupBy(*DAY_KEY).agg(F.avg("blh").alias("_blh"))
    usual = exact_quantiles(blh, ["area_id"], "_blh", {"_usual": 0.5})
    weather = (wind.withColumn("_speed", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).join(blh, list(DAY_KEY)).join(usual, "area_id")
               .select(*DAY_KEY, "_speed", (F.col("_blh") < 0.8 * F.col("_usual")).alias("_low")))
    layers = smoothed_layers(static, 2.0)
    tags = source_tags(layers).select("area_id", "row", "col", "tags")
    g = g.join(weather, list(DAY_KEY)).join(tags, ["area_id", "row", "col"], "left").join(G.pixel_size(grids), "area_id")
    why = F.when(F.col("tags").isNull() | (F.element_at("tags", 1) == "background"), F.array(F.lit("unlisted"))).otherwise(F.col("tags"))
    reasons = F.concat(why, labels((F.col("_speed") < 1.5, "stagnant"), (F.coalesce("_low", F.lit(False)), "low_mixing")))
    score = F.col("_s") - F.array_min(F.array_compact(F.array(F.nullif("baseline", F.lit(0.0)), F.nullif("upwind", F.lit(0.0)), F.lit(C.NAAQS_24H))))
    g = (g.withColumn("reasons", reasons).withColumn("severity", F.when(F.array_contains("kinds", "exceedance") | (F.size("kinds") > 1), "high").otherwise("medium"))
         .withColumn("score", score).withColumn("area_km2", F.round(F.col("cells") * F.col("dx_m") * F.col("dy_m") / 1e6, 1)))
    out = rank_anomalies(g, top)
    out = G.with_centre(out, grids).withColumn("value", F.round("_s", 1)).withColumn("lat", F.round("lat", 4)).withColumn("lon", F.round("lon", 4))
    if places is not None:
        out = nearest_place(out.withColumn("point_id", F.concat_ws("|", *DAY_KEY, "rank")), places).drop("point_id", "near_km")
    return out.drop("_s", "_speed", "_low", "tags", "dx_m", "dy_m", "component")


def rank_anomalies(found: DataFrame, top: int = 5, keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """The ``top`` rows per key: high severity first, then the largest score."""
    w = Window.partitionBy(*keys).orderBy(F.col("severity") != "high", F.desc("score"), "row", "col")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


