"""Gridded cells: grids, spines, lookups, resampling, day and pixel statistics, windows over time and space.

A pixel holds at most one row per day and a grid line at most ``width`` (or ``height``) cells of a day; every
window below is over one of the two.  Statistics over a whole day, area or pixel are grouped aggregates joined
back, so that their first stage is partial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import geo, units
from gridair.functions.quantiles import median
from gridair.schemas import CELL_KEY, DAY_KEY, PIXEL_KEY


# --------------------------------------------------------------------------------------------- grids
def make_grid(boxes: DataFrame, res: float) -> DataFrame:
    """Grids from ``boxes(area_id, west, south, east, north)``; an inverted box raises."""
    bad = (F.col("east") <= F.col("west")) | (F.col("north") <= F.col("south"))
    size = lambda hi, lo: F.greatest(F.lit(1), F.ceil(F.round((F.col(hi) - F.col(lo)) / res, 9)).cast("int"))
    return boxes.select(
        "area_id", F.when(bad, F.raise_error(F.lit("invalid bbox"))).otherwise(F.col("west")).alias("west"), "north",
        F.lit(res).alias("res"), size("east", "west").alias("width"), size("north", "south").alias("height"))


def refine(grids: DataFrame, factor: int) -> DataFrame:
    return grids.select("area_id", "west", "north", (F.col("res") / factor).alias("res"),
                        (F.col("width") * factor).alias("width"), (F.col("height") * factor).alias("height"))


def cell_spine(grids: DataFrame) -> DataFrame:
    """Every cell of every grid with its centre."""
    return (grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
            .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
            .select("area_id", "row", "col", geo.cell_lat(F.col("north"), F.col("res"), F.col("row")).alias("lat"),
                    geo.cell_lon(F.col("west"), F.col("res"), F.col("col")).alias("lon")))


def pixel_size(grids: DataFrame) -> DataFrame:
    """Cell width and height in metres per grid."""
    return grids.select("area_id", geo.pixel_dx_m(F.col("west"), F.col("north"), F.col("res"), F.col("height")).alias("dx_m"),
                        geo.pixel_dy_m(F.col("res")).alias("dy_m"))


def with_centre(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells with centre coordinates."""
    return (cells.join(grids.select("area_id", "west", "north", "res"), "area_id")
            .withColumn("lat", geo.cell_lat(F.col("north"), F.col("res"), F.col("row")))
            .withColumn("lon", geo.cell_lon(F.col("west"), F.col("res"), F.col("col"))).drop("west", "north", "res"))


def to_cell(points: DataFrame, grids: DataFrame) -> DataFrame:
    """Row and column of the cell holding each point of its area, and whether it lies inside the grid."""
    g = points.join(grids.select("area_id", "west", "north", "res", "width", "height"), "area_id")
    col = F.floor((F.col("lon") - F.col("west")) / F.col("res")).cast("int")
    row = F.floor((F.col("north") - F.col("lat")) / F.col("res")).cast("int")
    return (g.withColumn("row", row).withColumn("col", col)
            .withColumn("inside", F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1))
            .drop("west", "north", "res", "width", "height"))


def sample_at_stations(cells: DataFrame, stations: DataFrame, grids: DataFrame, value: str = "no2") -> DataFrame:
    """Station rows with the value of their cell on their day as ``predicted``; others are dropped."""
    at = to_cell(stations, grids).where("inside").drop("inside")
    return at.join(cells.where(F.col(value).isNotNull()).select(*CELL_KEY, F.col(value).alias("predicted")), list(CELL_KEY))


# --------------------------------------------------------------------------------------------- ingest clean-up
def check_one_row_per_cell(cells: DataFrame) -> DataFrame:
    """Cells as they are; a repeated (area, day, cell) raises when the result is used."""
    n = F.count("*")
    others = [c for c in cells.columns if c not in CELL_KEY]
    return (cells.groupBy(*CELL_KEY).agg(*[F.any_value(c).alias(c) for c in others], n.alias("_n"))
            .withColumn("day", F.when(F.col("_n") > 1, F.raise_error(F.lit("two values for one cell and day")))
                        .otherwise(F.col("day"))).drop("_n"))


def area_span(cells: DataFrame) -> DataFrame:
    """First and last day and number of days present per area."""
    return cells.groupBy("area_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                        F.count_distinct("day").alias("days"))


def normalise_units(cells: DataFrame, value: str = "no2", tag: str | None = None) -> DataFrame:
    """mol/m2 -> umol/m2 per area: tagged so, or untagged with a median magnitude below 0.01."""
    m = median(cells.select("area_id", F.abs(value).alias("_abs")), ["area_id"], "_abs", "_m")
    small = F.coalesce(F.col("_m") < 0.01, F.lit(False))
    if tag:
        low = F.lower(F.coalesce(F.col(tag), F.lit("")))
        in_mol = ~low.contains("umol") & (low.contains("mol") | small)
    else:
        in_mol = small
    scaled = F.when(in_mol, F.col(value) * C.COLUMN_SCALE).otherwise(F.col(value))
    return cells.join(m, "area_id", "left").withColumn(value, scaled).drop("_m")


def day_spine(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Every cell of every grid on every day between the area's first and last day."""
    days = (cells.groupBy("area_id").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
            .select("area_id", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("day"))
            .withColumn("day", F.col("day").cast("date")))
    return days.join(cell_spine(grids).select("area_id", "row", "col"), "area_id")


def densify_days(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells on the full spine: what is missing becomes a row with null values."""
    return day_spine(cells, grids).join(cells, list(CELL_KEY), "left")


def screen_clouds(df: DataFrame, value: str = "no2") -> DataFrame:
    """Null where the retrieval fails the quality value, or the cloud fraction when there is no quality value."""
    if "qa_value" in df.columns:
        keep = F.col("qa_value") > C.QA_THRESHOLD
    else:
        keep = F.col("cloud_fraction") < C.MAX_CLOUD_FRACTION
    return df.withColumn(value, F.when(keep, F.col(value)))


def screen(df: DataFrame, mask, value: str = "no2") -> DataFrame:
    """Screening by a caller's rule: ``mask`` maps the DataFrame to a boolean column."""
    return df.withColumn(value, F.when(mask(df), F.col(value)))


def fill_day_mean(cells: DataFrame, default: float = 45.0, value: str = "no2") -> DataFrame:
    """Missing cells take the day's mean, an all-missing day takes ``default``."""
    mean = cells.groupBy(*DAY_KEY).agg(F.avg(value).alias("_mean"))
    return (cells.join(mean, list(DAY_KEY), "left")
            .withColumn(value, F.coalesce(F.col(value), F.col("_mean"), F.lit(default))).drop("_mean"))


# --------------------------------------------------------------------------------------------- statistics
def day_coverage(cells: DataFrame, value: str = "no2", minimum: float = C.MIN_DAY_COVERAGE) -> DataFrame:
    """Clear share of each day and whether the model (or the fallback) fills it."""
    cov = F.avg(F.col(value).isNotNull().cast("double"))
    return cells.groupBy(*DAY_KEY).agg(cov.alias("coverage")).withColumn(
        "method", F.when(F.col("coverage") >= minimum, "model").otherwise("fallback"))


def climatology(cells: DataFrame, value: str = "no2") -> DataFrame:
    """Mean of the clear values per pixel."""
    return cells.groupBy(*PIXEL_KEY).agg(F.avg(value).alias("climatology"))


def day_mean(cells: DataFrame, value: str = "no2") -> DataFrame:
    return cells.groupBy(*DAY_KEY).agg(F.avg(value).alias("day_mean"))


def column_stats(raw: DataFrame, filled: DataFrame, value: str = "no2") -> DataFrame:
    """Clear mean and maximum, cloud share and mean after filling per day."""
    a = raw.groupBy(*DAY_KEY).agg(F.avg(value).alias("observed_mean"), F.max(value).alias("observed_max"),
                                  F.avg(F.col(value).isNull().cast("double")).alias("cloud_share"))
    b = filled.groupBy(*DAY_KEY).agg(F.avg(value).alias("filled_mean"))
    return a.join(b, list(DAY_KEY), "left")


def available_dates(cells: DataFrame) -> DataFrame:
    """Sorted distinct days and their number per area (a calendar bounds the list)."""
    days = cells.select("area_id", "day").distinct()
    return days.groupBy("area_id").agg(F.sort_array(F.collect_list("day")).alias("days"), F.count("*").alias("n"))


def median_composite(scenes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median over the scenes of a cell."""
    return median(scenes, keys, value, value)


# --------------------------------------------------------------------------------------------- resampling
def block_mean(fine: DataFrame, factor: int, value: str = "no2", keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Null-aware mean over ``factor`` x ``factor`` blocks."""
    up = lambda c: F.floor(F.col(c) / F.lit(float(factor))).cast("int").alias(c)
    return fine.groupBy(*keys, up("row"), up("col")).agg(F.avg(value).alias(value))


def coarsen_valid(bins: DataFrame, factor: int, minimum: float = C.MIN_VALID_SUBPIXEL, value: str = "no2",
                  keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Block mean kept only where at least ``minimum`` of the block's bins are valid."""
    up = lambda c: F.floor(F.col(c) / F.lit(float(factor))).cast("int").alias(c)
    g = bins.groupBy(*keys, up("row"), up("col")).agg(
        F.avg(value).alias("_m"), F.avg(F.col(value).isNotNull().cast("double")).alias("valid_fraction"))
    return g.withColumn(value, F.when(F.col("valid_fraction") >= minimum, F.col("_m"))).drop("_m")


def upsample_repeat(coarse: DataFrame, factor: int, columns: list[str], keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Every coarse value repeated over its ``factor`` x ``factor`` fine cells (no join)."""
    sub = F.sequence(F.lit(0), F.lit(factor - 1))
    return (coarse.withColumn("_j", F.explode(sub)).withColumn("_i", F.explode(sub))
            .select(*keys, (F.col("row") * factor + F.col("_j")).alias("row"),
                    (F.col("col") * factor + F.col("_i")).alias("col"), *columns))


def _line(keys: tuple[str, ...], along: str) -> Window:
    across = "row" if along == "col" else "col"
    return Window.partitionBy(*keys, across).orderBy(along)


def surroundings(coarse: DataFrame, columns: list[str], keys: tuple[str, ...] = DAY_KEY, also: list[str] | None = None) -> DataFrame:
    """Each cell with structs of ``columns`` around it: ``_line`` of its own line, ``_u`` and ``_d`` of those above and below.

    The fields of a line are the neighbours ``_l`` and ``_r`` and the middle ``_c``; edges are held.  Both windows along grid lines lie
    within a key, so that rows are dealt out by the keys once.  Their number of parts is given: a row with all around it is
    wide, so that few tasks would sort what many should.  ``also`` names columns taken along.
    """
    here = F.struct(*[F.col(c).alias(c) for c in columns])
    w, v = _line(keys, "col"), _line(keys, "row")
    parts = int(coarse.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = coarse.select(*keys, "row", "col", here.alias("_c"), *(also or [])).repartition(parts, *keys)

    def beside(take, by: Window, at: str, what: str) -> Column:
        """The neighbour's ``what``; its own at the end of the line, nothing where the neighbour is not the next cell."""
        return F.when(take(at).over(by).isNull(), F.col(what)).when(F.abs(take(at).over(by) - F.col(at)) == 1, take(what).over(by))
    c = (c.withColumn("_l", beside(F.lag, w, "col", "_c")).withColumn("_r", beside(F.lead, w, "col", "_c"))
         .withColumn("_line", F.struct("_l", "_c", "_r")).drop("_l", "_c", "_r"))
    return c.withColumn("_u", beside(F.lag, v, "row", "_line")).withColumn("_d", beside(F.lead, v, "row", "_line"))


def offsets(factor: int) -> Column:
    """Offset of each of ``factor`` fine centres from the coarse centre, in coarse cells: its number, whether it lies before, how far."""
    steps = []
    for k in range(factor):
        o = (k + 0.5) / factor - 0.5
        steps.append(F.struct(F.lit(k).alias("k"), F.lit(o < 0).alias("back"), F.lit(abs(o)).alias("w")))
    return F.array(*steps)


def bilinear(name: str, j: Column, i: Column) -> Column:
    """Value of ``name`` at the offsets ``j`` (rows) and ``i`` (columns) of a cell with its ``surroundings``."""
    def across(line: str) -> Column:
        side = F.when(i["back"], F.col(f"{line}._l.{name}")).otherwise(F.col(f"{line}._r.{name}"))
        return F.col(f"{line}._c.{name}") * (F.lit(1.0) - i["w"]) + side * i["w"]
    side = F.when(j["back"], across("_u")).otherwise(across("_d"))
    return across("_line") * (F.lit(1.0) - j["w"]) + side * j["w"]


def upsample_bilinear(coarse: DataFrame, factor: int, columns: list[str], keys: tuple[str, ...] = DAY_KEY, repeat: list[str] | None = None) -> DataFrame:
    """Bilinear values on the nested fine grid, edges held constant; the columns ``repeat`` are repeated as they are.

    Each coarse cell first receives its 3 x 3 neighbourhood from two windows along grid lines; the fine cells
    are then unfolded from it with fixed weights, so the four corners need no joins.  A missing corner makes
    the fine value missing, and so does a cell that ``coarse`` lacks between two others of its line; a line ends at the
    last cell it has.
    """
    again, sub = repeat or [], offsets(factor)
    fine = surroundings(coarse, columns, keys, again).withColumn("_j", F.explode(sub)).withColumn("_i", F.explode(sub))
    return fine.select(*keys, (F.col("row") * factor + F.col("_j.k")).alias("row"), (F.col("col") * factor + F.col("_i.k")).alias("col"),
                       *[bilinear(name, F.col("_j"), F.col("_i")).alias(name) for name in columns], *again)


# --------------------------------------------------------------------------------------------- windows over time
def _pixel_days() -> Window:
    return Window.partitionBy(*PIXEL_KEY).orderBy("day")


def pixel_lags(dense: DataFrame, value: str = "no2") -> DataFrame:
    """Values one and two days before; ``dense`` has every day."""
    w = _pixel_days()
    return dense.withColumn("lag1", F.lag(value, 1).over(w)).withColumn("lag2", F.lag(value, 2).over(w))


def median_mosaic(dense: DataFrame, windows: tuple[int, ...] = C.MOSAIC_WINDOWS, value: str = "no2") -> DataFrame:
    """``mosaic``: centred rolling median of clear values, the first of the widening windows that holds any.

    Each row gathers the clear days of the widest window once; a wider middle part is looked at only where the narrower
    one is empty.
    """
    w, reach = _pixel_days(), max(windows) // 2
    clear = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).cast("double").alias("v")))
    near = dense.withColumn("_at", F.row_number().over(w)).withColumn("_near", F.collect_list(clear).over(w.rowsBetween(-reach, reach)))

    def middle(n: int) -> Column:
        own = F.filter("_near", lambda t: F.abs(t["at"] - F.col("_at")) <= n // 2)
        values = F.array_sort(F.transform(own, lambda t: t["v"]))
        half = lambda a, k: F.get(a, F.floor((F.size(a) - k) / 2).cast("int")) * 0.5
        return F.get(F.transform(F.array(values), lambda a: half(a, 1) + half(a, 0)), 0)
    return near.withColumn("mosaic", F.coalesce(*[middle(n) for n in windows])).drop("_at", "_near")


def recent_baseline(dense: DataFrame, days: int = C.SPIKE_BASELINE_DAYS, value: str = "no2", need: int = 3) -> DataFrame:
    """``baseline``: median of the previous days, from the fourth day of the period on."""
    w = _pixel_days()
    return dense.withColumn("baseline", F.when(F.row_number().over(w) > need,
                                               F.percentile(value, 0.5).over(w.rowsBetween(-days, -1))))


def interpolate_linear(dense: DataFrame, value: str = "no2", keys: tuple[str, ...] = PIXEL_KEY) -> DataFrame:
    """Missing days by linear interpolation in time, both ends held constant."""
    w = Window.partitionBy(*keys).orderBy("day")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("day").alias("d"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.last(known, ignorenulls=True).over(back)
    out = dense.withColumn("_b", before).withColumn("_a", after)
    span = F.datediff("_a.d", "_b.d")
    part = F.datediff("day", "_b.d") / F.nullif(span, F.lit(0))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * part
    return out.withColumn(value, F.coalesce(F.col(value), line, F.col("_b.v"), F.col("_a.v"))).drop("_a", "_b")


# --------------------------------------------------------------------------------------------- windows over space
def neighbourhood_mean(dense: DataFrame, size: int, name: str, value: str = "no2", centre: bool = False,
                       keys: tuple[str, ...] = DAY_KEY) -> DataFrame:
    """Null-aware mean of the ``size`` x ``size`` surroundings: sums along columns, then along rows."""
    half = size // 2
    w, v = (_line(keys, a).rangeBetween(-half, half) for a in ("col", "row"))
    out = (dense.withColumn("_s", F.sum(value).over(w)).withColumn("_n", F.count(value).over(w))
           .withColumn("_s", F.sum("_s").over(v)).withColumn("_n", F.sum("_n").over(v)))
    if not centre:
        out = (out.withColumn("_s", F.col("_s") - F.coalesce(F.col(value), F.lit(0.0)))
               .withColumn("_n", F.col("_n") - F.col(value).isNotNull().cast("int")))
    return out.withColumn(name, F.when(F.col("_n") > 0, F.col("_s") / F.nullif("_n", F.lit(0)))).drop("_s", "_n")


def gradient(cells: DataFrame, value: str, keys: tuple[str, ...] = ("area_id",), dx: float | str = 1.0,
             dy: float | str = 1.0) -> DataFrame:
    """Central differences (one-sided at edges) per cell along columns (``gx``) and rows (``gy``) and the slope."""
    def diff(along: str, step) -> Column:
        w = _line(keys, along)
        # Only the cell next to this one is a neighbour: at a hole the difference is one-sided, as at an edge.
        back = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(value).over(w))
        ahead = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(value).over(w))
        size = F.col(step) if isinstance(step, str) else F.lit(float(step))
        return (F.when(back.isNull(), ahead - F.col(value)).when(ahead.isNull(), F.col(value) - back)
                .otherwise((ahead - back) / 2.0)) / size
    out = cells.withColumn("gx", diff("col", dx)).withColumn("gy", diff("row", dy))
    return out.withColumn("slope", F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))


def terrain_wind(cells: DataFrame, elevation: str = "elevation", keys: tuple[str, ...] = ("area_id",)) -> DataFrame:
    """Wind slowed on slopes and turned along ridges; ``cells`` carry u10, v10, dx_m, dy_m.

    The slope (degrees, at most 60) sets the drag, the gradient's size the share of the wind that follows the
    ridge line.
    """
    g = gradient(cells, elevation, keys, "dx_m", "dy_m")
    norm = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) + 1e-6
    g = (g.withColumn("_n", norm).withColumn("_tx", -F.col("gy") / F.col("_n")).withColumn("_ty", F.col("gx") / F.col("_n"))
         .withColumn("drag", units.clip(F.lit(1.0) - 0.4 * F.sin(F.least(F.col("slope"), F.radians(F.lit(60.0)))), 0.2, 1.0))
         .withColumn("deflection", units.clip(F.col("_n") * 0.1, 0.0, 0.3))
         .withColumn("_dot", (F.col("u10") * F.col("_tx") + F.col("v10") * F.col("_ty")) * F.col("drag")))
    turned = lambda c, t: ((F.lit(1.0) - F.col("deflection")) * F.col(c) * F.col("drag")
                           + F.col("deflection") * F.col("_dot") * F.col(t))
    return (g.withColumn("u_terrain", turned("u10", "_tx")).withColumn("v_terrain", turned("v10", "_ty"))
            .drop("_n", "_tx", "_ty", "_dot"))


def wind_per_day(cells: DataFrame) -> DataFrame:
    """Mean wind of each area and day."""
    return cells.groupBy(*DAY_KEY).agg(F.avg("u10").alias("u"), F.avg("v10").alias("v"))


def upwind_value(cells: DataFrame, wind: DataFrame, grids: DataFrame, km: float = C.UPWIND_KM, value: str = "no2",
                 name: str = "upwind", also: dict[str, str] | None = None) -> DataFrame:
    """The field's value ``km`` against the day's wind (bilinear, edges held); null when the wind is below 1 m/s.

    Source positions are shifted by a constant per day, so that every cell looks up its four corners by key.  ``also``
    names further columns to take from there with the same look-up (column to new name).
    """
    wanted = {value: name, **(also or {})}
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    g = grids.join(pixel_size(grids), "area_id")
    shift = (wind.join(g, "area_id").withColumn("_speed", speed).where(F.col("_speed") > 1.0)
             .select(*DAY_KEY, "width", "height",
                     (F.lit(km * 1000.0) / F.col("dx_m") * F.col("u") / F.col("_speed")).alias("_cx"),
                     (F.lit(km * 1000.0) / F.col("dy_m") * F.col("v") / F.col("_speed")).alias("_cy")))
    at = (cells.join(shift, list(DAY_KEY))
          .withColumn("_y", F.greatest(F.lit(0.0), F.least(F.col("height") - 1.0, F.col("row") + F.col("_cy"))))
          .withColumn("_x", F.greatest(F.lit(0.0), F.least(F.col("width") - 1.0, F.col("col") - F.col("_cx"))))
          .withColumn("_y0", F.floor("_y").cast("int")).withColumn("_x0", F.floor("_x").cast("int"))
          .withColumn("_fy", F.col("_y") - F.col("_y0")).withColumn("_fx", F.col("_x") - F.col("_x0")))
    y1, x1 = F.least(F.col("_y0") + 1, F.col("height") - 1), F.least(F.col("_x0") + 1, F.col("width") - 1)
    one = F.lit(1.0)
    corner = lambda y, x, w: F.struct(y.alias("y"), x.alias("x"), w.alias("w"))
    corners = F.array(
        corner(F.col("_y0"), F.col("_x0"), (one - F.col("_fy")) * (one - F.col("_fx"))),
        corner(F.col("_y0"), x1, (one - F.col("_fy")) * F.col("_fx")),
        corner(y1, F.col("_x0"), F.col("_fy") * (one - F.col("_fx"))), corner(y1, x1, F.col("_fy") * F.col("_fx")))
    looked = (at.select(*CELL_KEY, F.explode(corners).alias("_k"))
              .select(*CELL_KEY, F.col("_k.y").alias("_sr"), F.col("_k.x").alias("_sc"), F.col("_k.w").alias("_w"))
              .join(cells.select(*DAY_KEY, F.col("row").alias("_sr"), F.col("col").alias("_sc"), *[F.col(c).alias(f"_v_{c}") for c in wanted]),
                    [*DAY_KEY, "_sr", "_sc"])
              .groupBy(*CELL_KEY).agg(*[F.when(F.count(f"_v_{c}") == 4, F.sum(F.col("_w") * F.col(f"_v_{c}"))).alias(n) for c, n in wanted.items()]))
    return cells.join(looked, list(CELL_KEY), "left")


def blend_days(cells: DataFrame, fraction: Column, value: str = "no2") -> DataFrame:
    """Value between day d and d + 1 at ``fraction`` of the day, eased by smoothstep; without a next day, day d."""
    nxt = cells.select("area_id", F.date_sub("day", 1).alias("day"), "row", "col", F.col(value).alias("_next"))
    w = units.smoothstep(fraction)
    out = cells.join(nxt, list(CELL_KEY), "left")
    return out.withColumn("blended", F.coalesce(F.col(value) * (F.lit(1.0) - w) + F.col("_next") * w, F.col(value))).drop("_next")


def tile_patches(cells: DataFrame, grids: DataFrame, size: int = 64, stride: int = 32) -> DataFrame:
    """Every patch (origins every ``stride`` cells, wholly inside the grid) that covers each cell."""
    g = cells.join(grids.select("area_id", "width", "height"), "area_id")

    def origins(pos: str, extent: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(pos) - (size - 1)) / F.lit(float(stride))).cast("int"))
        last = F.least(F.floor(F.col(pos) / F.lit(float(stride))), F.floor((F.col(extent) - size) / F.lit(float(stride)))).cast("int")
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * stride)).otherwise(
            F.array().cast("array<int>"))

    return (g.withColumn("patch_row", F.explode(origins("row", "height")))
            .withColumn("patch_col", F.explode(origins("col", "width"))).drop("width", "height"))
