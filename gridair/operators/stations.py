"""Monitoring-station operators: screening, daily means, quality control, neighbours, training tables, folds.

Daily tables hold at most one row per station and day, so a window over one station holds at most a calendar
of rows however many raw readings that station sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import geo, strings
from gridair.functions.quantiles import exact_quantiles, median
from gridair.operators.near import radius_mean, within_radius
from gridair.session import cut_lineage


# --------------------------------------------------------------------------------------------- screening
def filter_hours(df: DataFrame, start: int | None = 12, end: int | None = 16, ts: str = "ts") -> DataFrame:
    """Local hours in [start, end); ``None`` keeps the whole day."""
    if start is None or end is None:
        return df
    return df.where((F.hour(ts) >= start) & (F.hour(ts) < end))


def filter_faults(df: DataFrame) -> DataFrame:
    """Coordinates present and 0 <= no2 < 1000."""
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("no2") >= 0) & (F.col("no2") < 1000))


def exclude_periods(df: DataFrame, periods: DataFrame, day: str = "day") -> DataFrame:
    """Drop rows whose day lies in a closed range of ``periods(lo, hi)``.

    Ranges are unfolded to days first, which turns the range condition into an equi-join on the day.
    """
    days = (periods.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("_x"))
            .select(F.col("_x").cast("date").alias("_x")).distinct())
    return df.join(days, F.col(day) == F.col("_x"), "left_anti")


# --------------------------------------------------------------------------------------------- daily means
def hourly_mode(df: DataFrame, ts: str = "ts") -> Column:
    """Scalar: does the data set hold hourly readings (any time of day other than midnight)?"""
    return df.agg(F.max(F.hour(ts) != 0).alias("hourly")).scalar()


def station_daily(df: DataFrame, start: int | None = 12, end: int | None = 16,
                  min_completeness: float = C.MIN_COMPLETENESS) -> DataFrame:
    """One mean per station and day; hourly data needs ``min_completeness`` of the window's hours.

    Whether the data is hourly is decided once for the whole table.  Sums are partial before the shuffle.
    """
    hourly = hourly_mode(df)
    expected = (end - start) if start is not None and end is not None else 24
    windowed = (df.where(~hourly | ((F.hour("ts") >= start) & (F.hour("ts") < end)))
                if start is not None and end is not None else df)
    out = (filter_faults(windowed).groupBy("station_id", F.to_date("ts").alias("day"))
           .agg(F.min_by("lat", "ts").alias("lat"), F.min_by("lon", "ts").alias("lon"),
                F.avg("no2").alias("no2"), F.count("no2").alias("n_readings")))
    return out.where(~hourly | (F.col("n_readings") >= math.ceil(min_completeness * expected)))


# --------------------------------------------------------------------------------------------- quality control
def frozen_flag(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``frozen``: within ``tolerance`` of the station's previous row, kept or not."""
    w = Window.partitionBy("station_id").orderBy("day")
    return df.withColumn("frozen", F.coalesce(F.abs(F.col("no2") - F.lag("no2").over(w)) < tolerance, F.lit(False)))


def station_stats(df: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, median and coefficient of variation per station."""
    base = df.groupBy("station_id").agg(
        F.count("no2").alias("n"), F.avg("no2").alias("mean"), F.stddev_samp("no2").alias("std"),
        F.min_by("lat", "day").alias("lat"), F.min_by("lon", "day").alias("lon"))
    return (base.join(median(df, ["station_id"], "no2"), "station_id", "left")
            .withColumn("cv", F.col("std") / F.nullif("mean", F.lit(0.0))))


def inconsistent_pairs(stats: DataFrame, km: float = 2.0, ratio: float = 3.0) -> DataFrame:
    """Stations whose neighbour within ``km`` reads more than ``ratio`` times higher (the lower one is ``lo_id``).

    Distances use the cosine at the station with the smaller id, as both directions must agree.
    """
    pairs = within_radius(
        stats.select("station_id", "lat", "lon", "median"),
        stats.select(F.col("station_id").alias("other_id"), F.col("lat").alias("other_lat"),
                     F.col("lon").alias("other_lon"), F.col("median").alias("other_median")),
        km * 1.05, src_lat="other_lat", src_lon="other_lon",
        condition=lambda p, s: s["other_median"] > ratio * p["median"])
    first = F.col("station_id") < F.col("other_id")
    dist = F.when(first, geo.flat_km(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon"))).otherwise(
        geo.flat_km(F.col("other_lat"), F.col("other_lon"), F.col("lat"), F.col("lon")))
    return (pairs.where(F.col("station_id") != F.col("other_id")).withColumn("km", dist).where(F.col("km") <= km)
            .select(F.col("station_id").alias("lo_id"), F.col("other_id").alias("hi_id"), "km",
                    F.col("median").alias("lo_median"), F.col("other_median").alias("hi_median")))


def qc_verdicts(df: DataFrame, min_cv: float = 0.10, min_days: int = 15, low_fraction: float = 0.25,
                neighbour_km: float = 2.0, neighbour_ratio: float = 3.0) -> DataFrame:
    """One row per station with its statistics and the reason it is dropped (null = kept).

    The reasons apply in order: too few days, flat line, implausibly low, inconsistent with a neighbour.
    """
    cleaned = frozen_flag(df).where(~F.col("frozen"))
    # One row per station, read by the network median, both sides of the pair search and the result.
    stats = cut_lineage(station_stats(cleaned).withColumn(
        "reason", F.when(F.col("n") < min_days, "few_days").when(F.col("cv") < min_cv, "flat")))
    network = median(stats.where(F.col("reason").isNull()), [], "median", "network").scalar()
    stats = stats.withColumn("network_median", network).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("median") < low_fraction * F.col("network_median"), "low")))
    pairs = inconsistent_pairs(stats.where(F.col("reason").isNull()), neighbour_km, neighbour_ratio)
    lower = pairs.groupBy(F.col("lo_id").alias("station_id")).agg(F.min("hi_id").alias("inconsistent_with"))
    return (stats.join(lower, "station_id", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("inconsistent_with").isNotNull(), "neighbour"))))


def quality_control(df: DataFrame, **limits: float) -> DataFrame:
    """Daily rows that survive row and station checks."""
    keep = qc_verdicts(df, **limits).where(F.col("reason").isNull()).select("station_id")
    return frozen_flag(df).where(~F.col("frozen")).drop("frozen").join(keep, "station_id", "left_semi")


def qc_report(df: DataFrame, **limits: float) -> DataFrame:
    """One row: rows and stations in and out, frozen rows, network median and stations dropped per reason."""
    verdicts = qc_verdicts(df, **limits)
    kept = verdicts.where(F.col("reason").isNull()).select("station_id", F.lit(1).alias("kept"))
    flagged = frozen_flag(df).join(kept, "station_id", "left")
    rows = flagged.agg(
        F.count("*").alias("rows_in"), F.count_if("frozen").alias("frozen_rows"),
        F.count_if(~F.col("frozen") & F.col("kept").isNotNull()).alias("rows_out"))
    by_reason = [F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in ("few_days", "flat", "low", "neighbour")]
    stations = verdicts.agg(F.count("*").alias("stations_in"), F.count_if(F.col("reason").isNull()).alias("stations_out"),
                            F.max("network_median").alias("network_median"), *by_reason)
    return rows.withColumn("_s", stations.select(F.struct("*").alias("_s")).scalar()).select("*", "_s.*").drop("_s")


# --------------------------------------------------------------------------------------------- neighbours, medians
def neighbour_mean(obs: DataFrame, sites: DataFrame, km: float = 100.0, value: str = "no2") -> DataFrame:
    """Same-day mean of the stations strictly within ``km``, the station itself and co-located ones excluded."""
    return radius_mean(obs, sites, km, value, "neighbour_mean")


def national_day_median(df: DataFrame, value: str = "no2") -> DataFrame:
    """Network-wide median of the day and the station's own mean, joined back to the rows."""
    day = median(df, ["day"], value, "day_median")
    own = df.groupBy("station_id").agg(F.avg(value).alias("station_mean"))
    return df.join(day, "day", "left").join(own, "station_id", "left")


def station_lags(df: DataFrame, value: str = "no2") -> DataFrame:
    """Values of the previous two rows of the station."""
    w = Window.partitionBy("station_id").orderBy("day")
    return df.withColumn("lag1", F.lag(value, 1).over(w)).withColumn("lag2", F.lag(value, 2).over(w))


def mean_anomaly(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Departure from the group's own mean."""
    own = df.groupBy(*keys).agg(F.avg(value).alias("group_mean"))
    return df.join(own, keys, "left").withColumn("anomaly", F.col(value) - F.col("group_mean"))


def share_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of the group total."""
    total = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return (df.join(total, keys, "left")
            .withColumn("share", F.col(value) / F.nullif("_total", F.lit(0.0))).drop("_total"))


# --------------------------------------------------------------------------------------------- training table
def training_table(obs: DataFrame, daily: DataFrame, static: DataFrame, required: Iterable[str],
                   optional: Iterable[str] = ("co",)) -> DataFrame:
    """Observations joined with daily and static features; rows with a missing required feature are dropped."""
    out = obs.join(daily, ["station_id", "day"]).join(static, "station_id")
    skip = set(optional)
    return out.dropna(subset=[c for c in required if c in out.columns and c not in skip])


# --------------------------------------------------------------------------------------------- cities
def city_boxes(stations: DataFrame) -> DataFrame:
    """Centre, extent, number of stations and padded box per city."""
    g = (stations.withColumn("city", strings.city_of(F.col("station_name"))).groupBy("city")
         .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("lat").alias("lat_min"),
              F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
              F.count("station_name").alias("stations")))

    def half(lo: str, hi: str, mid: str) -> Column:
        spread = F.greatest(F.col(mid) - F.col(lo), F.col(hi) - F.col(mid)) + 0.06
        return F.least(F.greatest(spread, F.lit(0.15)), F.lit(0.45))

    return (g.withColumn("key", strings.spaced(F.col("city")))
            .withColumn("_hx", half("lon_min", "lon_max", "lon")).withColumn("_hy", half("lat_min", "lat_max", "lat"))
            .select("city", "key", "lat", "lon", "stations", F.round(F.col("lon") - F.col("_hx"), 3).alias("west"),
                    F.round(F.col("lat") - F.col("_hy"), 3).alias("south"),
                    F.round(F.col("lon") + F.col("_hx"), 3).alias("east"),
                    F.round(F.col("lat") + F.col("_hy"), 3).alias("north")))


def suggest_city(unknown: DataFrame, cities: DataFrame, limit: int = 8) -> DataFrame:
    """Cities whose key contains the first four letters of an unknown name, at most ``limit`` per name.

    Keys are unfolded to their distinct four-letter pieces, so that the match is an equi-join; shorter names
    are matched against pieces of their own length.
    """
    want = (unknown.select("name").distinct()
            .withColumn("_piece", F.substring(strings.city_key(F.col("name")), 1, 4)))
    n = F.length("key")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    pieces = (cities.select("city", "key").distinct().withColumn("_at", starts)
              .withColumn("_len", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))))
              .where(F.col("_at") + F.col("_len") - 1 <= n)
              .select("city", F.expr("substring(key, _at, _len)").alias("_piece")).distinct())
    # The first cities depend on the piece alone: no more than these meet the names.
    first = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("_piece").orderBy("city"))).where(F.col("rank") <= limit)
    return want.join(first, "_piece").select("name", "city", "rank")


# --------------------------------------------------------------------------------------------- validation splits
def date_blocks(df: DataFrame, n: int = 5, day: str = "day") -> DataFrame:
    """Contiguous blocks of the distinct dates, the first blocks one longer when they do not divide evenly.

    The ranking runs over distinct dates only, which are as many as the calendar has days.
    """
    return df.select(day).distinct().withColumn("date_block", F.ntile(n).over(Window.orderBy(day)) - 1)


#: Parts of the hash order in which stations are ranked.
_PARTS = 1024


def station_groups(df: DataFrame, n: int = 5) -> DataFrame:
    """Stations dealt in turn to ``n`` groups, in the order of a hash of their id: group sizes differ by one at most.

    The exact rank needs no window over all stations: the hash order is cut into ``_PARTS`` parts, a station's rank is
    its place in its part plus the sizes of the parts before it, and only these sizes are gathered.
    """
    hashed = F.md5(F.col("station_id").cast("string"))
    stations = df.select("station_id").distinct().withColumn("_h", hashed).withColumn("_part", F.shiftright(strings.hash_number(F.col("station_id")), 22))
    sizes = stations.groupBy("_part").agg(F.count("*").alias("_n")).agg(F.collect_list(F.struct("_part", "_n"))).scalar()
    before = F.aggregate(F.filter("_sizes", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_h", "station_id"))
    return stations.withColumn("_place", place).withColumn("_sizes", sizes).select("station_id", ((F.col("_place") - 1 + before) % n).cast("int").alias("station_group"))


def space_time_folds(df: DataFrame, n: int = 5) -> DataFrame:
    """Group and block of every row.  Fold (i, j) tests rows with (i, j) and trains on rows that share neither."""
    return (df.join(date_blocks(df, n), "day").join(station_groups(df, n), "station_id"))


def fold_sizes(folded: DataFrame) -> DataFrame:
    """Test and training rows of every fold.

    Training rows of fold (i, j) are all rows minus group i minus block j plus their overlap, so that counts
    per (group, block) are enough and the rows are never repeated per fold.
    """
    cell = folded.groupBy("station_group", "date_block").agg(F.count("*").alias("test_rows"))
    group = folded.groupBy("station_group").agg(F.count("*").alias("_g"))
    block = folded.groupBy("date_block").agg(F.count("*").alias("_b"))
    total = folded.agg(F.count("*")).scalar()
    return (cell.join(group, "station_group").join(block, "date_block")
            .withColumn("train_rows", total - F.col("_g") - F.col("_b") + F.col("test_rows"))
            .where((F.col("test_rows") > 0) & (F.col("train_rows") > 0)).drop("_g", "_b"))


def group_folds(df: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out folds as (group, test rows, training rows); empty with fewer than two groups."""
    sizes = df.groupBy(F.col(group).alias("test_group")).agg(F.count("*").alias("test_rows"))
    total = df.agg(F.count("*")).scalar()
    return (sizes.withColumn("train_rows", total - F.col("test_rows")).where(F.col("train_rows") > 0))


def holdout_flag(df: DataFrame, keys: list[str], fraction: float = 0.1) -> DataFrame:
    """``holdout``: a repeatable share of the rows chosen by a hash of the key."""
    h = strings.hash_number(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])) % 1000
    return df.withColumn("holdout", h < int(round(fraction * 1000)))


# --------------------------------------------------------------------------------------------- scores
def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where either side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def _scores(obs: Column, pred: Column) -> list[Column]:
    err = pred - obs
    n = F.count(err)
    ok = n >= 2
    sst = F.var_pop(F.when(err.isNotNull(), obs)) * n
    sse = F.sum(err * err)
    return [n.alias("n"),
            F.when(ok & (sst > 0), 1.0 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
            F.when(ok, F.sqrt(sse / F.nullif(n, F.lit(0)))).alias("rmse"),
            F.when(ok, F.avg(F.abs(err))).alias("mae"), F.when(ok, F.avg(err)).alias("mbe"),
            F.when(ok, pearson(obs, pred)).alias("pearson_r")]


def regression_metrics(df: DataFrame, obs: str, pred: str, by: Iterable[str] = ()) -> DataFrame:
    """n, R2, RMSE, MAE, bias and Pearson r, all in one aggregation; scores are null below two rows."""
    return df.groupBy(*by).agg(*_scores(F.col(obs), F.col(pred)))


def summarize_predictions(df: DataFrame, obs: str = "no2", pred: str = "pred", by: Iterable[str] = ()) -> DataFrame:
    """Scores of all rows, of station means, and of departures from station means, plus the median r within
    stations with more than five rows: one row per part (of each group of ``by``)."""
    by = list(by)
    rows = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())
    means = rows.groupBy(*by, "station_id").agg(F.avg(obs).alias("_mo"), F.avg(pred).alias("_mp"),
                                                F.count("*").alias("_n"), pearson(F.col(obs), F.col(pred)).alias("_r"))
    departures = (rows.join(means, [*by, "station_id"])
                  .select(*by, (F.col(obs) - F.col("_mo")).alias("o"), (F.col(pred) - F.col("_mp")).alias("p")))
    within = exact_quantiles(means.where(F.col("_n") > 5), by, "_r", {"median_within_station_r": 0.5})

    def part(name: str, table: DataFrame, o: str, p: str) -> DataFrame:
        return regression_metrics(table, o, p, by).withColumn("part", F.lit(name))

    parts = (part("overall", rows, obs, pred).unionByName(part("station_mean_spatial", means, "_mo", "_mp"))
             .unionByName(part("temporal_anomaly", departures, "o", "p")))
    return parts.join(within, by, "left") if by else parts.withColumn("median_within_station_r", within.scalar())


def select_model(metrics: DataFrame) -> DataFrame:
    """Name and RMSE of the best selectable candidate."""
    return (metrics.where(F.col("selectable")).agg(F.min_by("model", "rmse").alias("selected"),
                                                   F.min("rmse").alias("rmse")))


def trend_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope, its t statistic and direction (|t| > 2) per group, from one aggregation."""
    g = df.groupBy(*keys).agg(F.regr_sxx(y, x).alias("_sxx"),
                              F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
                              F.regr_count(y, x).alias("n"))
    g = g.withColumn("slope", F.col("_sxy") / F.nullif("_sxx", F.lit(0.0)))
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("slope"))
    se = F.sqrt(rss / F.greatest(F.col("n") - 2, F.lit(1)) / F.nullif("_sxx", F.lit(0.0)))
    t = F.when(se > 0, F.col("slope") / F.nullif(se, F.lit(0.0))).otherwise(F.lit(0.0))
    return (g.withColumn("t", t).withColumn(
        "direction", F.when(F.abs("t") <= 2.0, "stable").when(F.col("slope") > 0, "rising").otherwise("falling"))
        .select(*keys, "n", "slope", "t", "direction"))
