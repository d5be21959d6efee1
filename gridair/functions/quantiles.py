"""Exact grouped quantiles that never hold a whole group in one task.

``percentile`` keeps every distinct value of a group in one buffer, which a group with a third of all rows
does not survive.  Here equal values are counted first (partial aggregation on group and value), a small
histogram over value slices locates the slice that holds each wanted rank, a second one cuts the located slices into
parts, as many as the root of their different values, and only the located parts are ranked.  Slices follow log1p of
the magnitude, so that their number per group is bounded whatever the data; parts are equally wide between the least
and the largest value of their slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES_PER_E = 256.0


def _slice(v: Column) -> Column:
    """Monotone slice number of a value."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * SLICES_PER_E).cast("int")


def _part(v: Column, lo: Column, hi: Column, parts: Column) -> Column:
    """Monotone part number of a value between the ends of its slice."""
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * parts), parts - 1)).otherwise(0).cast("long")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (linear interpolation, nulls and NaN ignored)."""
    key_cols = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    counts = (src.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .groupBy(*key_cols, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
              .withColumn("_s", _slice(F.col("_v"))))
    hist = counts.groupBy(*key_cols, "_s").agg(F.sum("_n").alias("_sn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                               F.ceil(F.sqrt(F.count("_v"))).alias("_parts"))
    running = Window.partitionBy(*key_cols).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key_cols)
    hist = (hist.withColumn("_end", F.sum("_sn").over(running)).withColumn("_total", F.sum("_sn").over(whole))
            .withColumn("_start", F.col("_end") - F.col("_sn")))
    # Ranks are zero based; both neighbours of every fractional rank are wanted.  A slice carries the ranks that
    # fall into it, so that slices without any never meet the values.
    ranks = [((F.col("_total") - 1) * F.lit(float(p)), name) for name, p in probs.items()]
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), side(rank).alias("r"), (rank - F.floor(rank)).alias("frac"), F.lit(k).alias("side"))
                       for rank, name in ranks for k, side in ((0, F.floor), (1, F.ceil))])

    def holding(ranks: Column) -> Column:
        return F.filter(ranks, lambda t: (t["r"] >= F.col("_start")) & (t["r"] < F.col("_end")))
    slices = hist.withColumn("_w", holding(wanted)).where(F.size("_w") > 0).select(*key_cols, "_s", "_start", "_lo", "_hi", "_parts", "_w")
    inside = counts.join(slices, [*key_cols, "_s"]).withColumn("_part", _part(F.col("_v"), F.col("_lo"), F.col("_hi"), F.col("_parts")))
    parts = inside.groupBy(*key_cols, "_s", "_part").agg(F.sum("_n").alias("_pn"), F.first("_start").alias("_from"), F.first("_w").alias("_ranks"))
    along = Window.partitionBy(*key_cols, "_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = (parts.withColumn("_end", F.col("_from") + F.sum("_pn").over(along)).withColumn("_start", F.col("_end") - F.col("_pn"))
             .withColumn("_w", holding(F.col("_ranks"))).where(F.size("_w") > 0).select(*key_cols, "_s", "_part", "_start", "_w"))
    in_part = Window.partitionBy(*key_cols, "_s", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (inside.drop("_start", "_w").join(parts, [*key_cols, "_s", "_part"])
            .withColumn("_top", F.col("_start") + F.sum("_n").over(in_part))
            .withColumn("_t", F.explode("_w")).where((F.col("_t.r") >= F.col("_top") - F.col("_n")) & (F.col("_t.r") < F.col("_top")))
            .select(*key_cols, "_v", "_t.name", "_t.frac", "_t.side"))
    outs = []
    for name in probs:
        pick = lambda k, c: F.max(F.when((F.col("name") == name) & (F.col("side") == k), F.col(c)))  # noqa: B023, E731
        outs.append((pick(0, "_v") + (pick(1, "_v") - pick(0, "_v")) * pick(0, "frac")).alias(name))
    out = hits.groupBy(*key_cols).agg(*outs)
    return out if keys else out.drop("_all")


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})
