"""Streams of readings, observations, messages and runs.

Late data: every job sets a watermark (two hours by default); rows behind it are dropped by Spark and counted in
the progress of the query (``dropped_rows``).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gridair import constants as C
from gridair.functions import bands
from gridair.operators.stations import filter_faults
from gridair.session import ensure_checkpoint_dir

WATERMARK = "2 hours"


# --------------------------------------------------------------------------------------------- jobs
def haze_windows(readings: DataFrame, watermark: str = WATERMARK, by: tuple[str, ...] = ()) -> DataFrame:
    """Latest reading, count, mean and maximum of the last 72 hours, every hour, of each group of ``by`` (append mode).

    Readings are folded to hours first; only the hourly rows enter the 72 overlapping windows.
    """
    x = F.col("haze_index")
    hourly = (readings.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour"), *by)
              .agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.max(x).alias("m"), F.max(F.struct("ts", "haze_index")).alias("l")))
    w = hourly.groupBy(F.window(F.window_time("window"), "72 hours", "1 hour"), *by).agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.max("m").alias("max"), F.max("l").alias("l"))
    return w.select(*by, F.col("window.end").alias("window_end"), F.col("l.ts").alias("latest_ts"), F.col("l.haze_index").alias("latest_index"),
                    bands.haze_class(F.col("l.haze_index")).alias("latest_class"), "n", F.round("mean", 3).alias("mean"), F.round("max", 3).alias("max"))


def latest_cells(observations: DataFrame, granule: list[str] | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Newest cloud-free observation per cell and how many there were (update or complete mode).

    State is one row per cell, and late granules cannot replace newer values.  ``granule`` names the columns that
    identify an observation sent twice; those are remembered until the watermark has passed them.
    """
    clear = observations.where(F.col("no2").isNotNull() & (F.col("cloud_fraction") < C.MAX_CLOUD_FRACTION)).withWatermark("ts", watermark)
    if granule:
        clear = clear.dropDuplicatesWithinWatermark(granule)
    best = clear.groupBy("row", "col").agg(F.max(F.struct("ts", "no2", "u", "v")).alias("b"), F.count("*").alias("n"))
    return best.select("row", "col", F.col("b.ts").alias("ts"), F.col("b.no2").alias("no2"), F.col("b.u").alias("u"), F.col("b.v").alias("v"), "n")


def daily_means(readings: DataFrame, start: int = 12, end: int = 16, min_completeness: float = C.MIN_COMPLETENESS,
                watermark: str = WATERMARK) -> DataFrame:
    """Station-day means of the overpass window with their completeness, once the day is over (append mode)."""
    inside = filter_faults(readings.where((F.hour("ts") >= start) & (F.hour("ts") < end)))
    g = (inside.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "station_id")
         .agg(F.avg("no2").alias("no2"), F.count("no2").alias("n_readings")))
    return (g.where(F.col("n_readings") >= math.ceil(min_completeness * (end - start)))
            .select("station_id", F.to_date("window.start").alias("day"), "no2", "n_readings"))


def session_windows(messages: DataFrame, gap: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Sessions separated by an idle hour: first and last message and number of turns (append mode)."""
    g = messages.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"))
    return g.select("conv_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "turns", "last_turn")


# --------------------------------------------------------------------------------------------- progress
def dropped_rows(query: StreamingQuery) -> int:
    """Rows the query has dropped as too late in the last hundred batches, whose progress Spark holds (``late.DropCounter`` keeps all)."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


# --------------------------------------------------------------------------------------------- running over files
def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession, provider: str | None, parts: int | None = None) -> Iterator[None]:
    """Streams started inside keep their state in ``provider`` and in ``parts`` partitions (the session's own if None).

    Every batch loads and commits each partition's state, however few rows it has; a stream of many small batches takes
    about as many as there are cores.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": provider, "spark.sql.shuffle.partitions": parts and str(parts)}
    before = {k: spark.conf.get(k, None) for k, v in wanted.items() if v}
    for k in before:
        spark.conf.set(k, wanted[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def run_available(stream: DataFrame, name: str, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Process what is available and return the written table: all rows in append and update mode, the last
    result in complete mode.  ``provider`` is the state store's class if not the session's."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(out)

    with state_store(spark, provider):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
    schema = stream.withColumn("version", F.lit(0)).schema
    df = spark.read.schema(schema).parquet(out)
    if mode == "complete":
        df = df.where(F.col("version") == df.agg(F.max("version")).scalar())
    return df.drop("version")
