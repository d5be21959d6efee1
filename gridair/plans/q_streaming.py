"""Streams over the event file, each beside the SQL of its table twin.

Append results hold the windows that the watermark (two hours behind the newest event) has closed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridair.adapters import ADAPTERS, Tables
from gridair.plans.registry import query
from gridair.streaming import jobs as J
from gridair.streaming.late import DropCounter, keep_in_time, set_aside
from gridair.streaming.refresh import Refreshed, with_staleness
from gridair.streaming.sessions import ROCKSDB, session_histories


def event_stream(t: Tables, adapter: str | None = None, table: str = "events"):
    """One source file read as a stream, shaped by the text of a domain table."""
    src = (t.spark.readStream.schema(t.table(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder))
    # Watermarks need an instant; the files hold local times without a zone.
    out = src if adapter is None else t.spark.sql(ADAPTERS[adapter], **{table: src})
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def local(df, *names: str):
    """Instants back as local times."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("str_01_haze_windows", """
WITH h AS (SELECT date_trunc('hour', ts) AS hr, count(*) AS n, sum(haze_index) AS s, max(haze_index) AS m, max(ts) AS lt, arg_max(haze_index, ts) AS li FROM haze GROUP BY 1),
w AS (SELECT hr + INTERVAL 1 HOUR + k * INTERVAL 1 HOUR AS window_end, h.* FROM h, (SELECT unnest(range(72)) AS k) z),
g AS (SELECT window_end, max(lt) AS latest_ts, arg_max(li, lt) AS latest_index, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 3) AS mean, round(max(m), 3) AS max FROM w GROUP BY 1)
SELECT window_end, latest_ts, latest_index, CASE WHEN latest_index < 0.3 THEN 'clear' WHEN latest_index < 0.45 THEN 'light' WHEN latest_index < 0.6 THEN 'moderate' ELSE 'dense' END AS latest_class, n, mean, max
FROM g WHERE window_end <= (SELECT max(ts) FROM haze) - INTERVAL 2 HOUR""")
def str_01(t: Tables):
    return local(J.run_available(J.haze_windows(event_stream(t, "haze")), "haze"), "window_end", "latest_ts")


@query("str_01_area_haze_windows", """
WITH h AS (SELECT area_id, date_trunc('hour', ts) AS hr, count(*) AS n, sum(haze_index) AS s, max(haze_index) AS m, max(ts) AS lt, max(struct_pack(ts := ts, i := haze_index)).i AS li FROM haze GROUP BY 1, 2),
w AS (SELECT hr + INTERVAL 1 HOUR + k * INTERVAL 1 HOUR AS window_end, h.* FROM h, (SELECT unnest(range(72)) AS k) z),
g AS (SELECT area_id, window_end, max(lt) AS latest_ts, arg_max(li, lt) AS latest_index, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 3) AS mean, round(max(m), 3) AS max FROM w GROUP BY 1, 2)
SELECT area_id, window_end, latest_ts, latest_index, CASE WHEN latest_index < 0.3 THEN 'clear' WHEN latest_index < 0.45 THEN 'light' WHEN latest_index < 0.6 THEN 'moderate' ELSE 'dense' END AS latest_class, n, mean, max
FROM g WHERE window_end <= (SELECT max(ts) FROM haze) - INTERVAL 2 HOUR""")
def str_01_area(t: Tables):
    return local(J.run_available(J.haze_windows(event_stream(t, "haze"), by=("area_id",)), "haze"), "window_end", "latest_ts")


def in_order(t: Tables, rows, slice_: str, name: str):
    """``rows`` written as files, one for each number in the column ``slice_``, as a stream that reads them one by one in that order."""
    folder = f"{J.work_folder(t.spark, name)}/in"
    rows.repartition(slice_).write.partitionBy(slice_).parquet(folder)
    jvm = t.spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(jvm.Path(f"{folder}/{slice_}=*/part-*")):
        number = int(f.getPath().getParent().getName().split("=")[1])
        fs.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * number, -1)
    plain = rows.drop(slice_)
    return t.spark.readStream.schema(plain.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


@query("str_02_merged_cells", """
WITH o AS (SELECT CAST(l_orderkey % 90 AS INT) AS row, CAST((l_partkey * 7 + l_suppkey) % 180 AS INT) AS col, l_shipdate AS ts, l_extendedprice / 1000.3E0 AS no2, l_quantity / 5.003E0 - 5E0 AS u,
 l_tax * 1000E0 / 9.973E0 - 4E0 AS v FROM lineitem WHERE l_discount * 5E0 < 0.3E0)
SELECT row, col, ts, no2, n FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY ts DESC, no2 DESC, u DESC, v DESC) AS k, count(*) OVER (PARTITION BY row, col) AS n FROM o) z WHERE k = 1""")
def str_02_merged(t: Tables):
    """Granules of a quarter arrive in order, every fifth after the next two and every third twice; each batch merges the cells it has changed."""
    obs = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_orderkey % 90 AS INT) AS row", "CAST((l_partkey * 7 + l_suppkey) % 180 AS INT) AS col", "CAST(l_shipdate AS TIMESTAMP) AS ts",
        "l_extendedprice / 1000.3E0 AS no2", "l_discount * 5E0 AS cloud_fraction", "l_quantity / 5.003E0 - 5E0 AS u", "l_tax * 1000E0 / 9.973E0 - 4E0 AS v",
        "CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INT) AS granule")
    late = F.when(F.col("granule") % 5 == 0, F.col("granule") * 2 + 5).otherwise(F.col("granule") * 2)
    again = obs.where("granule % 3 = 0").withColumn("batch", late + 3)
    sent = obs.withColumn("batch", late).unionByName(again).drop("granule")
    stream = J.latest_cells(in_order(t, sent, "batch", "granules"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts"], "400 days")
    folder = J.work_folder(t.spark, "merged")
    table = Refreshed(t.spark, f"{folder}/out", ["row", "col"], "ts", compact_every=8)
    with J.state_store(t.spark, ROCKSDB, t.spark.sparkContext.defaultParallelism):
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(table.write).trigger(availableNow=True).start()
        q.awaitTermination()
    return local(table.rows().select("row", "col", "ts", "no2", "n"), "ts")


@query("str_02_latest_cells", """
SELECT row, col, ts, no2 FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY ts DESC, no2 DESC, u DESC, v DESC) AS k FROM global_obs WHERE cloud_fraction < 0.3E0) z WHERE k = 1""")
def str_02(t: Tables):
    return local(J.run_available(J.latest_cells(event_stream(t, "global_obs", "lineitem")), "cells", "complete").select("row", "col", "ts", "no2"), "ts")


@query("str_03_daily_means", """
WITH g AS (SELECT station_id, CAST(ts AS DATE) AS day, avg(no2) AS m, count(no2) AS n FROM stations_hourly WHERE hour(ts) >= 12 AND hour(ts) < 16 AND no2 >= 0 AND no2 < 1000 GROUP BY 1, 2)
SELECT station_id, day, round(m, 4) AS no2, n AS n_readings FROM g
WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM stations_hourly WHERE hour(ts) >= 12 AND hour(ts) < 16 AND no2 >= 0 AND no2 < 1000) - INTERVAL 2 HOUR""")
def str_03(t: Tables):
    d = J.run_available(J.daily_means(event_stream(t, "stations_hourly"), min_completeness=0.25), "daily")
    return d.withColumn("no2", F.round("no2", 4))


def _message_stream(t: Tables):
    """Events of a user as the turns of a session, one turn per event."""
    return event_stream(t).select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), "ts")


@query("str_04_session_windows", """
WITH o AS (SELECT user_id AS conv_id, event_id AS turn, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY ts, turn) AS sid FROM o),
g AS (SELECT conv_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS turns, max(turn) AS last_turn FROM s GROUP BY conv_id, sid)
SELECT * FROM g WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def str_04(t: Tables):
    return local(J.run_available(J.session_windows(_message_stream(t)), "sessions"), "session_start", "session_end")


@query("str_04_session_history", """
WITH o AS (SELECT user_id AS conv_id, event_id AS turn, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY ts, turn) AS sid FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sid ORDER BY ts DESC, turn DESC) AS back FROM s),
g AS (SELECT conv_id, sid, count(*) AS messages, CAST(least(count(*), 50) AS INT) AS kept, arg_max(turn, back) FILTER (WHERE back <= 50) AS first_turn, arg_min(turn, back) AS last_turn, max(ts) AS last_ts FROM b GROUP BY 1, 2),
e AS (SELECT *, lead(sid) OVER (PARTITION BY conv_id ORDER BY sid) IS NULL AS newest FROM g)
SELECT conv_id, messages, kept, first_turn, last_turn, last_ts FROM e WHERE NOT newest OR last_ts + INTERVAL 1 HOUR < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def str_04b(t: Tables):
    """Sessions that have ended, with the last 50 turns of each."""
    ended = J.run_available(session_histories(_message_stream(t)), "history", provider=ROCKSDB).where("expired")
    return local(ended.drop("expired"), "last_ts")


@query("str_05_refresh_latest", """
SELECT user_id, ts AS fetched_at, event_id, value, ts < (SELECT max(ts) FROM events) - INTERVAL 20 MINUTE AS stale
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) z WHERE k = 1""")
def str_05(t: Tables):
    """Runs of a refresh, one for every part of the day's events, into a table that is compacted on its way."""
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("fetched_at"), "event_id", "value", (F.col("event_id") % 12).cast("int").alias("part"))
    folder = J.work_folder(t.spark, "runs")
    table = Refreshed(t.spark, f"{folder}/out", ["user_id"], "fetched_at", compact_every=5)
    # Ties in fetched_at go to the greater event_id, also between versions: it is part of the order.
    stream = in_order(t, rows, "part", "runs").withColumn("fetched_at", F.struct("fetched_at", "event_id"))
    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(table.write).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = table.rows().withColumn("fetched_at", F.col("fetched_at.fetched_at")).drop("version")
    return local(with_staleness(newest, t.events.agg(F.max("ts").cast("timestamp")).scalar()), "fetched_at")


#: Batches that the late rows of STR-06 arrive in.
ARRIVALS = 104
_ARRIVED = f"""SELECT event_id, ts, CAST(floor((epoch + delay - min(epoch + delay) OVER ()) * {ARRIVALS} / (max(epoch + delay) OVER () - min(epoch + delay) OVER () + 1)) AS INT) AS batch
FROM (SELECT event_id, ts, CAST({{epoch}} AS BIGINT) AS epoch, CASE WHEN event_id % 13 = 0 THEN (event_id % 97) * 3600 * 6 ELSE (event_id % 7) * 600 END AS delay FROM {{events}}) z"""


@query("str_06_late_rows", f"""
WITH a AS ({_ARRIVED.format(epoch="floor(epoch(ts))", events="events")}),
b AS (SELECT batch, max(ts) AS m FROM a GROUP BY 1), r AS (SELECT batch, dense_rank() OVER (ORDER BY batch) AS k, m FROM b),
w AS (SELECT r.batch, max(o.m) - INTERVAL 2 HOUR AS mark FROM r LEFT JOIN r o ON o.k <= r.k - 2 GROUP BY 1)
SELECT count(DISTINCT batch) AS batches, count(*) AS rows_read, count(*) FILTER (ts <= mark) AS rows_dropped, count(*) FILTER (ts <= mark) AS rows_set_aside,
 count(*) FILTER (mark IS NULL OR ts > mark) AS rows_kept, CAST(coalesce(sum(event_id) FILTER (ts <= mark), 0) AS BIGINT) AS set_aside_ids FROM a JOIN w USING (batch)""")
def str_06(t: Tables):
    """Events that arrive out of order: the rows behind the watermark, counted over all batches and set aside.

    Spark filters a batch's late rows by the watermark that the batch before was planned with.
    """
    arrived = t.spark.sql(_ARRIVED.format(epoch="unix_timestamp(CAST(ts AS TIMESTAMP))", events="{events}"), events=t.events).withColumn("ts", F.col("ts").cast("timestamp"))
    folder, name = J.work_folder(t.spark, "late"), f"late-{uuid.uuid4().hex}"
    counter = DropCounter(t.spark, f"{folder}/counts", name)
    stream = in_order(t, arrived, "batch", "arrivals")
    t.spark.streams.addListener(counter)
    try:
        with J.state_store(t.spark, ROCKSDB, t.spark.sparkContext.defaultParallelism):
            q = keep_in_time(stream, f"{folder}/kept", ["event_id"], name, f"{folder}/state")
            q.awaitTermination()
        counter.settle(q)
    finally:
        t.spark.streams.removeListener(counter)
    kept = t.spark.read.parquet(f"{folder}/kept")
    late = set_aside(arrived, kept, ["event_id"]).agg(F.count("*").alias("rows_set_aside"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("set_aside_ids"))
    seen = counter.counts().agg(F.count(F.when(F.col("rows_in") > 0, 1)).alias("batches"), F.sum("rows_in").alias("rows_read"), F.sum("rows_dropped").alias("rows_dropped"))
    return seen.join(late, F.lit(True)).join(kept.agg(F.count("*").alias("rows_kept")), F.lit(True))
