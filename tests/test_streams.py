"""Streams in several batches: session state, refreshed tables, merged cells, late rows."""

import datetime as dt
import time

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from gridair.streaming import jobs as J
from gridair.streaming.late import DropCounter, keep_in_time, set_aside
from gridair.streaming.refresh import Refreshed, with_staleness
from gridair.streaming.sessions import ROCKSDB, live_histories, session_histories

T0 = dt.datetime(2025, 1, 1, 8)


class Feed:
    """A folder that grows by a file at a time, read as a stream."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder / "in", schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/{self.n:04d}")
        self.n += 1
        time.sleep(0.01)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(self.folder))


def run(stream, folder, write, mode, provider=None):
    with J.state_store(stream.sparkSession, provider):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(folder / "state")).foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_session_histories_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "conv_id long, turn long, ts timestamp")
    feed.put([(1, k, at(k)) for k in range(40)] + [(2, 0, at(0))])
    feed.put([(1, k, at(k)) for k in range(38, 70)] + [(2, 1, at(30)), (3, 0, at(0)), (3, 1, at(59)), (3, 2, at(119)), (3, 3, at(300))])
    feed.put([(1, 70, at(65.5)), (2, 9, at(400)), (9, 0, at(1000))])
    got, live = [], {}

    def write(batch, _):
        for r in batch.collect():
            if r.expired:
                got.append((r.conv_id, r.messages, r.kept, r.first_turn, r.last_turn))
            else:
                live[r.conv_id] = (r.messages, r.kept, r.first_turn, r.last_turn)
    run(session_histories(feed.stream(), keep=50), tmp_path, write, "append", ROCKSDB)
    # One message, turn 70, came after turns 66 to 69 that were sent later: it is counted where its time is.
    assert sorted(got) == [(1, 71, 50, 21, 69), (2, 1, 1, 9, 9), (2, 2, 2, 0, 1), (3, 1, 1, 2, 2), (3, 1, 1, 3, 3), (3, 2, 2, 0, 1)]
    assert live[9] == (1, 1, 0, 0) and live[1] == (71, 50, 21, 69)


def test_live_histories_forget_by_the_clock(spark, tmp_path):
    feed, live = Feed(spark, tmp_path, "conv_id long, turn long, ts timestamp"), []
    feed.put([(1, k, at(k)) for k in range(5)])
    stream = live_histories(feed.stream(), keep=3, idle_s=4)

    def write(batch, _):
        live.extend((r.conv_id, r.kept, r.first_turn, r.last_turn) for r in batch.collect())
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        run(stream, tmp_path, write, "update", ROCKSDB)
        feed.put([(1, 5, at(5))])
        time.sleep(6)
        run(stream, tmp_path, write, "update", ROCKSDB)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert live == [(1, 3, 2, 4), (1, 1, 5, 5)]


def rows_of(table):
    return sorted((r.k, r.v) for r in table.rows().collect())


def test_a_refreshed_table_is_the_same_after_compaction_and_retries(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "k long, at long, v string")
    table = Refreshed(spark, str(tmp_path / "t"), ["k"], "at", compact_every=100)
    assert table.rows() is None
    for n in range(6):
        table.write(batch((n % 3, n, f"new{n}"), (9, 50 - n, f"old{n}")), n)
    want = [(0, "new3"), (1, "new4"), (2, "new5"), (9, "old0")]
    assert rows_of(table) == want and len(table.rows().inputFiles()) <= 6 * 8
    before = table.manifest()
    # A batch that stops before its manifest is published changes nothing, and runs again.
    batch((7, 1, "half")).withColumn("version", F.lit(6).cast("long")).write.parquet(str(tmp_path / "t" / "changes" / "000000000006"))
    assert rows_of(table) == want and table.manifest() == before
    table.compact()
    after = table.manifest()
    assert rows_of(table) == want and after["versions"] == [] and after["upto"] == 5
    assert all("snapshots" in f for f in table.rows().inputFiles())
    table.write(batch((7, 1, "whole")), 6)
    table.write(batch((7, 2, "twice")), 6)
    table.write(batch((0, 99, "again")), 3)
    assert rows_of(table) == [*want[:3], (7, "whole"), want[3]]
    # A compaction that stops half way leaves a folder that no one reads; vacuum takes it and the covered versions away.
    batch((1, 100, "stray")).withColumn("version", F.lit(0).cast("long")).write.parquet(str(tmp_path / "t" / "snapshots" / "stray"))
    assert table.vacuum() == 7 and rows_of(table) == [*want[:3], (7, "whole"), want[3]]
    with pytest.raises(Py4JJavaError):
        table._swap({**table.manifest(), "versions": []})
    small = Refreshed(spark, str(tmp_path / "s"), ["k"], "at", compact_every=3)
    for n in range(10):
        small.write(batch((n, n, "x")), n)
        assert len(small.manifest()["versions"]) < 3
    assert small.rows().count() == 10
    stale = with_staleness(spark.createDataFrame([(at(0),), (at(30),)], "fetched_at timestamp"), F.lit(at(45)))
    assert sorted(r.stale for r in stale.collect()) == [False, True]


def test_a_batch_writes_only_the_cells_it_changed(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id long, row int, col int, ts timestamp, no2 double, cloud_fraction double, u double, v double")

    def obs(i, row, minutes, no2, cloud=0.1):
        return (i, row, 0, at(minutes), no2, cloud, 0.0, 0.0)
    feed.put([obs(i, i % 50, i, float(i)) for i in range(100)])
    feed.put([obs(i, i % 50, i, float(i)) for i in range(60, 70)] + [obs(200, 3, 200, 5.0)])       # a granule sent twice, and one new cell
    feed.put([obs(300, 4, 20, 77.0), obs(301, 5, 500, 1.0, 0.9), obs(302, 6, 500, 9.0)])            # late, cloudy, new
    table = Refreshed(spark, str(tmp_path / "out"), ["row", "col"], "ts", compact_every=100)
    stream = J.latest_cells(feed.stream(), ["id"], "1 day")
    run(stream, tmp_path, table.write, "update")
    written = [{r.row for r in spark.read.parquet(str(p)).collect()} for p in sorted((tmp_path / "out" / "changes").iterdir())]
    assert [w for w in written if w] == [set(range(50)), {3}, {4, 6}]
    got = {r.row: (r.no2, r.n) for r in table.rows().collect()}
    assert got[3] == (5.0, 3) and got[4] == (54.0, 3) and got[5] == (55.0, 2) and got[6] == (9.0, 3) and got[17] == (67.0, 2)


def test_late_rows_are_counted_and_set_aside(spark, tmp_path):
    feed = Feed(spark, tmp_path, "event_id long, ts timestamp")
    for n in range(5):
        feed.put([(10 * n + k, at(60 * 6 * n + k)) for k in range(5)] + ([(1000 + n, at(0)), (10 * n, at(60 * 6 * n))] if n else []))
    counter = DropCounter(spark, str(tmp_path / "counts"), "late-test")
    spark.streams.addListener(counter)
    q = keep_in_time(feed.stream(), str(tmp_path / "kept"), ["event_id"], "late-test", str(tmp_path / "state"))
    q.awaitTermination()
    counter.settle(q)
    spark.streams.removeListener(counter)
    kept = spark.read.parquet(str(tmp_path / "kept"))
    arrived = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    late = set_aside(arrived, kept, ["event_id"])
    # A batch is filtered by the watermark that the batch before was planned with.
    assert sorted(r.event_id for r in late.collect()) == [1003, 1004] and kept.count() == 27
    total = counter.counts().agg(F.sum("rows_in"), F.sum("rows_dropped")).first()
    assert tuple(total) == (33, 2)
