"""Late rows: counted by a listener over every batch of a run, and set aside as rows."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

COUNTS = "batch_id long, rows_in long, rows_dropped long"


class DropCounter(StreamingQueryListener):
    """Writes each batch's input and dropped rows into ``folder``, a small file a batch, as progress is reported.

    Spark keeps the progress of the last hundred batches only; this keeps all, also over restarts (a batch run again
    replaces its file).  Only queries of the given name count.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name, self.seen = spark, folder.rstrip("/"), name, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.batchId:012d}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps({"batch_id": p.batchId, "rows_in": p.numInputRows, "rows_dropped": dropped}).encode()))
        out.close()
        self.seen.add(p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def settle(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the query's last progress has been reported (listeners run behind the stream)."""
        last = query.lastProgress
        end = time.monotonic() + seconds
        while last and last.batchId not in self.seen and time.monotonic() < end:
            time.sleep(0.1)

    def counts(self) -> DataFrame:
        """(batch_id, rows_in, rows_dropped) of every batch reported."""
        return self.spark.read.schema(COUNTS).json(self.folder)


def keep_in_time(stream: DataFrame, kept: str, key: list[str], name: str, state: str, ts: str = "ts", delay: str = "2 hours") -> StreamingQuery:
    """Write the rows that are in time, each key once within ``delay``, to ``kept`` (a version a batch); the stream's operators count the rest."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(kept)
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)
    return once.writeStream.queryName(name).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()


def set_aside(arrived: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """The rows that arrived and were not kept: those behind the watermark (a row sent twice is kept once, under its key)."""
    return arrived.join(kept.select(*key), key, "left_anti")
