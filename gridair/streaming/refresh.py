"""A table refreshed by batches: changes by version, snapshots that cover them, and a manifest that is swapped at once.

Readers follow the newest manifest: one snapshot and the few versions after it, whatever has been written before.  Folders
that no manifest names (a batch that stopped half way, versions already in the snapshot) are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refreshed:
    """Rows by ``keys``, the one with the greatest ``order`` wins (ties by the later version, then the other columns)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, compact_every: int = 20):
        self.spark, self.folder, self.keys, self.order, self.compact_every = spark, folder.rstrip("/"), keys, order, compact_every
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        # No option: renaming onto a name that is taken fails.
        self._plain = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        self._files = jvm.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    # -- manifests
    def manifest(self) -> dict:
        """The newest manifest: its number, the snapshot with the last version in it, and the versions after it."""
        found = self._fs.globStatus(self._path(f"{self.folder}/manifest/[0-9]*.json")) or []
        if not found:
            return {"number": 0, "snapshot": None, "upto": -1, "versions": []}
        newest = max((s.getPath() for s in found), key=lambda p: p.getName())
        stream = self._fs.open(newest)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _swap(self, after: dict) -> None:
        """Publish a manifest: written aside, then renamed, which fails if another writer has published that number."""
        number = after["number"]
        aside = self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        self._files.rename(aside, self._path(f"{self.folder}/manifest/{number:012d}.json"), self._plain)

    # -- rows
    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*self.keys, self.order, "version")]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(self.order, "version", *others)).alias("_b"))
        return best.select(*self.keys, *[F.col(f"_b.{c}").alias(c) for c in (self.order, *others, "version")])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch (for ``foreachBatch``).  A batch that is run again replaces its first try; one in the snapshot already is left out."""
        now = self.manifest()
        if batch_id <= now["upto"] or batch_id in now["versions"]:
            return
        path = f"changes/{batch_id:012d}"
        self._newest(batch.withColumn("version", F.lit(batch_id).cast("long"))).write.mode("overwrite").parquet(f"{self.folder}/{path}")
        self._swap({**now, "number": now["number"] + 1, "versions": [*now["versions"], batch_id]})
        if len(now["versions"]) + 1 >= self.compact_every:
            self.compact()

    def rows(self) -> DataFrame | None:
        """All rows with their version, or None if nothing is published."""
        now = self.manifest()
        paths = [f"{self.folder}/{now['snapshot']}"] * bool(now["snapshot"]) + [f"{self.folder}/changes/{v:012d}" for v in now["versions"]]
        return self._newest(self.spark.read.parquet(*paths)) if paths else None

    def compact(self) -> None:
        """One snapshot in place of the last one and the versions after it; the same rows before and after."""
        now = self.manifest()
        if not now["versions"]:
            return
        path = f"snapshots/{now['versions'][-1]:012d}-{uuid.uuid4().hex}"
        self.rows().write.parquet(f"{self.folder}/{path}")
        self._swap({"number": now["number"] + 1, "snapshot": path, "upto": max(now["versions"]), "versions": []})

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest does not name, and say how many.  Readers of older manifests must be done."""
        now = self.manifest()
        named = {now["snapshot"], *[f"changes/{v:012d}" for v in now["versions"]]}
        gone = 0
        for kind in ("changes", "snapshots"):
            for s in self._fs.globStatus(self._path(f"{self.folder}/{kind}/*")) or []:
                if f"{kind}/{s.getPath().getName()}" not in named:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def with_staleness(rows: DataFrame, now: Column, order: str = "fetched_at", stale_after: str = "20 minutes") -> DataFrame:
    """Rows flagged stale when they are older than ``stale_after``."""
    return rows.withColumn("stale", F.col(order) < now - F.expr(f"interval {stale_after}"))
