"""Sinks: CSV points, GeoJSON lines, daily folders, run keys, JSON facts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridair import constants as C
from gridair.functions import bands, wind
from gridair.operators.cells import with_centre


def significant(x: Column, digits: int = 6) -> Column:
    """Value rounded to significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0))))))
    return F.coalesce(F.round(x * scale, 0) / scale, x)


def strided(cells: DataFrame, stride: int, start: int = 0) -> DataFrame:
    """Every ``stride``-th cell along rows and columns; thinning is what these map layers are."""
    return cells.where(((F.col("row") - start) % stride == 0) & ((F.col("col") - start) % stride == 0) & (F.col("row") >= start) & (F.col("col") >= start))


def points_table(cells: DataFrame, grids: DataFrame, stride: int = 1, value: str = "no2") -> DataFrame:
    s = with_centre(strided(cells, stride).where(F.col(value).isNotNull()), grids)
    return s.select("area_id", "day", significant(F.col("lon")).alias("lon"), significant(F.col("lat")).alias("lat"), significant(F.col(value)).alias(value))


def by_folder(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of a folder in one task, which opens its file once; folders are spread over as many tasks as the session shuffles into."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _plain_folder(df: DataFrame, path: str) -> str | None:
    """``path`` as a folder of a mounted file system that driver and executors share; None in any other store, which Spark's own writer serves."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _write_folders(df: DataFrame, path: str, keys: tuple[str, ...], header: str | None = None, replace_all: bool = False) -> None:
    """Rows of each key as one file of its folder ``key=value/...``: Parquet, or with a ``header`` the text lines of the only other column.

    Tasks write the files beside the folders and list them; only when all are there, tasks put the listed ones into their
    folders and remove what these held.  So a run that fails while it writes changes nothing, a task run again does no harm, and no step goes
    through the folders one by one on the driver.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    staged, name = f"{path}/_staged-{run}", f"part-{run}.{'parquet' if header is None else 'csv'}"
    fields = [c for c in df.columns if c not in keys]
    marks = [f"_key{i}" for i in range(len(keys))]
    # Spark's folder of a null and of an empty text are the same.
    rows = df.select(*[F.nullif(F.col(k).cast("string"), F.lit("")).alias(m) for k, m in zip(keys, marks, strict=True)], *fields)
    rows = by_folder(rows, tuple(marks)).sortWithinPartitions(*marks)

    def write(batches):
        import os
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        def folder(values):
            escaped = lambda v: re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", v)
            return "/".join(f"{escaped(k)}={escaped(v) if v else '__HIVE_DEFAULT_PARTITION__'}" for k, v in zip(keys, values, strict=True))
        mine, now, out, listed, n = f"{staged}/{uuid.uuid4().hex}", None, None, [], 0
        os.makedirs(mine, exist_ok=True)
        for batch in batches:
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:len(keys)]]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            own = pa.Table.from_batches([batch]).drop_columns(marks)
            for a, b in zip(cuts, cuts[1:], strict=False):
                to = folder([c[a].as_py() for c in batch.columns[:len(keys)]])
                if to != now:
                    if out is not None:
                        out.close()
                    now, n = to, n + 1
                    listed.append((to, f"{mine}/{n}"))
                    if header is None:
                        out = pq.ParquetWriter(f"{mine}/{n}", own.schema, compression="snappy", store_schema=False)
                    else:
                        out = open(f"{mine}/{n}", "w", encoding="utf-8", newline="")
                        out.write(header + "\n")
                part = own.slice(a, b - a)
                if header is None:
                    out.write_table(part)
                else:
                    out.write("".join(f"{line}\n" for line in part.column(0).to_pylist()))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in listed], pa.string()) for i in range(2)], ["folder", "file"])

    def place(batches):
        import os

        for batch in batches:
            for folder, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = f"{path}/{folder}"
                os.makedirs(to, exist_ok=True)
                if os.path.exists(file) or not os.path.exists(f"{to}/{name}"):  # else this was done by a task that ran before
                    os.replace(file, f"{to}/{name}")
                for old in os.listdir(to):
                    if old != name and not os.path.isdir(f"{to}/{old}"):
                        os.remove(f"{to}/{old}")
            yield batch.slice(0, 0)
    at = spark._jvm.org.apache.hadoop.fs.Path
    store = at(f"file://{path}").getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.mapInArrow(write, "folder string, file string").write.parquet(f"file://{staged}/_list")
        if replace_all:
            for s in store.listStatus(at(f"file://{path}")):
                if s.getPath().getName() != f"_staged-{run}":
                    store.delete(s.getPath(), True)
        listed = spark.read.schema("folder string, file string").parquet(f"file://{staged}/_list")
        by_folder(listed, ("folder",)).mapInArrow(place, "folder string, file string").write.format("noop").mode("overwrite").save()
        store.create(at(f"file://{path}/_SUCCESS"), True).close()
    finally:
        store.delete(at(f"file://{staged}"), True)


def write_points_csv(cells: DataFrame, grids: DataFrame, path: str, stride: int = 1) -> None:
    """Point files per area and day, written in parallel, a file a folder; what ``path`` held before is gone."""
    keys, points = ("area_id", "day"), points_table(cells, grids, stride)
    if (to := _plain_folder(cells, path)) is None:
        by_folder(points, keys).write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)
        return
    fields = [c for c in points.columns if c not in keys]
    lines = points.select(*keys, F.to_csv(F.struct(*fields)).alias("line"))
    _write_folders(lines, to, keys, ",".join(fields), replace_all=True)


def point_features(cells: DataFrame, grids: DataFrame, stride: int = 2, value: str = "no2") -> DataFrame:
    """One GeoJSON point feature per row, ready for a text sink."""
    s = with_centre(strided(cells, stride).where(F.col(value).isNotNull()), grids)
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 5), F.round("lat", 5)).alias("coordinates"))
    props = F.struct(F.round(value, 3).alias(value), bands.hazard_band(F.col(value)).alias("band"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")))
    return s.select("area_id", "day", "row", "col", feature.alias("feature"))


def wind_features(cells: DataFrame, grids: DataFrame, stride: int = 10, seconds: float = 900.0) -> DataFrame:
    """One GeoJSON arrow per row: ``seconds`` of travel from the centre of every ``stride``-th cell."""
    g = grids.select("area_id", F.cos(F.radians(F.col("north") - F.col("height") * F.col("res") / 2)).alias("_cos"))
    s = with_centre(strided(cells, stride, stride // 2), grids).join(g, "area_id").where(F.col("u10").isNotNull() & F.col("v10").isNotNull())
    u, v = F.col("u10"), F.col("v10")
    x1 = F.col("lon") + u * seconds / (F.lit(C.GRID_M_LON) * F.col("_cos"))
    y1 = F.col("lat") + v * seconds / C.GRID_M_LAT
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.round("lon", 5), F.round("lat", 5)), F.array(F.round(x1, 5), F.round(y1, 5))).alias("coordinates"))
    props = F.struct(F.round(wind.speed(u, v), 2).alias("speed_ms"), F.round(wind.to_deg(u, v), 1).alias("heading_deg"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")))
    return s.select("area_id", "day", "row", "col", F.round(x1, 5).alias("head_lon"), F.round(y1, 5).alias("head_lat"),
                    F.col("u10"), F.col("v10"), feature.alias("feature"))


def write_daily(df: DataFrame, path: str, keys: tuple[str, ...] = ("area_id", "day")) -> None:
    """One folder per key, with one file; only the folders present in ``df`` are replaced."""
    if (to := _plain_folder(df, path)) is not None:
        _write_folders(df, to, keys)
        return
    (by_folder(df, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def with_run_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """``run_key``: 16 hex digits of the hash of the named parameters."""
    return df.withColumn("run_key", F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16))


def pending_runs(keys: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Runs not present in the catalogue yet."""
    return keys.join(catalogue.select("run_key").distinct(), "run_key", "left_anti")


def facts_document(facts: DataFrame, sections: dict[str, list[str]], keys: tuple[str, ...] = ("area_id", "day")) -> DataFrame:
    """One JSON document per key with the named columns grouped into sections."""
    parts = [F.struct(*cols).alias(name) for name, cols in sections.items()]
    return facts.select(*keys, F.to_json(F.struct(*keys, *parts)).alias("document"))


def write_facts_json(facts: DataFrame, sections: dict[str, list[str]], path: str, keys: tuple[str, ...] = ("area_id", "day")) -> None:
    facts.select(*keys, *[F.struct(*cols).alias(n) for n, cols in sections.items()]).write.mode("overwrite").json(path)
