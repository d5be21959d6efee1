"""Shared helpers of the operators: written tables, running sums over hot groups, components, words, files."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a plain local session without the setting (a test) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if spark.sparkContext.applicationId not in _OWN:
        _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="gridair-llm-")
    return "file://" + _OWN[spark.sparkContext.applicationId]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps start from these files, whatever executor is lost."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``written`` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_sum(df: DataFrame, keys: list[str], hashed: str, value: str, out: str, ties: Iterable[str] = ()) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before in the order (``hashed``, ``ties``).

    ``hashed`` is an evenly spread long from 0 to 2**62 - 1.  Its leading bits cut every group into about sqrt(rows)
    buckets, so that a group of any size is summed by many tasks: rows within a bucket by a window, and the buckets'
    totals (few rows) by another.  Keys must not be null.
    """
    bits = max(0, math.ceil(math.log2(max(1, df.count())) / 2))
    cut = df.withColumn("_bucket", F.shiftright(F.col(hashed), 62 - bits))
    by = [*keys, "_bucket"]
    totals = cut.groupBy(*by).agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*by).orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(offsets, by).withColumn(out, F.col("_inner") + F.col("_offset"))
            .drop("_bucket", "_inner", "_offset"))


def ranked(df: DataFrame, keys: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows of the same ``keys`` that come before in ``order`` (nulls first).

    Rows are dealt to ranges of (``keys``, ``order``), so a group of any size is ranked by many tasks; a range's part of
    a group starts at the total of the ranges before it.  Keys must not be null; rows equal in ``order`` get places in
    any order.
    """
    ranges = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    by = [*keys, "_range"]
    totals = ranges.groupBy(*by).agg(F.sum(weight).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranges.withColumn("_inner", F.coalesce(F.sum(weight).over(inner), F.lit(0))).join(offsets, by)
            .withColumn(out, F.col("_inner") + F.col("_offset")).drop("_range", "_inner", "_offset"))


def spread_hash(*cols) -> "F.Column":
    """An evenly spread long from 0 to 2**62 - 1 (first 62 bits of an md5), the same in any engine."""
    return F.shiftright(F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 16), 16, -10).cast("long"), 2).bitwiseAND(F.lit((1 << 62) - 1))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, root), root the smallest node of its component, one row for each node.

    Alternating large-star and small-star steps until nothing changes; each round is a written table that replaces the
    one before.  A node with very many neighbours is only ever aggregated (with partial sums) and joined.
    """
    def save(df):
        seen = Observation()
        table = written(df.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")), "components")
        return table, (seen.get["n"], seen.get["h"])

    now, mark = save(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo")
        after, to = save(small)
        drop_written(now)
        if to == mark:
            break
        now, mark = after, to
    return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(after.select("lo", "lo").distinct())


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(columns as lists ..., batch)`` -> lists of output columns, for every Arrow batch of ``df``; text columns arrive as bytes."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [(c.cast(pa.large_binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c).to_pylist() for c in batch.columns]
            out = fn(*cols)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, arrow.types, strict=True)], schema=arrow)
    return df.mapInArrow(run, target)


def filesystem(uri: str):
    """(file system, path) of a folder or file URI that driver and executors share."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
