"""Aggregates on several levels at once, unions and differences of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multi_level(df: DataFrame, levels: list[str], *aggs: Column) -> DataFrame:
    """Totals for every prefix of ``levels`` (detail, each outer level, everything) with the grouping id."""
    return df.rollup(*levels).agg(F.grouping_id().alias("level"), *aggs)


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def common_features(a: DataFrame, b: DataFrame, name: str = "feature") -> DataFrame:
    """Names present in both tables of names."""
    return a.select(name).intersect(b.select(name))


def missing_from(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` without a partner in ``b``."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items of ``todo`` not computed yet."""
    return missing_from(todo, done, keys).select(*todo.columns)
