"""Global order without one task for all rows: range partitions, landed once, and prefix sums over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import land


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in range partitions of the order, numbered by `_part`; landed, so that both uses of it see the same parts."""
    return land(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def before_parts(totals: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Of (keys, _part, numbers): for each part the sums of the parts before it, by new name.

    A key has one row for each part, so its window holds no more rows than there are parts."""
    quoted = [f"`{k}`" for k in keys]
    part = f"partition by {', '.join(quoted)} " if keys else ""
    w = f"over ({part}order by _part rows between unbounded preceding and 1 preceding)"
    return totals.selectExpr(*quoted, "_part", *[f"coalesce(sum(`{c}`) {w}, 0) as `{name}`" for name, c in sums.items()])


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df landed; a broadcast side if it has so few rows, as counted."""
    out = land(df)
    return F.broadcast(out) if out.count() <= most else out


def numbered(df: DataFrame, order: list[str], out: str, first: int = 0) -> DataFrame:
    """df with its rows numbered in the order of columns that identify a row."""
    parts = ranged(df, *order)
    start = before_parts(parts.groupBy("_part").agg(F.count("*").alias("_n")), [], {"_before": "_n"})
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(small(start), "_part").withColumn(out, F.col("_before") + F.col("_own") - 1 + first).drop("_part", "_own", "_before")
