"""Orders as data (O3, O4): the place of a row in a sorted table as a column.

A window without partitions would bring the whole table to one task.  Here rows are dealt out by range,
sorted and written, and a row's place is its number within its range after the rows of all ranges before:
only one count per range goes through one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with the row's place from 1 on in the given order (make it total, or equal rows are numbered as they come).

    The sorted rows are written once, so the numbers hold whatever is computed again after a failure."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}/sorted"
    by_range = df.repartitionByRange(*order).sortWithinPartitions(*order)
    by_range.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_low"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", "_low", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(starts, "_part").select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_low") + 1).alias(name))


def metric_order(column: str, higher_is_better: dict, tie: str = "ticker") -> list[Column]:
    """O3: descending where a higher value is better, ascending otherwise; nulls last; ties by ``tie``."""
    c = F.col(column)
    return [c.desc_nulls_last() if higher_is_better.get(column, False) else c.asc_nulls_last(), F.col(tie).asc()]


def ranked_by_metric(df: DataFrame, column: str, higher_is_better: dict, tie: str = "ticker") -> DataFrame:
    """A comparison table with each row's place by the metric rule (O3)."""
    return numbered(df, metric_order(column, higher_is_better, tie))


def ranked_detail(df: DataFrame, column: str, tie: str = "ticker") -> DataFrame:
    """A detail table with each row's place, always descending, nulls last."""
    return numbered(df, [F.col(column).desc_nulls_last(), F.col(tie).asc()])
