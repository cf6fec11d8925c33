"""Latest-row and de-duplication operators.

Latest-per-key is an aggregate (``max_by``) rather than a self-join to a max subquery: it
runs partially on the map side, so a key holding a large share of the rows still shuffles one
row per task.  Where all columns have a fixed width the pick is one ``max_by`` per column, which Spark
keeps in a hash aggregate (no sort of the input); rows with text are picked as a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fixed_width(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) and not (
        isinstance(kind, T.DecimalType) and kind.precision > 18)


def _pick(df: DataFrame, keys: list[str], order: Column, keep: str) -> DataFrame:
    """One row per key: the one with the greatest (or least) ``order``."""
    by = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    x = df.withColumn("_by", order)
    # every column sees the rows in the same order and compares the same values, so all take the same row
    if all(_fixed_width(x.schema[c].dataType) for c in [*rest, "_by"]):
        return x.groupBy(*keys).agg(*[by(F.col(c), F.col("_by")).alias(c) for c in rest])
    out = x.groupBy(*keys).agg(by(F.struct(*[F.col(c) for c in rest]), F.col("_by")).alias("_r"))
    return out.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def latest(df: DataFrame, key="ticker", order="date_updated", where: Column | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    keys = [key] if isinstance(key, str) else list(key)
    return _pick(df if where is None else df.where(where), keys, F.col(order), "last")


def sort_key(df: DataFrame, column: str, key="ticker", order="date_updated") -> DataFrame:
    """The column in the latest row per key; keys whose latest row has no value drop out."""
    return (df.groupBy(key).agg(F.max_by(F.col(column), F.col(order)).alias(column), F.max(order).alias(order))
            .where(F.col(column).isNotNull()))


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) in the given order.

    An aggregate with map-side combine, so duplicated hot keys collapse before the shuffle."""
    return _pick(df, list(key), order[0] if len(order) == 1 else F.struct(*order), keep)


def latest_n_dates(df: DataFrame, n: int, key="ticker", order="report_date") -> DataFrame:
    """Rows whose date is among the key's ``n`` latest distinct dates (J8).  The window covers
    one ticker's report dates (bounded by quarters in the retention window)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_dr", F.dense_rank().over(w)).where(F.col("_dr") <= n).drop("_dr")


def top_n(df: DataFrame, n: int, key, order: Sequence[Column]) -> DataFrame:
    """First ``n`` rows per key in the given order (W11).  ``row_number() <= n`` lets Spark
    insert a partial group limit before the shuffle, so at most n rows per key leave a task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
