"""Picking a series by label where sources name it differently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_key(name: Column) -> Column:
    """Labels are compared trimmed and in lower case."""
    return F.lower(F.trim(name))


def pick_labels(long: DataFrame, labels: Mapping[str, Sequence[str]] | DataFrame, key: Sequence[str] = ("ticker",),
                on: str = "report_date", name: str = "metric_name", value: str = "metric_value", shown: str | None = None) -> DataFrame:
    """(key, series, date, value, label): per key and series the rows of its best label.

    ``labels`` lists the candidates of each series in order of preference, or is a relation (series,
    label, priority) of any size.  A candidate counts as present if any date has a value under it; then the
    whole series is taken from it, as a statement's row is, and later candidates are not mixed in.
    Labels that differ only in case or surrounding space have one priority: the least spelling is taken per date.
    ``shown`` is the column returned as label (default: the one that is matched).

    One shuffle on the key: the best priority is a window over the key's rows (dates of one statement,
    bounded by the calendar), and the pick per date stays where the rows are."""
    keys = list(key)
    rows = long.where(F.col(value).isNotNull())
    if isinstance(labels, DataFrame):
        wanted = labels.select("series", label_key(F.col("label")).alias("_key"), F.col("priority").cast("int").alias("_p"))
        rows = rows.withColumn("_key", label_key(F.col(name))).join(wanted, "_key")
    else:
        known: dict[str, list[Column]] = {}
        for series, names in labels.items():
            seen = set()
            for p, n in enumerate(names):
                k = n.strip().lower()
                if k not in seen:
                    known.setdefault(k, []).append(F.struct(F.lit(series).alias("series"), F.lit(p).alias("_p")))
                    seen.add(k)
        pairs = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*v))])
        rows = rows.select("*", F.inline(pairs[label_key(F.col(name))]))
    best = F.min("_p").over(Window.partitionBy(*keys, "series"))
    rows = rows.withColumn("_best", best).where(F.col("_p") == F.col("_best"))
    first = F.min(F.struct(F.col(shown or name).alias("label"), F.col(value).alias("value")))
    out = rows.groupBy(*keys, "series", on).agg(first.alias("_f"))
    return out.select(*keys, "series", on, F.col("_f.value").alias("value"), F.col("_f.label").alias("label"))


def first_present(columns: Sequence[str | Column]) -> Column:
    """The absolute value of the first of these columns that is there; null if that one has no value is
    not told apart from an absent one, so the next one is taken."""
    return F.abs(F.coalesce(*[F.col(c) if isinstance(c, str) else c for c in columns]))
