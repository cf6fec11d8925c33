"""Partitioned tables: layout, pruned reads, and merges that touch only the partitions they hit.

``write_table`` lays a table out in folders by year and month (or by buckets of a key) and cuts files by
number of rows (S19, S20).  ``in_period`` filters by date and, where the partition columns are
there, by them as well, so that a window (a literal date or one that a subquery finds at run time)
reads its own months only (S11, S19).

``PartitionTable`` is a table that is loaded again and again.  Each commit writes the partitions that it
changes to a folder of its own and then appends one small file that lists where every partition of
the table lies; that file appears by one rename, so a reader sees the table before or after a load, and a
load that dies leaves nothing behind that is listed.  Partitions that a load does not touch are
neither read nor copied.  One writer at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

#: Rows per written file, at most: a loader's file stays small enough for one task to rewrite.
ROWS_PER_FILE = 5_000_000
YEAR, MONTH, BUCKET = "part_year", "part_month", "part_bucket"


@dataclass(frozen=True)
class Layout:
    """Partition columns of a table and what they are made of: a date column (year and month) or a key (buckets)."""

    date_col: str | None = None
    key: str | None = None
    buckets: int = 16

    @property
    def names(self) -> list[str]:
        return [YEAR, MONTH] if self.date_col else [BUCKET]

    def add(self, df: DataFrame) -> DataFrame:
        if self.date_col:
            return df.withColumns({YEAR: F.year(self.date_col), MONTH: F.month(self.date_col)})
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))


def by_month(date_col: str = "date") -> Layout:
    return Layout(date_col=date_col)


def by_bucket(key: str, buckets: int = 16) -> Layout:
    return Layout(key=key, buckets=buckets)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), max_records_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` (S20), replacing only the partitions that it has rows of.

    Rows are dealt out by partition in shares of the advised size (a rebalance), so a month that holds
    a third of the table is many tasks and files, and a small one is one."""
    w = df.hint("rebalance", *partition_by) if partition_by else df
    (w.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(*partition_by).parquet(path))


def _month_number(year: Column, month: Column) -> Column:
    return year * 12 + month


def in_period(df: DataFrame, start=None, end=None, on: str = "date") -> DataFrame:
    """Rows with ``start`` <= date <= ``end`` (P2); a table that has the partition columns is pruned by them too."""
    parts = YEAR in df.columns and MONTH in df.columns
    here = _month_number(F.col(YEAR), F.col(MONTH))
    for bound, before in ((start, False), (end, True)):
        if bound is None:
            continue
        d = S.as_date(bound)
        df = df.where(F.col(on) <= d if before else F.col(on) >= d)
        if parts:
            edge = _month_number(F.year(d), F.month(d))
            df = df.where(here <= edge if before else here >= edge)
    return df


def plain(df: DataFrame) -> DataFrame:
    """Without the partition columns."""
    return df.drop(YEAR, MONTH, BUCKET)


def latest_date(df: DataFrame, on: str = "date") -> Column:
    """The latest date as a scalar subquery; of a table by month only the last month is read for it."""
    if YEAR in df.columns and MONTH in df.columns:
        here = _month_number(F.col(YEAR), F.col(MONTH))
        df = df.where(here == df.select(F.max(here)).scalar())
    return df.select(F.max(on)).scalar()


@dataclass(frozen=True)
class Commit:
    """State of a table: where its partitions lie, the number of the commit and the last batch loaded."""

    number: int
    batch: int | None
    parts: tuple[tuple[str, str], ...]  # (partition, place)


class PartitionTable:
    """A table under ``root`` with a manifest per commit.

    ``base`` names a folder written by ``write_table`` with the same layout: its partitions are the
    first state, read where they are and never copied as a whole."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, layout: Layout, base: str | None = None):
        self.spark, self.root, self.schema, self.layout = spark, root.rstrip("/"), schema, layout
        self._last = self._load()
        if self._last is None:
            self._publish(Commit(0, None, tuple((p, base) for p in self._written(base)) if base else ()))

    # ---- manifest ---------------------------------------------------------------------------
    _MANIFEST = "commit long, batch long, part string, place string"

    def commit(self) -> Commit:
        """The last published state that this object has seen."""
        return self._last

    def _load(self) -> Commit | None:
        """The last published state (None: no table yet).  A manifest has a row per partition: bounded by the calendar
        or the number of buckets, so the driver may hold it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.schema(self._MANIFEST).parquet(f"{self.root}/manifest")
        last = rows.where(F.col("commit") == rows.select(F.max("commit")).scalar()).collect()
        if not last:
            return None
        return Commit(last[0]["commit"], last[0]["batch"], tuple((r["part"], r["place"]) for r in last if r["part"] is not None))

    def _publish(self, c: Commit) -> None:
        rows = [(c.number, c.batch, p, place) for p, place in c.parts] or [(c.number, c.batch, None, None)]
        self.spark.createDataFrame(rows, self._MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self._last = c

    def _place(self, number: int) -> str:
        return f"{self.root}/data/version={number}"

    def _typed(self) -> T.StructType:
        return T.StructType([*self.schema.fields, *[T.StructField(n, T.IntegerType()) for n in self.layout.names]])

    def _written(self, place: str) -> list[str]:
        """Partitions that have files in ``place``: their folder names, nothing is read."""
        depth = len(self.layout.names)
        files = self.spark.read.schema(self._typed()).parquet(place).inputFiles()
        return sorted({"/".join(f.split("/")[-1 - depth:-1]) for f in files})

    # ---- reading ----------------------------------------------------------------------------
    def read(self, only: Sequence[str] | None = None) -> DataFrame:
        """The table as last committed, with its partition columns; ``only``: these partitions."""
        parts = self.commit().parts
        if only is not None:
            wanted = set(only)
            parts = [x for x in parts if x[0] in wanted]
        # the base is one scan, all folders of later commits are another
        own = f"{self.root}/data"
        out = None
        for top in sorted({own if at.startswith(own) else at for _, at in parts}):
            paths = sorted(f"{at}/{part}" for part, at in parts if at.startswith(top))
            df = self.spark.read.schema(self._typed()).option("basePath", top).parquet(*paths).select(*self._typed().names)
            out = df if out is None else out.unionAll(df)
        return self.spark.createDataFrame([], self._typed()) if out is None else out

    # ---- changing ---------------------------------------------------------------------------
    def merge(self, updates: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None,
              keep: bool = False) -> bool:
        """Replace each partition that ``updates`` hits by ``combine(stored rows, updates)``; False if nothing was to do.

        ``batch`` numbers the batches of a feed (gaps are allowed): one that is not above the last
        committed batch was loaded before and changes nothing.  With ``keep`` the partitions stay and the rows of
        ``combine`` are added beside them (an insert)."""
        now = self.commit()
        if batch is not None and now.batch is not None and batch <= now.batch:
            return False
        number = now.number + 1
        feed_at = f"{self.root}/feed/version={number}"
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        # written once: the feed is evaluated once, whatever it is made of
        self.layout.add(updates).write.mode("overwrite").parquet(feed_at)
        feed = self.spark.read.parquet(feed_at)
        hits = ["/".join(f"{n}={r[n]}" for n in self.layout.names) for r in feed.select(*self.layout.names).distinct().collect()]
        if hits:
            stored = self.read(None if keep else hits)
            rows = combine(plain(stored), plain(feed)).select(*typed)
            write_table(self.layout.add(rows), self._place(number), self.layout.names)
        elif batch is None:
            return False
        written = self._written(self._place(number)) if hits else []
        kept = [x for x in now.parts if keep or x[0] not in set(hits)]
        self._publish(Commit(number, now.batch if batch is None else batch,
                             (*kept, *((p, self._place(number)) for p in written))))
        return True

    def purge(self, cutoff: dt.date) -> bool:
        """Rows before ``cutoff`` go.  Months that end before it leave the manifest unread; its own month is
        rewritten if it has older rows."""
        now, names = self.commit(), [f.name for f in self.schema.fields]
        edge = f"{YEAR}={cutoff.year}/{MONTH}={cutoff.month}"

        def month(part: str) -> tuple[int, ...]:
            return tuple(int(x.split("=")[1]) for x in part.split("/"))

        kept = [x for x in now.parts if month(x[0]) >= (cutoff.year, cutoff.month)]
        older = F.col(self.layout.date_col) < F.lit(cutoff)
        at_edge = self.read([edge])
        if at_edge.where(older).isEmpty():
            if len(kept) == len(now.parts):
                return False
            self._publish(Commit(now.number + 1, now.batch, tuple(kept)))
            return True
        place = self._place(now.number + 1)
        write_table(self.layout.add(plain(at_edge).where(~older).select(*names)), place, self.layout.names)
        self._publish(Commit(now.number + 1, now.batch, (*(x for x in kept if x[0] != edge), *((p, place) for p in self._written(place)))))
        return True
