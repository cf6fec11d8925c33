"""Helpers shared by the operators: intermediate tables, session settings, row selection."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch handed to a Python worker; documents can be long, so batches are small.
ARROW_ROWS = 512


def shipped(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), as --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_marketlens_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="py-files-"), "marketlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
    sc.addPyFile(path)
    sc._marketlens_shipped = True


def tuned(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches, and shuffle files that go
    when the job that wrote them has ended (intermediate tables are written, never recomputed)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shipped(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session that names
    none (tests) gets a scratch folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        path = tempfile.mkdtemp(prefix="llm-tables-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage (a lost executor costs only reads of finished files) and pins values such
    as generated row ids.  Every call writes to a fresh folder, so nothing is reused by name."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


# Tables written by `stored` and not yet released: the object and its folder.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Give back the disk of tables made by `stored` that nothing reads any more: each is overwritten
    with no rows."""
    for t in tables:
        found = _PATHS.pop(id(t), None)
        if found is not None:
            t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(found[1])


def text_of(col: str) -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
