"""The four loads, each from work list to purge.

A load reads its source once: rows that the work list asks for are checked, marked with the first rule that
they break and written once; the good ones are merged by partition into the table, the others are
returned as rejects.  Counts are observed while the rows are written.  A load that runs again on the same
input finds nothing to do and publishes nothing.  "Today" is ``as_of``, a date."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import snapshot as snap
from ..plans.scoring import Scorer, score_batches
from ..schemas import FACT_COMPANY_SUMMARY, FACT_FINANCIAL_STATEMENTS, FACT_NEWS_SENTIMENT, KEYS
from ..session import checkpoint_dir
from . import ingest as ing
from . import profile as pr
from .storage import PartitionTable, plain

SUMMARY_DAYS, PRICE_DAYS, STATEMENT_DAYS, NEWS_DAYS = 5 * 365, 365, 5 * 365, 30  # fixed values: days that are kept
MODEL_COLUMNS = ["predicted_default_prob", "peer_cluster_id"]


@dataclass
class Loaded:
    """What a load did: rows that it looked at, took and refused; the refused ones; whether the table changed."""

    read: int
    good: int
    rejected: int
    rejects: DataFrame
    changed: bool


def _checked(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, dict]:
    """(good rows, rejects with their first broken rule, counts) of rows that are evaluated and written once."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    seen = Observation(f"load-{uuid.uuid4().hex}")
    marked = rows.withColumn("reason", reason).observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason").isNull()).alias("good"))
    spark: SparkSession = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}/load"
    marked.write.parquet(path)
    stored = spark.read.schema(marked.schema).parquet(path)
    return stored.where(F.col("reason").isNull()).drop("reason"), stored.where(F.col("reason").isNotNull()), seen.get


def _loaded(counts: dict, rejects: DataFrame, changed: bool) -> Loaded:
    return Loaded(counts["read"], counts["good"], counts["read"] - counts["good"], rejects, changed)


def _number(name: str) -> Column:
    return F.nanvl(F.expr(f"try_cast(cast({name} as string) as double)"), F.lit(None).cast("double"))


def _day(as_of: dt.date) -> Column:
    return S.as_date(as_of)


def load_prices(source: DataFrame, table: PartitionTable, universe: DataFrame, as_of: dt.date, keep_days: int = PRICE_DAYS) -> Loaded:
    """S14's universe, S12, S13b, S2, S7, S11, S22: daily prices of the tickers that are behind.

    ``source`` has ticker, Date, Open, High, Low, Close and Volume, as text or numbers; rows outside a ticker's
    fetch window [start, today) are not its feed.  A key that the feed holds twice needs ``_load_seq``."""
    ing.require(source, ["ticker", "Date", "Close"], "price feed")
    work = ing.price_worklist(universe, ing.high_water_mark(plain(table.read())), _day(as_of), keep_days)
    rows = source.withColumn("_date", F.expr("try_cast(`Date` as date)")).join(work.select("ticker", "start", "end"), "ticker")
    rows = rows.where(F.col("_date").isNull() | ((F.col("_date") >= F.col("start")) & (F.col("_date") < F.col("end"))))
    good, rejects, counts = _checked(rows.drop("start", "end"), {"date": F.col("_date").isNotNull(), "close": _number("`Close`").isNotNull()})
    feed = ing.normalise_prices(good.drop("_date"))
    if "_load_seq" in source.columns:
        feed = snap.dedupe(ing.normalise_prices(good, keep=["_load_seq"]), KEYS["fact_daily_prices"], [F.col("_load_seq")]).drop("_load_seq")
    changed = table.merge(feed, lambda old, new: ing.upsert(old, new, KEYS["fact_daily_prices"]))
    changed |= table.purge(as_of - dt.timedelta(days=keep_days))
    return _loaded(counts, rejects, changed)


def load_statements(wide: DataFrame, table: PartitionTable, universe: DataFrame, as_of: dt.date, buffer_days: int = 60,
                    keep_days: int = STATEMENT_DAYS) -> Loaded:
    """S14's universe, S12, S13c, S3, S7, S11, S22: statements (ticker, statement_type, metric_name, one column per report
    date) of the tickers whose latest report is more than ``buffer_days`` old.

    Dates on or before a ticker's high-water mark or before the cutoff are not its feed; a value that is there but is no
    number is refused, an absent one is no row."""
    keys = ["ticker", "statement_type", "metric_name"]
    ing.require(wide, keys, "statement feed")
    dates = [c for c in wide.columns if c not in keys]
    hwm = ing.high_water_mark(plain(table.read()), "report_date")
    work = ing.statement_worklist(universe, hwm, _day(as_of), buffer_days)
    cutoff = as_of - dt.timedelta(days=keep_days)
    long = wide.unpivot(keys, dates, "report_date_s", "raw_value").where(F.col("raw_value").isNotNull())
    rows = long.withColumn("report_date", F.expr("try_cast(report_date_s as date)")).join(work, "ticker")
    rows = rows.where((F.col("report_date").isNull() | (F.col("report_date") >= F.lit(cutoff)))
                      & (F.col("hwm").isNull() | F.col("report_date").isNull() | (F.col("report_date") > F.col("hwm")))).drop("hwm")
    good, rejects, counts = _checked(rows, {
        "date": F.col("report_date").isNotNull(), "metric": F.trim("metric_name") != "", "value": _number("raw_value").isNotNull()})
    feed = good.select("ticker", "report_date", "statement_type", F.trim("metric_name").alias("metric_name"),
                       _number("raw_value").alias("metric_value"))
    key = KEYS["fact_financial_statements"]
    # labels that differ in space only are one metric: its greatest value, whatever the order of the rows
    feed = feed.groupBy(*key).agg(F.max("metric_value").alias("metric_value")).select(*FACT_FINANCIAL_STATEMENTS.names)
    changed = table.merge(feed, lambda old, new: ing.upsert(old, new, key))
    changed |= table.purge(cutoff)
    return _loaded(counts, rejects, changed)


def load_summaries(profile: DataFrame, statements: DataFrame, table: PartitionTable, dim: PartitionTable, universe: DataFrame,
                   as_of: dt.date, keep_days: int = SUMMARY_DAYS) -> Loaded:
    """S14's universe, S12, S13a, S4, S5, F1, F2, S21, S8, S9, S11, S22: one profile row per company into the dimension and the
    fact table of the day.

    The profile is read once and written once; both sinks read what was written.  The two model columns carry the
    last value that the ticker has, each on its own; on a conflict the stored ones stay."""
    ing.require(profile, ["ticker", "quoteType"], "profile")
    stored = plain(table.read())
    work = ing.summary_worklist(universe, ing.high_water_mark(stored, "date_updated"), _day(as_of)).select("ticker")
    good, rejects, counts = _checked(profile.join(work, "ticker"), {"kind": F.col("quoteType") == pr.EQUITY})
    fact = pr.company_metrics(good, statements, as_of)
    last = stored.groupBy("ticker").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date_updated"))).alias(c) for c in MODEL_COLUMNS])
    fact = fact.join(last, "ticker", "left")
    fact = fact.select([(F.col(f.name) if f.name in fact.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in FACT_COMPANY_SUMMARY.fields if f.name in stored.columns])
    changed = dim.merge(pr.profile_dim(good), lambda old, new: ing.upsert_keep_logo(old, new))
    changed |= table.merge(fact, lambda old, new: ing.upsert_protected(old, new, KEYS["fact_company_summary"]))
    changed |= table.purge(as_of - dt.timedelta(days=keep_days))
    return _loaded(counts, rejects, changed)


def load_news(articles: DataFrame, table: PartitionTable, as_of: dt.date, scorer: Scorer | None = None, keep_days: int = NEWS_DAYS,
              order: Sequence[str] = ("published_at", "title")) -> Loaded:
    """Raw articles whose URL is not stored yet; the first one per URL in ``order`` counts.

    Only new articles are scored (with a scorer) and added beside the stored ones; no stored partition is rewritten.
    Articles older than the cutoff are neither added nor kept."""
    ing.require(articles, ["publishedAt", "title", "url"], "article feed")
    cutoff = as_of - dt.timedelta(days=keep_days)
    when = ing.article_time("publishedAt")
    good, rejects, counts = _checked(articles, {
        "publishedAt": F.col("publishedAt").isNotNull(), "title": F.col("title").isNotNull(), "url": F.col("url").isNotNull(),
        "time": when.isNotNull()})
    batch = ing.normalise_articles(good).where(F.col("published_at") >= F.lit(cutoff))
    batch = snap.dedupe(batch, ["article_url"], [F.col(c) for c in order], keep="first")
    new = batch.join(plain(table.read()).select("article_url"), "article_url", "left_anti")
    new = new.withColumn("sentiment_label", F.lit(None).cast("string")).withColumn("sentiment_score", F.lit(None).cast("double"))
    if scorer is not None:
        new = score_batches(new, scorer).drop("failure", "scored")
    changed = table.merge(new.select(*FACT_NEWS_SENTIMENT.names), lambda old, fresh: fresh, keep=True)
    changed |= table.purge(cutoff)
    return _loaded(counts, rejects, changed)
