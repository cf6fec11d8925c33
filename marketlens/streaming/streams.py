"""Structured Streaming forms of the incremental loads (ST1-ST3).

ST1  prices arriving as files -> ``foreachBatch`` running the normaliser (S2) and the keyed
     upsert (S7) by partition into the price table.
ST2  articles -> watermark + ``dropDuplicatesWithinWatermark(article_url)`` (N6 as a stream), or
     ``foreachBatch`` with an insert of unknown URLs.
ST3  ticks -> daily OHLC bars per ticker with a tumbling 1-day window and a watermark.

The same functions work on batch DataFrames (the batch form is checked against DuckDB; the
stream form against the batch result with ``trigger(availableNow=True)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import snapshot as snap
from ..schemas import FACT_NEWS_SENTIMENT, KEYS
from ..sources import ingest as ing
from ..sources.storage import PartitionTable, plain


def ticks(events: DataFrame, supplier: DataFrame | None = None, n_tickers: int | None = None) -> DataFrame:
    """Map the events table to price ticks: ticker 'S' + user_id mod (number of suppliers)."""
    if n_tickers is None:
        n = supplier.select(F.count(F.lit(1))).scalar()
    else:
        n = F.lit(n_tickers)
    return events.where(F.col("value").isNotNull()).select(
        F.concat(F.lit("S"), (F.col("user_id") % n).cast("string")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def ticks_to_bars(t: DataFrame, watermark: str | None = None) -> DataFrame:
    """Daily OHLC bars: tumbling 1-day windows per ticker.  open/close are the first/last tick
    in (ts, event_id) order (min_by/max_by, partial aggregation before the shuffle)."""
    if watermark:
        t = t.withWatermark("ts", watermark)
    o = F.struct("ts", "event_id")
    g = t.groupBy("ticker", F.window("ts", "1 day").alias("w")).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.count(F.lit(1)).alias("n_ticks"))
    return g.select("ticker", F.to_date(F.col("w.start")).alias("day"), "open", "high", "low", "close", "n_ticks")


def dedupe_articles(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """ST2: first article per URL within the watermark (N6 in streaming form)."""
    return stream.withWatermark("published_at", watermark).dropDuplicatesWithinWatermark(["article_url"])


def upsert_prices_batch(table: PartitionTable):
    """ST1: the function for ``writeStream.foreachBatch``: the micro-batch is normalised (S2) and merged by partition
    into the table (S7).  The epoch goes into the table's commit, so a batch that is delivered again after a
    failure changes nothing, and numbers may have gaps.  Within a batch the later ``_load_seq`` of a key wins."""
    key = KEYS["fact_daily_prices"]

    def run(batch: DataFrame, epoch_id: int) -> None:
        seq = [c for c in ("_load_seq",) if c in batch.columns]
        clean = ing.normalise_prices(batch, keep=seq)
        if seq:
            clean = snap.dedupe(clean, key, [F.col("_load_seq")]).drop("_load_seq")
        table.merge(clean, lambda old, new: ing.upsert(old, new, key), batch=epoch_id)

    return run


def insert_articles_batch(table: PartitionTable):
    """ST2 into a table: articles whose URL is stored already, or that the batch repeats, are left out."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        first = snap.dedupe(ing.normalise_articles(batch), KEYS["fact_news_sentiment"], [F.col("published_at"), F.col("title")], "first")
        new = first.join(plain(table.read()).select("article_url"), "article_url", "left_anti")
        blank = {f.name: F.lit(None).cast(f.dataType) for f in FACT_NEWS_SENTIMENT.fields if f.name not in new.columns}
        table.merge(new.withColumns(blank), lambda old, fresh: fresh, batch=epoch_id, keep=True)

    return run
