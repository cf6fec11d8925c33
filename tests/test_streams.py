"""Streams against the same rows in one batch: repeated and late events, restarts, epochs with gaps."""
import datetime as dt
import json
import os

import pytest

from marketlens.schemas import FACT_DAILY_PRICES, FACT_NEWS_SENTIMENT
from marketlens.sources import storage
from marketlens.streaming import streams as stx

PRICES = "Ticker string, Date string, Close string, _load_seq long"


def price_table(spark, tmp_path):
    return storage.PartitionTable(spark, f"{tmp_path}/prices", FACT_DAILY_PRICES, storage.by_month("date"))


def closes(table):
    return {(r["ticker"], str(r["date"])): r["close"] for r in table.read().collect()}


def test_streamed_upsert_keeps_all_and_takes_gaps(spark, tmp_path):
    t = price_table(spark, tmp_path)
    run = stx.upsert_prices_batch(t)
    day = lambda x, c="1": spark.createDataFrame([("A", x, c)], "Ticker string, Date string, Close string")
    run(day("2024-01-02"), 0)
    run(day("2024-01-03"), 1)
    run(day("2024-02-05"), 7)
    assert set(closes(t)) == {("A", "2024-01-02"), ("A", "2024-01-03"), ("A", "2024-02-05")}
    before = t.commit()
    run(day("2024-01-03", "99"), 1)  # delivered again
    run(day("2024-02-05", "99"), 7)
    assert t.commit() == before and set(closes(t).values()) == {1.0}
    # another process finds the table as it was left
    again = price_table(spark, tmp_path)
    assert again.commit() == before and closes(again) == closes(t)


def drop(folder, name, rows):
    """A file of the feed; files are taken in the order of their times, which follow their names."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    when = 1_700_000_000 + 60 * int(name.split(".")[0])
    os.utime(folder / name, (when, when))


def test_streamed_upsert_of_files_restarts(spark, tmp_path):
    """Files arrive, the query ends, more files arrive, it starts again from its checkpoint."""
    t = price_table(spark, tmp_path)
    feed = tmp_path / "in"

    def run():
        s = spark.readStream.schema(PRICES).option("maxFilesPerTrigger", 1).json(str(feed))
        q = (s.writeStream.foreachBatch(stx.upsert_prices_batch(price_table(spark, tmp_path)))
             .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
        q.awaitTermination()

    drop(feed, "1.json", [{"Ticker": "A", "Date": "2024-01-02", "Close": "1", "_load_seq": 1}, {"Ticker": "A", "Date": "2024-01-02", "Close": "2", "_load_seq": 2}])
    drop(feed, "2.json", [{"Ticker": "A", "Date": "2024-01-03", "Close": "bad", "_load_seq": 1}, {"Ticker": "B", "Date": "2024-01-03", "Close": "3", "_load_seq": 1}])
    run()
    first = price_table(spark, tmp_path).commit()
    run()
    assert price_table(spark, tmp_path).commit() == first
    drop(feed, "3.json", [{"Ticker": "A", "Date": "2024-01-02", "Close": "5", "_load_seq": 9}, {"Ticker": "A", "Date": "2024-02-01", "Close": "6", "_load_seq": 1}])
    run()
    t = price_table(spark, tmp_path)
    assert closes(t) == {("A", "2024-01-02"): 5.0, ("B", "2024-01-03"): 3.0, ("A", "2024-02-01"): 6.0}
    assert t.commit().batch == 2


ARTICLES = "ticker string, published_at timestamp, title string, article_url string"


def article(day, url, title, hour=10):
    return {"ticker": "A", "published_at": f"2024-01-{day:02}T{hour:02}:00:00Z", "title": title, "article_url": url}


def test_streamed_dedupe_with_late_and_repeated_events(spark, tmp_path):
    """A URL that comes again within the watermark is dropped, also after a restart; state does not outlive the watermark;
    events behind the watermark are not taken."""
    feed, out = tmp_path / "in", tmp_path / "out"

    def run():
        s = spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", 1).json(str(feed))
        q = (stx.dedupe_articles(s, "2 days").writeStream.format("json").option("path", str(out))
             .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
        q.awaitTermination()

    def titles():
        return sorted(r["title"] for r in spark.read.schema(ARTICLES).json(str(out)).collect())

    drop(feed, "1.json", [article(1, "u1", "first"), article(1, "u2", "second")])
    drop(feed, "2.json", [article(1, "u1", "repeated", 12), article(2, "u3", "third")])
    run()
    assert titles() == ["first", "second", "third"]
    drop(feed, "3.json", [article(2, "u2", "repeated after a restart"), article(20, "u4", "much later")])
    run()
    assert titles() == ["first", "much later", "second", "third"]
    drop(feed, "4.json", [article(3, "u5", "too late"), article(21, "u1", "state is gone")])
    run()
    assert titles() == ["first", "much later", "second", "state is gone", "third"]
    run()
    assert len(titles()) == 5


def test_streamed_insert_of_articles(spark, tmp_path):
    t = storage.PartitionTable(spark, f"{tmp_path}/news", FACT_NEWS_SENTIMENT, storage.by_month("published_at"))
    run = stx.insert_articles_batch(t)
    raw = lambda *rows: spark.createDataFrame(rows, "ticker string, publishedAt string, title string, url string, description string")
    run(raw(("A", "2024-01-01T10:00:00Z", "one", "u1", "d"), ("A", "2024-01-01T11:00:00Z", "again", "u1", "d")), 0)
    run(raw(("A", "2024-03-01T10:00:00Z", "late copy", "u1", "d"), ("A", "2024-03-01T10:00:00Z", "two", "u2", None)), 3)
    run(raw(("A", "2024-03-01T10:00:00Z", "replayed", "u7", "d")), 3)
    assert sorted(r["title"] for r in t.read().collect()) == ["one", "two"]


@pytest.mark.parametrize("late", [0, 5])
def test_bars_of_a_stream_drop_what_is_behind_the_watermark(spark, tmp_path, late):
    feed = tmp_path / "in"
    tick = lambda day, price, k: {"ticker": "A", "ts": f"2024-01-{day:02}T10:00:00Z", "event_id": k, "price": price}
    drop(feed, "1.json", [tick(1, 1.0, 1), tick(1, 2.0, 2), tick(10, 3.0, 3)])
    drop(feed, "2.json", [tick(12, 4.0, 4)])
    drop(feed, "3.json", [tick(1 + late, 9.0, 5), tick(13, 4.0, 6)])
    drop(feed, "4.json", [tick(30, 5.0, 7)])
    s = spark.readStream.schema("ticker string, ts timestamp, event_id long, price double").option("maxFilesPerTrigger", 1).json(str(feed))
    q = (stx.ticks_to_bars(s, "5 days").writeStream.format("json").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    bars = {r["day"]: (r["open"], r["high"], r["close"], r["n_ticks"]) for r in spark.read.schema(
        "ticker string, day date, open double, high double, low double, close double, n_ticks long").json(f"{tmp_path}/out").collect()}
    first = bars[dt.date(2024, 1, 1)]
    assert first == (1.0, 2.0, 2.0, 2)  # the late tick of that day is behind the watermark
    assert (dt.date(2024, 1, 6) in bars) == (late == 5)
