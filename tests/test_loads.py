"""The four loads: what they take, refuse and change, and that a second run on the same input changes nothing."""
import datetime as dt

import pytest

from marketlens.plans.scoring import WordScorer
from marketlens.schemas import (DIM_COMPANY, FACT_COMPANY_SUMMARY, FACT_DAILY_PRICES, FACT_FINANCIAL_STATEMENTS,
                                FACT_NEWS_SENTIMENT)
from marketlens.sources import loads, storage


def d(text):
    return dt.date.fromisoformat(text)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, tmp_path, name, schema, layout):
    return storage.PartitionTable(spark, f"{tmp_path}/{name}", schema, layout)


def universe(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def test_prices(spark, tmp_path):
    t = table(spark, tmp_path, "p", FACT_DAILY_PRICES, storage.by_month("date"))
    schema = "ticker string, Date string, Open string, High string, Low string, Close string, Volume string"
    feed = [("A", "2024-03-04", "1", "2", "1", "1.5", "10"), ("A", "2024-03-05", "1", "2", "1", "n/a", "10"),
            ("A", "soon", "1", "2", "1", "1", "10"), ("B", "2022-01-03", "1", "2", "1", "1", "1"), ("B", "2024-03-06", "x", None, "1", "3", "NaN"),
            ("C", "2024-03-06", "1", "2", "1", "9", "1"), (None, "2024-03-06", "1", "2", "1", "9", "1"), ("A", "2024-03-07", "1", "1", "1", "7", "7")]
    source, today = spark.createDataFrame(feed, schema), d("2024-03-07")  # a Thursday
    out = loads.load_prices(source, t, universe(spark, "A", "B"), today)
    assert (out.read, out.good, out.rejected, out.changed) == (4, 2, 2, True)
    assert sorted(r["reason"] for r in out.rejects.collect()) == ["close", "date"]
    want = [("A", d("2024-03-04"), 1.0, 2.0, 1.0, 1.5, 10), ("B", d("2024-03-06"), None, None, 1.0, 3.0, 0)]
    assert rows(storage.plain(t.read())) == want  # not before the cutoff, not of today, not of tickers outside the universe
    before = t.commit()
    again = loads.load_prices(source, t, universe(spark, "A", "B"), today)
    assert not again.changed and t.commit() == before and rows(storage.plain(t.read())) == want
    # a ticker whose last row is a day old is left alone, one that is behind goes on after its last row
    more = spark.createDataFrame([("A", "2024-03-04", "9", "9", "9", "9", "9"), ("A", "2024-03-06", "2", "2", "2", "2", "2"),
                                  ("B", "2024-03-06", "9", "9", "9", "9", "9")], schema)
    loads.load_prices(more, t, universe(spark, "A", "B"), today)
    assert rows(storage.plain(t.read())) == [want[0], ("A", d("2024-03-06"), 2.0, 2.0, 2.0, 2.0, 2), want[1]]
    # a year later the old rows go
    assert loads.load_prices(more, t, universe(spark, "A"), d("2025-03-06")).changed
    assert [r[1] for r in rows(storage.plain(t.read()))] == [d("2024-03-06"), d("2024-03-06")]


def test_prices_with_a_key_twice(spark, tmp_path):
    t = table(spark, tmp_path, "p", FACT_DAILY_PRICES, storage.by_month("date"))
    twice = spark.createDataFrame([("A", "2024-03-04", "1", 1), ("A", "2024-03-04", "2", 2)], "ticker string, Date string, Close string, _load_seq long")
    with pytest.raises(Exception, match="occurs twice"):
        loads.load_prices(twice.drop("_load_seq"), t, universe(spark, "A"), d("2024-03-07"))
    assert t.read().count() == 0
    loads.load_prices(twice, t, universe(spark, "A"), d("2024-03-07"))
    assert [r["close"] for r in t.read().collect()] == [2.0]
    with pytest.raises(ValueError, match="lacks the columns ticker, Close"):
        loads.load_prices(spark.createDataFrame([("x",)], "Date string"), t, universe(spark, "A"), d("2024-03-07"))


def test_statements(spark, tmp_path):
    t = table(spark, tmp_path, "s", FACT_FINANCIAL_STATEMENTS, storage.by_month("report_date"))
    wide = spark.createDataFrame(
        [("A", "income_q", " Sales ", "1", "2", "0.5", "x"), ("A", "income_q", "EBIT", None, "n.m.", "3", None), ("B", "income_q", "Sales", "5", None, None, None),
         ("A", "income_q", "  ", "1", None, None, None), ("Z", "income_q", "Sales", "5", None, None, None)],
        ["ticker", "statement_type", "metric_name", "2023-12-31", "2024-03-31", "2015-01-01", "total"])
    out = loads.load_statements(wide, t, universe(spark, "A", "B"), d("2024-07-01"))
    assert sorted(r["reason"] for r in out.rejects.collect()) == ["date", "metric", "value"] and (out.read, out.good) == (6, 3)
    want = [("A", d("2023-12-31"), "income_q", "Sales", 1.0), ("A", d("2024-03-31"), "income_q", "Sales", 2.0), ("B", d("2023-12-31"), "income_q", "Sales", 5.0)]
    assert rows(storage.plain(t.read())) == want
    assert not loads.load_statements(wide, t, universe(spark, "A", "B"), d("2024-07-01")).changed
    late = wide.withColumnRenamed("2023-12-31", "2024-06-30")
    assert loads.load_statements(late, t, universe(spark, "A", "B"), d("2024-05-01")).read == 1  # A is fresh, B is behind
    loads.load_statements(late, t, universe(spark, "A", "B"), d("2024-09-01"))
    assert {(r[0], r[1]) for r in rows(storage.plain(t.read()))} == {(w[0], w[1]) for w in want} | {("A", d("2024-06-30")), ("B", d("2024-06-30"))}


def test_summaries(spark, tmp_path):
    t = table(spark, tmp_path, "f", FACT_COMPANY_SUMMARY, storage.by_month("date_updated"))
    dim = table(spark, tmp_path, "d", DIM_COMPANY, storage.by_bucket("ticker", 4))
    names = FACT_COMPANY_SUMMARY.names
    blank = dict.fromkeys(names)
    old = [blank | {"ticker": "A", "date_updated": d("2024-01-01"), "peer_cluster_id": 3},
           blank | {"ticker": "A", "date_updated": d("2024-02-01"), "predicted_default_prob": 0.2},
           blank | {"ticker": "A", "date_updated": d("2015-02-01"), "predicted_default_prob": 0.9}]
    t.merge(spark.createDataFrame([tuple(r[n] for n in names) for r in old], FACT_COMPANY_SUMMARY), lambda a, b: b)
    dim.merge(spark.createDataFrame([("A", "Old", "logo", "S", None), ("B", "Bee", "", "S", None)], DIM_COMPANY), lambda a, b: b)
    profile = spark.createDataFrame(
        [("A", "EQUITY", "Anew", "http://new", 0.0, 7.0, 9.0, "12", 150.0), ("B", "EQUITY", "Bee", "http://b", None, 0.0, 0.0, "NaN", None),
         ("E", "ETF", "Fund", "x", 1.0, 1.0, 1.0, "1", 1.0), ("X", "EQUITY", "Out", "x", 1.0, 1.0, 1.0, "1", 1.0)],
        "ticker string, quoteType string, longName string, logo_url string, currentPrice double, regularMarketPrice double, "
        "previousClose double, marketCap string, debtToEquity double")
    st = spark.createDataFrame([("A", d(f"{y}-12-31"), "income_a", " REVENUES", 100.0 * 2 ** (y - 2020)) for y in range(2020, 2024)],
                               FACT_FINANCIAL_STATEMENTS)
    out = loads.load_summaries(profile, st, t, dim, universe(spark, "A", "B", "E"), d("2024-03-01"))
    assert (out.read, out.good, out.changed) == (3, 2, True) and [r["ticker"] for r in out.rejects.collect()] == ["E"]
    got = {(r["ticker"], r["date_updated"]): r for r in t.read().collect()}
    assert set(got) == {("A", d("2024-01-01")), ("A", d("2024-02-01")), ("A", d("2024-03-01")), ("B", d("2024-03-01"))}
    a, b = got["A", d("2024-03-01")], got["B", d("2024-03-01")]
    assert (a["price"], a["market_cap"], a["de_ratio"], a["predicted_default_prob"], a["peer_cluster_id"]) == (7.0, 12.0, 1.5, 0.2, 3)
    assert a["revenue_cagr_3y"] == pytest.approx(1.0) and (b["price"], b["market_cap"], b["peer_cluster_id"]) == (0.0, None, None)
    assert {r["ticker"]: (r["company_name"], r["logo_url"]) for r in dim.read().collect()} == {"A": ("Anew", "logo"), "B": ("Bee", "http://b")}
    before = (t.commit(), dim.commit())
    assert not loads.load_summaries(profile, st, t, dim, universe(spark, "A", "B", "E"), d("2024-03-01")).changed
    assert (t.commit(), dim.commit()) == before


def test_news(spark, tmp_path):
    class Broken:
        def score(self, texts):
            raise RuntimeError("no model")

    schema = "ticker string, publishedAt string, title string, url string, description string"
    raw = [("A", "2024-03-01T10:00:00Z", "record", "u1", "profits"), ("A", "2024-03-01T09:00:00Z", "loss", "u1", "fraud"),
           ("A", "2024-03-02T10:00:00", "plain", "u2", ""), ("B", "soon", "t", "u3", "d"), ("B", None, "t", "u4", "d"),
           ("B", "2024-03-02T10:00:00Z", None, "u5", "d"), ("B", "2024-01-02T10:00:00Z", "t", "u6", "d")]
    t = table(spark, tmp_path, "n", FACT_NEWS_SENTIMENT, storage.by_month("published_at"))
    feed, today = spark.createDataFrame(raw, schema), d("2024-03-03")
    out = loads.load_news(feed, t, today, WordScorer())
    assert (out.read, out.good) == (7, 4) and sorted(r["reason"] for r in out.rejects.collect()) == ["publishedAt", "time", "title"]
    got = {r["article_url"]: (r["title"], r["sentiment_label"], r["sentiment_score"]) for r in t.read().collect()}
    assert got == {"u1": ("loss", "negative", 1.0), "u2": ("plain", None, None)}
    before = t.commit()
    assert not loads.load_news(feed, t, today, WordScorer()).changed and t.commit() == before
    more = spark.createDataFrame([("A", "2024-03-02T11:00:00Z", "again", "u1", "x"), ("A", "2024-03-02T12:00:00Z", "new", "u9", "x")], schema)
    loads.load_news(more, t, today, Broken())
    got = {r["article_url"]: (r["title"], r["sentiment_label"], r["sentiment_score"]) for r in t.read().collect()}
    assert got["u1"][0] == "loss" and got["u9"] == ("new", "neutral", 0.0)
    assert loads.load_news(more, t, d("2024-04-01"), None).changed  # 30 days later only March 2 is left
    assert {r["article_url"] for r in t.read().collect()} == {"u2", "u9"}


def test_empty_feeds(spark, tmp_path):
    t = table(spark, tmp_path, "p", FACT_DAILY_PRICES, storage.by_month("date"))
    out = loads.load_prices(spark.createDataFrame([], "ticker string, Date string, Close string"), t, universe(spark, "A"), d("2024-03-07"))
    assert (out.read, out.rejected, out.changed) == (0, 0, False) and t.commit().number == 0
    assert out.rejects.count() == 0
