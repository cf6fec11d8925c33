"""Market tables are built and read without sorting what a shuffle partition does not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.operators import timeseries as ts
from marketlens.plans import fundamentals as fu
from marketlens.plans import market as mk
from marketlens.sources import fixtures as fx

LINES = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
         "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, rows):
    return spark.createDataFrame([(o, n, p, s, q, e, 0.1, 0.05, "N", "O", d) for o, n, p, s, q, e, d in rows], LINES)


def test_daily_prices_sort_after_the_shuffle_only(spark):
    day = dt.datetime(2020, 3, 2)
    li = lines(spark, [(2, 1, 1, 7, 2.0, 20.0, day), (1, 2, 1, 7, 1.0, 30.0, day), (1, 2, 1, 7, 1.0, 5.0, day), (None, 9, 1, 7, 1.0, 8.0, day),
                       (2, 1, 1, 7, 2.0, 20.0, day), (3, 1, 1, None, 1.0, 4.0, day)])
    out = fx.daily_prices(li)
    below = plan(out).split("Exchange hashpartitioning")
    assert len(below) == 2 and "Aggregate" not in below[1] and "Sort" not in below[1]
    got = {r.ticker: r for r in out.collect()}
    assert (got["S7"].open, got["S7"].close, got["S7"].high, got["S7"].low, got["S7"].volume) == (8.0, 10.0, 30.0, 5.0, 7)
    assert got[None].close == 4.0 and len(got) == 2


def test_annual_rows_come_from_wide_groups(spark):
    days = [dt.datetime(2020, m, 5) for m in (1, 4, 7, 10)]
    li = lines(spark, [(i, 1, 1, s, 1.0, 100.0 + i, d) for s in (3, 4) for i, d in enumerate(days if s == 3 else days[:3])])
    st = fx.financial_statements(fx.quarterly_financials(li))
    assert not [x for x in plan(st).splitlines() if "Exchange hashpartitioning" in x and "metric_name" in x]
    got = {(r.ticker, r.statement_type, r.metric_name, str(r.report_date)): r.metric_value for r in st.collect()}
    assert len(got) == 7 * 21 + 21
    year = {k[2]: v for k, v in got.items() if k[1].endswith("_a")}
    assert {k[0] for k in got if k[1].endswith("_a")} == {"S3"} and "Operating Income" in year and "EBIT" not in year
    assert year["Total Revenue"] == pytest.approx(0.9 * 406) and year["Total Assets"] == 103.0


def test_long_means_add_up_short_frames(spark):
    rows = [("A", i, None if i % 11 == 3 else float(i * i % 97) / 7) for i in range(90)] + [("B", i, float("inf") if i == 4 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "ticker string, date int, close double")
    out = ts.long_means(df, "close", {"a": 6, "b": 24, "c": 7})
    assert out.columns == ["ticker", "date", "close", "a", "b", "c"] and "-23" not in plan(out)
    want = df.select("*", *[ts.rolling("close", n).alias(c) for c, n in (("a", 6), ("b", 24), ("c", 7))])
    near = lambda t: {(r.ticker, r.date): [x if x is None else pytest.approx(x) for x in r[2:]] for r in t.collect()}
    assert near(want) == {k: list(v) for k, v in ((((r.ticker, r.date)), r[2:]) for r in out.collect())}


def test_steps_meet_days_with_one_sort(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    px = spark.createDataFrame([("A", day(n), float(n)) for n in range(0, 60, 5)] + [(None, day(1), 1.0)], "ticker string, date date, close double")
    src = spark.createDataFrame([("A", day(n), 3, True, float(n)) for n in (2, 12, 22, 32, 42)] + [("A", day(7), 9, False, 99.0)],
                                "ticker string, date date, priority int, sum4 boolean, value double")
    out = mk.step_values(px, src, "eps")
    assert sum(" Sort [" in x for x in plan(out).splitlines()) == 1
    got = [r.eps for r in out.where("ticker = 'A'").orderBy("date").collect()]
    assert got == [None, 2.0, 2.0, 14.0, 14.0, 36.0, 36.0, 68.0, 68.0, 108.0, 108.0, 108.0]
    assert out.where("ticker is null").first()["eps"] is None


def test_asof_carries_key_and_date_once(spark):
    left = spark.createDataFrame([("A", 5, 1.0), ("B", 5, None), (None, 5, 2.0)], "ticker string, day int, x double")
    right = spark.createDataFrame([("A", 4, 7.0), ("A", 6, 8.0), (None, 5, 9.0)], "ticker string, date int, v double")
    out = ts.asof_backward(left, right, ["v"], left_on="day")
    assert "struct(ticker" not in plan(out) and out.columns == ["ticker", "day", "x", "v"]
    assert {tuple(r) for r in out.collect()} == {("A", 5, 1.0, 7.0), ("B", 5, None, None), (None, 5, 2.0, 9.0)}
    only = ts.asof_backward(left.select("ticker", "day"), right, ["v"], left_on="day")
    assert {tuple(r) for r in only.collect()} == {("A", 5, 7.0), ("B", 5, None), (None, 5, 9.0)}


def test_statement_view_does_not_sort_statements(spark):
    rows = [("A", f"20{y}-12-31", "income_q", m, 1e6 * y) for y in range(10, 16) for m in ("EBIT", "Net Income")]
    rows += [("B", None, "income_q", "EBIT", 1.0), (None, "2010-12-31", "income_q", "EBIT", 1.0), ("A", "2030-12-31", "balance_q", "Cash", 1.0)]
    st = spark.createDataFrame(rows, "ticker string, report_date string, statement_type string, metric_name string, metric_value double") \
        .withColumn("report_date", F.to_date("report_date"))
    out = fu.statement_view(st, "income", 2)
    assert "SortMergeJoin" not in plan(out) and "ShuffledHashJoin" in plan(out)
    assert sorted((r.ticker, r.metric_name, r.report_date.year, r.value_m) for r in out.collect()) == [
        ("A", m, y, float(y - 2000)) for m in ("EBIT", "Net Income") for y in (2014, 2015)]


def test_wide_prices_are_one_aggregate(spark):
    from marketlens import catalog

    out = catalog.QUERIES["wide_to_long_all"](spark, "/root/testdata/sf0.001")
    assert "pivotfirst" not in plan(out) and plan(out).count("Exchange hashpartitioning") == 1
