"""pandas goldens for the window operators (re-stated formulas on small frames)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators import timeseries as ts


def _series(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def _frame(n=700, tickers=("A", "B", "C"), seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for t in tickers:
        px = 100 + np.cumsum(rng.normal(0, 1, n))
        d = pd.date_range("2020-01-01", periods=n, freq="D")
        out += [(t, d[i].date(), float(px[i])) for i in range(n)]
    return out


def test_ewm_matches_pandas_adjust_false(spark):
    rows = _frame()
    df = _series(spark, rows)
    got = ts.ewm(df, {"e20": ("close", ts.span_alpha(20)), "r": ("close", 1 / 14)}).toPandas()
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "close"])
    for t, g in pdf.groupby("ticker"):
        g = g.sort_values("date")
        exp20 = g["close"].ewm(span=20, adjust=False).mean().to_numpy()
        exp14 = g["close"].ewm(alpha=1 / 14, adjust=False).mean().to_numpy()
        mine = got[got.ticker == t].sort_values("date")
        assert np.allclose(mine["e20"].to_numpy(), exp20, rtol=1e-11, atol=0)
        assert np.allclose(mine["r"].to_numpy(), exp14, rtol=1e-11, atol=0)


def test_ewm_carry_across_many_blocks(spark):
    # alpha 0.5 -> block of ~721 rows; 3000 rows cross several blocks
    rows = _frame(n=3000, tickers=("X",), seed=7)
    got = ts.ewm(_series(spark, rows), {"e": ("close", 0.5)}).toPandas().sort_values("date")
    exp = pd.Series([r[2] for r in rows]).ewm(alpha=0.5, adjust=False).mean().to_numpy()
    assert np.allclose(got["e"].to_numpy(), exp, rtol=1e-11)


def test_rolling_semantics(spark):
    rows = [("A", pd.Timestamp("2021-01-0%d" % i).date(), v) for i, v in
            enumerate([1.0, None, 3.0, 4.0, 5.0, None, 7.0], start=1)]
    df = _series(spark, rows)
    got = df.select("date", ts.rolling("close", 4, "sum", 4).alias("full"),
                    ts.rolling("close", 4, "mean", 1).alias("mp1"),
                    ts.rolling("close", 4, "std", 1).alias("sd"),
                    ts.pct_change("close", 1).alias("pc"),
                    ts.ffill("close").alias("ff"),
                    ts.cummax("close").alias("cm")).orderBy("date").toPandas()
    s = pd.Series([r[2] for r in rows], dtype="float64")
    pd.testing.assert_series_equal(got["full"], s.rolling(4, min_periods=4).sum(), check_names=False)
    pd.testing.assert_series_equal(got["mp1"], s.rolling(4, min_periods=1).mean(), check_names=False)
    pd.testing.assert_series_equal(got["sd"], s.rolling(4, min_periods=1).std(), check_names=False)
    pd.testing.assert_series_equal(got["pc"], s.pct_change(1, fill_method=None), check_names=False)
    pd.testing.assert_series_equal(got["ff"], s.ffill(), check_names=False)
    pd.testing.assert_series_equal(got["cm"], s.cummax().ffill(), check_names=False)


def test_pct_change_zero_base_is_null(spark):
    df = spark.createDataFrame([("A", 1, 0.0), ("A", 2, 5.0), ("A", 3, -2.0)], "ticker string, date int, x double")
    got = [r.pc for r in df.select(ts.pct_change("x", 1).alias("pc")).orderBy(F.col("date")).collect()]
    assert got[0] is None and got[1] is None and got[2] == pytest.approx(-1.4)


def test_asof_backward_never_looks_ahead(spark):
    left = spark.createDataFrame([("A", "2021-01-05"), ("A", "2021-01-01"), ("B", "2021-01-03"), ("C", "2021-01-03")],
                                 "ticker string, d string").select("ticker", F.col("d").cast("date").alias("report_date"))
    right = spark.createDataFrame([("A", "2021-01-02", 1.0), ("A", "2021-01-05", 2.0), ("B", "2021-01-04", 3.0)],
                                  "ticker string, d string, close double").select(
        "ticker", F.col("d").cast("date").alias("date"), "close")
    got = {(r.ticker, str(r.report_date)): r.close for r in
           ts.asof_backward(left, right, ["close"], left_on="report_date").collect()}
    assert got == {("A", "2021-01-05"): 2.0, ("A", "2021-01-01"): None, ("B", "2021-01-03"): None,
                   ("C", "2021-01-03"): None}


def test_nearest_prefers_earlier_on_ties(spark):
    df = spark.createDataFrame([("A", "2021-01-01", 1.0), ("A", "2021-01-03", 3.0), ("A", "2021-01-10", 9.0)],
                               "ticker string, d string, close double").select(
        "ticker", F.col("d").cast("date").alias("date"), "close")
    got = ts.nearest(df, {"t": F.lit("2021-01-02").cast("date"), "u": F.lit("2021-01-09").cast("date")}, ["close"])
    res = {r.period: r.close for r in got.collect()}
    assert res == {"t": 1.0, "u": 9.0}


def test_align_calendar_forward_fills(spark):
    df = spark.createDataFrame([("A", "2021-01-01", 1.0), ("A", "2021-01-04", 4.0), ("B", "2021-01-02", 2.0),
                                ("B", "2021-01-03", 3.0)], "ticker string, d string, close double").select(
        "ticker", F.col("d").cast("date").alias("date"), "close")
    got = ts.align_calendar(df, ["close"], df, end=F.lit("2021-01-04").cast("date")).toPandas()
    got["date"] = got["date"].astype(str)
    a = dict(zip(got[got.ticker == "A"].date, got[got.ticker == "A"].close))
    b = dict(zip(got[got.ticker == "B"].date, got[got.ticker == "B"].close))
    assert a == {"2021-01-01": 1.0, "2021-01-02": 1.0, "2021-01-03": 1.0, "2021-01-04": 4.0}
    assert b == {"2021-01-02": 2.0, "2021-01-03": 3.0, "2021-01-04": 3.0}


def test_block_size_guard():
    with pytest.raises(ValueError):
        ts._block_size([0.9, 0.0005])
    assert ts._block_size([2 / 21]) == math.floor(500 / -math.log(1 - 2 / 21))
