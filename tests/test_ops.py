"""Goldens for scoring, risk features, upserts, valuation draws, news and streaming."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.operators import snapshot as snap
from marketlens.plans import fundamentals as fu
from marketlens.plans import news as nw
from marketlens.plans import risk
from marketlens.plans import valuation as va
from marketlens.schemas import RISK_FEATURE_COLUMNS
from marketlens.sources import ingest as ing


def test_scoring_buckets(spark):
    df = spark.createDataFrame([(-1.0, None, None), (5e9, 0.4, 8.0), (1e10, 2.0, 25.0), (2e12, 2.5, 30.0),
                                (None, 2.1, 20.0)], "market_cap double, beta double, ev_ebitda double")
    got = df.select(S.company_size("market_cap").alias("s"), S.volatility_level("beta").alias("v"),
                    S.valuation_model("ev_ebitda").alias("m")).withColumn("p", S.stock_profile("v", "m")).collect()
    assert [r.s for r in got] == [None, "Small Cap", "Mid Cap", "Mega Cap", None]
    assert [r.v for r in got] == ["N/A", "Core", "Growth", "Hyper Growth", "Hyper Growth"]
    assert [r.m for r in got] == ["N/A", "Cheap", "Fair Value", "Expensive", "Fair Value"]
    assert [r.p for r in got] == ["Needs Review", "Hidden Value Gem", "Core Holding", "High-Flyer", "Promising Growth"]


def _pandas_features(df):
    """Re-statement of the 27-feature formulas in pandas (for a few of them)."""
    df = df.sort_values(["ticker", "report_date"]).reset_index(drop=True)
    g = df.groupby("ticker")
    out = pd.DataFrame({"ticker": df.ticker, "report_date": df.report_date})
    cl = df["Current Liabilities"].replace(0, np.nan)
    out["current_ratio"] = df["Current Assets"] / cl
    om = df["EBIT"] / df["Total Revenue"].replace(0, np.nan)
    out["change_in_operating_margin"] = om.groupby(df.ticker).diff(4)
    out["total_revenue_yoy_growth"] = g["Total Revenue"].pct_change(4, fill_method=None)
    out["count_negative_net_income_12q"] = (df["Net Income"] < 0).astype(int).groupby(df.ticker).transform(
        lambda x: x.rolling(12, min_periods=1).sum())
    out["cv_operating_margin"] = (om.groupby(df.ticker).transform(lambda x: x.rolling(4, min_periods=1).std())
                                  / om.groupby(df.ticker).transform(lambda x: x.rolling(4, min_periods=1).mean())
                                  .replace(0, np.nan))
    ttm_rev = g["Total Revenue"].transform(lambda x: x.rolling(4, min_periods=4).sum())
    out["asset_turnover_ttm"] = ttm_rev / g["Total Assets"].transform(lambda x: x.rolling(2, min_periods=1).mean())
    return out.replace([np.inf, -np.inf], np.nan)


def test_risk_features_match_pandas(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in ["A", "B"]:
        for q, d in enumerate(pd.date_range("2018-03-31", periods=14, freq="QE")):
            vals = rng.normal(100, 40, 9)
            if q == 5:
                vals[1] = 0.0          # zero current liabilities / revenue edge cases
            rows.append((t, d.date(), *[float(v) for v in vals]))
    cols = ["Current Assets", "Current Liabilities", "Total Revenue", "EBIT", "Net Income", "Total Assets",
            "Inventory", "Stockholders Equity", "Operating Cash Flow"]
    pdf = pd.DataFrame(rows, columns=["ticker", "report_date", *cols])
    pdf.loc[3, "Total Revenue"] = 0.0
    sdf = spark.createDataFrame(pdf)
    got = risk.risk_features(sdf).toPandas().sort_values(["ticker", "report_date"]).reset_index(drop=True)
    assert list(got.columns[2:]) == RISK_FEATURE_COLUMNS
    exp = _pandas_features(pdf)
    for c in exp.columns[2:]:
        np.testing.assert_allclose(got[c].astype(float), exp[c].astype(float), rtol=1e-9, equal_nan=True, err_msg=c)


def test_upsert_idempotent_and_last_wins(spark):
    t = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "ticker string, date int, close double")
    u = spark.createDataFrame([("A", 1, 9.0, 1), ("A", 1, 8.0, 2), ("C", 1, 3.0, 1)],
                              "ticker string, date int, close double, _load_seq long")
    once = ing.upsert(t, u, ["ticker", "date"])
    twice = ing.upsert(once, u, ["ticker", "date"])
    r1 = sorted(map(tuple, once.collect()))
    assert r1 == [("A", 1, 8.0), ("B", 1, 2.0), ("C", 1, 3.0)]
    assert sorted(map(tuple, twice.collect())) == r1


def test_upsert_protected_keeps_stored_nulls(spark):
    t = spark.createDataFrame([("A", 1.0, None), ("B", 2.0, 0.3)], "ticker string, price double, pd double")
    u = spark.createDataFrame([("A", 5.0, 0.9), ("C", 7.0, 0.1)], "ticker string, price double, pd double")
    got = {r.ticker: (r.price, r.pd) for r in ing.upsert_protected(t, u, ["ticker"], ["pd"]).collect()}
    assert got == {"A": (5.0, None), "B": (2.0, 0.3), "C": (7.0, 0.1)}


def test_insert_if_absent_first_wins(spark):
    t = spark.createDataFrame([("u1", 1)], "article_url string, n int")
    b = spark.createDataFrame([("u1", 2), ("u2", 5), ("u2", 3)], "article_url string, n int")
    got = sorted(map(tuple, ing.insert_if_absent(t, b, ["article_url"], [F.col("n")]).collect()))
    assert got == [("u1", 1), ("u2", 3)]


def test_normalise_prices_rejects_bad_rows(spark):
    raw = spark.createDataFrame([("2021-01-04", "1", "2", "0.5", "1.5", None), ("bad", "1", "1", "1", "1", "10"),
                                 ("2021-01-05", "x", "2", "1", None, "5")],
                                "Date string, Open string, High string, Low string, Close string, Volume string")
    got = ing.normalise_prices(raw, ticker="T").collect()
    assert len(got) == 1 and got[0].volume == 0 and got[0].close == 1.5


def test_triangular_draws_within_bounds(spark):
    base = spark.createDataFrame([("A", 100.0, 10.0, 5.0, 20.0, "ok")],
                                 "ticker string, base_fcff double, net_debt double, shares_outstanding double, "
                                 "price double, status string")
    d = va.draws(base, {"sims": 5000}).toPandas()
    assert len(d) == 5000 and d.draw.nunique() == 5000
    assert d.growth.between(0.03, 0.08).all() and d.wacc.between(0.07, 0.10).all()
    assert abs(d.growth.mean() - (0.03 + 0.05 + 0.08) / 3) < 2e-3
    v = va.intrinsic_values(va.draws(base, {"sims": 5000}))
    s = va.summary(v).collect()[0]
    vals = v.toPandas().intrinsic_value.to_numpy()
    assert s.n_valid == len(vals)
    assert s.p10 == pytest.approx(np.percentile(vals, 10)) and s.median == pytest.approx(np.median(vals))


def test_sentiment_percentages_sum_to_100(spark):
    df = spark.createDataFrame([("A", "positive"), ("A", "Negative"), ("A", None), ("B", None)],
                               "ticker string, sentiment_label string")
    got = {r.ticker: r for r in nw.sentiment_summary(df).collect()}
    assert got["A"].pct_positive + got["A"].pct_negative + got["A"].pct_neutral == pytest.approx(100.0)
    assert got["B"].pct_positive == 0.0 and got["A"].n_labelled == 2


def test_scorer_labels_whole_texts_and_keeps_labels(spark):
    late = "x " * 3000 + "fraud and losses"
    df = spark.createDataFrame([("t", "d", None, None), ("", "d", None, None), ("t", late, None, None),
                                ("record profits", "a weak quarter", None, None), ("t", "fraud", "positive", 0.7)],
                               "title string, description string, sentiment_label string, sentiment_score double")
    got = [(r.sentiment_label, r.sentiment_score, r.scored) for r in nw.score_articles(df).collect()]
    assert got == [("neutral", 0.0, True), (None, None, False), ("negative", 1.0, True),
                   ("positive", pytest.approx(1 / 3), True), ("positive", 0.7, False)]


def test_scenarios_and_status_rows(spark):
    base = spark.createDataFrame([("A", 100.0, 10.0, 5.0, 20.0, "ok"), ("B", None, None, None, 3.0, "missing TTM data: CapEx")],
                                 "ticker string, base_fcff double, net_debt double, shares_outstanding double, "
                                 "price double, status string")
    never = {"scenario_id": 9, "sims": 50, "wacc_min": 1.0, "wacc_mode": 1.0, "wacc_max": 1.0, "perpetual_min": 2.0,
             "perpetual_mode": 2.0, "perpetual_max": 2.0}
    got = {(r.ticker, r.scenario_id): r for r in va.monte_carlo_dcf(base, [{"sims": 100}, never]).collect()}
    assert len(got) == 4
    assert got["A", 1].status == "ok" and got["A", 1].n_valid > 0
    assert got["A", 9].status == va.NO_VALUE and got["A", 9].n_valid == 0
    assert got["B", 1].status == "missing TTM data: CapEx" and got["B", 1].mean is None
    plan = va.summary(va.intrinsic_values(va.draws(base, [{}])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def statements(spark, rows):
    return spark.createDataFrame(rows, "ticker string, report_date string, statement_type string, metric_name string, "
                                       "metric_value double").withColumn("report_date", F.to_date("report_date"))


def test_newer_balance_date_without_the_metric_counts(spark):
    st = statements(spark, [("A", "2024-03-31", "balance_q", "Total Debt", 5.0), ("A", "2024-06-30", "balance_q", "Total Assets", 9.0),
                            ("B", "2024-03-31", "balance_a", "Total Assets", 1.0)])
    got = {r.ticker: (r.cash, r.total_debt) for r in fu.balance_latest(st).collect()}
    assert got == {"A": (0.0, 0.0), "B": (0.0, 0.0)}


def test_header_change_falls_back(spark):
    dim = spark.createDataFrame([(t, t, "s", "AA") for t in "ABC"], "ticker string, company_name string, sector string, credit_rating string")
    summ = spark.createDataFrame([(t, "2024-01-05", 12.0) for t in "ABC"], "ticker string, date_updated string, price double")
    summ = summ.selectExpr("ticker", "to_date(date_updated) date_updated", "price", "1d market_cap", "1d pe_ratio", "1d beta",
                           "0.1d predicted_default_prob")
    px = spark.createDataFrame([("A", "2024-01-02", 8.0), ("A", "2024-01-03", 9.0), ("B", "2024-01-03", 10.0)],
                               "ticker string, date string, close double").withColumn("date", F.to_date("date"))
    got = {r.ticker: (r.prev_close, r.change, r.change_pct) for r in fu.header_facts(dim, summ, px).collect()}
    assert got == {"A": (8.0, 4.0, 50.0), "B": (10.0, 2.0, 20.0), "C": (12.0, 0.0, 0.0)}


def test_sort_key_takes_the_latest_row_first(spark):
    df = spark.createDataFrame([("A", 1, 5.0), ("A", 2, None), ("B", 1, 7.0)], "ticker string, date_updated int, x double")
    assert [(r.ticker, r.x) for r in snap.sort_key(df, "x").collect()] == [("B", 7.0)]


def test_market_cap_text_has_no_trillions(spark):
    from marketlens.functions.scalar import fmt_market_cap

    df = spark.createDataFrame([(2e12,), (4.5e9,), (3e6,), (None,)], "market_cap double")
    assert [r[0] for r in df.select(fmt_market_cap()).collect()] == ["$2,000.00B", "$4.50B", "$3.00M", "-"]


def test_normaliser_takes_nan_volume_and_upsert_demands_an_order(spark):
    raw = spark.createDataFrame([("A", "2024-01-02", "1", "NaN"), ("A", "2024-01-03", "2", "x"), ("A", "2024-01-04", "3", "7")],
                                "Ticker string, Date string, Close string, Volume string")
    assert [r.volume for r in ing.normalise_prices(raw).orderBy("date").collect()] == [0, 0, 7]
    clean = ing.normalise_prices(raw)
    with pytest.raises(Exception, match="a key occurs twice"):
        ing.upsert(clean.limit(0), clean.unionAll(clean), ["ticker", "date"]).collect()
