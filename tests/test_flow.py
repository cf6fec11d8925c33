"""Series by label, EPS steps, scenarios, scorers, article lists, benchmarks, orders, texts; and the plans they run in."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlens import catalog
from marketlens.functions import scalar as S
from marketlens.operators import labels as lb
from marketlens.operators import ordering as od
from marketlens.plans import fundamentals as fu
from marketlens.plans import market as mk
from marketlens.plans import news as nw
from marketlens.plans import rates as rt
from marketlens.plans import scoring as sc
from marketlens.plans import valuation as va
from marketlens.plans.scenarios import by_scenario, with_defaults
from marketlens.sources import ingest as ing
from marketlens.sources import profile as pr
from marketlens.sources.fixtures import Market

SF = "/root/testdata/sf0.001"
STATEMENT = "ticker string, report_date date, statement_type string, metric_name string, metric_value double"


def d(text):
    return dt.date.fromisoformat(text)


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def annual(spark, rows, kind="income_a"):
    return spark.createDataFrame([(t, d(f"{y}-12-31"), kind, n, v) for t, y, n, v in rows], STATEMENT)


# ---------------------------------------------------------------- P8, P9, P18, F1, F2
def test_series_takes_the_best_label_of_each_company(spark):
    st = annual(spark, [("A", 2020, " revenues ", 1.0), ("A", 2021, "REVENUES", 2.0), ("A", 2021, "Revenue", 9.0), ("A", 2022, "Revenue", 9.0),
                        ("B", 2020, "Revenue", 5.0), ("B", 2021, "Total Revenue", None), ("C", 2020, "total revenue", 3.0),
                        ("C", 2020, "Total Revenue", 4.0), ("D", 2020, "Sales", 7.0)])
    got = bag(fu.company_series(st, ["revenue"]))
    assert got == [("A", "revenue", d("2020-12-31"), 1.0, " revenues "), ("A", "revenue", d("2021-12-31"), 2.0, "REVENUES"),
                   ("B", "revenue", d("2020-12-31"), 5.0, "Revenue"), ("C", "revenue", d("2020-12-31"), 4.0, "Total Revenue")]


def test_series_stays_in_its_statement_and_labels_may_be_a_relation(spark):
    st = annual(spark, [("A", 2020, "Net Income", 1.0)]).unionAll(annual(spark, [("A", 2020, "Net Income", 7.0), ("A", 2020, "Operating Cash Flow", 3.0)], "cashflow_a"))
    assert {(r["series"], r["value"]) for r in fu.company_series(st).collect()} == {("net_income", 1.0), ("cfo", 3.0)}
    wanted = spark.createDataFrame([("x", "Nothing", 0), ("x", " NET income ", 1), ("y", "operating cash flow", 0)], "series string, label string, priority int")
    got = bag(lb.pick_labels(st.where("statement_type = 'cashflow_a'"), wanted))
    assert [(r[1], r[3]) for r in got] == [("x", 7.0), ("y", 3.0)]


def test_a_company_that_reports_revenues_has_a_cagr(spark):
    st = annual(spark, [("A", y, "Revenues", 100.0 * 1.1 ** (y - 2018)) for y in range(2018, 2024)] + [("B", 2020, "Revenue", 1.0)])
    got = {r["ticker"]: r for r in fu.cagr(st).collect()}
    assert got["A"]["cagr"] == pytest.approx(0.1) and (got["A"]["n_points"], got["A"]["n_years"]) == (4, 3) and got["B"]["cagr"] is None


def test_cash_conversion_common_date_and_fallback(spark):
    income = annual(spark, [("A", 2020, "Net Income From Continuing Ops", 4.0), ("A", 2021, "Net Income From Continuing Ops", 5.0), ("B", 2021, "Net Income", 2.0),
                            ("C", 2021, "Net Income", 0.0), ("D", 2021, "Net Income", 1.0)])
    cash = annual(spark, [("A", 2020, "total cash from operating activities", 8.0), ("A", 2022, "Operating Cash Flow", 99.0), ("B", 2020, "Operating Cash Flow", 6.0),
                          ("C", 2021, "Operating Cash Flow", 1.0)], "cashflow_a")
    got = {r["ticker"]: (r["common_date"], r["cash_conversion"]) for r in fu.cash_conversion(income.unionAll(cash)).collect()}
    assert got == {"A": (d("2020-12-31"), 2.0), "B": (None, 3.0), "C": (d("2021-12-31"), None)}


def test_first_present_and_first_truthy(spark):
    df = spark.createDataFrame([(None, -2.0, 3.0), (0.0, None, None), (None, None, 0.0), (-1.0, 5.0, None)], "a double, b double, c double")
    got = df.select(lb.first_present(["a", "b", "c"]).alias("p"), pr.first_truthy([F.col("a"), F.col("b"), F.col("c")]).alias("t")).collect()
    assert [tuple(r) for r in got] == [(2.0, -2.0), (0.0, None), (0.0, 0.0), (1.0, -1.0)]


def test_profiles_with_missing_fields(spark):
    p = spark.createDataFrame([("A", "EQUITY", "NaN", "5", "oops"), ("B", None, "1", "1", "1"), (None, "EQUITY", "1", "1", "1"), ("C", "INDEX", "1", "1", "1")],
                              "ticker string, quoteType string, currentPrice string, previousClose string, marketCap string")
    (fact,) = pr.profile_fact(p, d("2024-01-01")).collect()
    assert (fact["ticker"], fact["price"], fact["market_cap"], fact["beta"], fact["long_business_summary"]) == ("A", 5.0, None, None, None)
    assert bag(pr.profile_dim(p)) == [("A", None, None, None, None)] and pr.market_caps(p).count() == 0


def test_rename_and_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "price int, market_cap int")
    names = {"price": "Price", "market_cap": "Market Cap", "absent": "Absent"}
    shown = ing.renamed(df, names)
    assert shown.columns == ["Price", "Market Cap"] and ing.renamed(shown, names, back=True).columns == df.columns
    with pytest.raises(ValueError, match="two columns would be called price"):
        ing.renamed(df, {"market_cap": "price"})
    assert ing.require(df, ["price"]) is df
    with pytest.raises(ValueError, match="feed lacks the column x"):
        ing.require(df, ["price", "x"], "feed")


# ---------------------------------------------------------------- J7, M12
def test_eps_sources_in_order(spark):
    q = lambda t, m, n, v: (t, d(m), "income_q", n, v)
    st = annual(spark, [("ann", 2020, "BasicEPS", 2.0), ("both", 2020, "Diluted EPS", 4.0)]).unionAll(spark.createDataFrame(
        [q("quart", m, "Diluted EPS", v) for m, v in (("2020-03-31", 1.0), ("2020-06-30", 2.0), ("2020-09-30", 3.0), ("2020-12-31", 4.0), ("2021-03-31", 5.0))]
        + [q("both", "2020-03-31", "Basic EPS", 100.0), q("late", "2021-06-30", "Basic EPS", 9.0)], STATEMENT))
    sm = spark.createDataFrame([(t, d("2021-01-01"), v) for t, v in (("none", 5.0), ("zero", 0.0), ("late", 8.0), ("ann", 50.0))],
                               "ticker string, date_updated date, trailing_eps double")
    days = [d("2019-12-31"), d("2020-04-01"), d("2020-12-31"), d("2021-04-01")]
    px = spark.createDataFrame([(t, x, 10.0) for t in ("ann", "both", "quart", "none", "zero", "late", "no") for x in days], "ticker string, date date, close double")
    out = mk.historical_pe(px, st, sm, as_of="2021-04-01")
    got = {}
    for r in out.orderBy("date").collect():
        got.setdefault(r["ticker"], []).append(r["eps"])
    assert got == {"ann": [None, None, 2.0, 2.0], "both": [None, None, 4.0, 4.0], "quart": [None, 1.0, 10.0, 14.0], "none": [5.0] * 4,
                   "zero": [None] * 4, "late": [None] * 4, "no": [None] * 4}
    assert out.where("ticker = 'none'").first()["pe"] == 2.0
    steps = mk.step_values(px, mk.eps_sources(st, sm), "eps")
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # one for the latest snapshot, one for all the rest


# ---------------------------------------------------------------- V7, M9
def test_scenarios_by_key_and_defaults(spark):
    base = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ticker string, price double")
    scen = spark.createDataFrame([(1, 3, None), (2, None, 7.0), (3, 9, 9.0)], "scenario_id int, forecast_years int, eps_growth double")
    sel = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (2, "B"), (2, "Z"), (8, "A")], "scenario_id int, ticker string")
    got = bag(by_scenario(base, scen, sel, ["forecast_years", "eps_growth", "terminal_pe"]))
    assert got == [("A", 1.0, 1, 3, 10.0, 20.0), ("A", 1.0, 2, 5, 7.0, 20.0), ("B", 2.0, 2, 5, 7.0, 20.0)]
    assert by_scenario(base, scen, None, []).count() == 6 and by_scenario(base, [{}, {"scenario_id": 4}]).count() == 4
    assert by_scenario(base, [{}], sel).count() == 1
    assert with_defaults(scen).columns[0] == "scenario_id" and with_defaults(scen.limit(0)).count() == 0
    with pytest.raises(ValueError, match="need a selection"):
        by_scenario(base, spark.range(2000).select(F.col("id").cast("int").alias("scenario_id")))


def test_draws_use_all_tasks(spark):
    rows = [(f"S{k}", 100.0, 10.0, 5.0, 20.0, "ok") for k in range(64)]
    base = spark.createDataFrame(rows, "ticker string, base_fcff double, net_debt double, shares_outstanding double, price double, status string")
    by_task = va.draws(base, [{"sims": 50}], tasks=8).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) >= 6 and sum(r["count"] for r in by_task) == 64 * 50
    plan = va.monte_carlo_dcf(base, [{"sims": 50}])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    hist = va.histogram(base, [{"sims": 50}], bins=10)
    assert "Window" not in hist._jdf.queryExecution().executedPlan().toString()
    assert all(r["n"] == 50 for r in hist.groupBy("ticker").agg(F.sum("n").alias("n")).collect())


# ---------------------------------------------------------------- N2, A14
def articles(spark, n=7):
    rows = [("T", f"u{k}", "title", f"text {k}", None) for k in range(n)] + [("T", "v1", "title", "", None), ("T", "v2", "t", "d", "POSITIVE")]
    return spark.createDataFrame(rows, "ticker string, article_url string, title string, description string, sentiment_label string").coalesce(1)


def test_scorer_batches_failures_and_lengths(spark):
    class Counting:
        def open(self):
            self.batches = 0

        def score(self, texts):
            self.batches += 1
            if "text 2" in " ".join(texts):
                raise ValueError("cannot read")
            return [("GOOD", self.batches / 4)] * (len(texts) - (self.batches == 3))

    got = {r["article_url"]: (r["sentiment_label"], r["sentiment_score"], r["failure"], r["scored"]) for r in sc.score_batches(articles(spark), Counting(), 2).collect()}
    assert got["u0"] == got["u1"] == ("good", 0.25, None, True)
    assert got["u2"] == got["u3"] == ("neutral", 0.0, "ValueError: cannot read", True)
    assert got["u4"] == got["u5"] == ("neutral", 0.0, "ValueError: 1 answers to 2 texts", True)
    assert got["u6"] == ("good", 1.0, None, True)
    assert got["v1"] == (None, None, None, False) and got["v2"] == ("POSITIVE", None, None, False)


def test_scorer_on_nothing_and_existing_scores(spark):
    class Never:
        def score(self, texts):
            raise AssertionError("not called")

    df = articles(spark).withColumn("sentiment_score", F.lit(0.5))
    assert sc.score_batches(df.limit(0), Never()).count() == 0
    kept = sc.score_batches(df.where("sentiment_label is not null"), Never()).collect()
    assert [(r["sentiment_label"], r["sentiment_score"], r["failure"]) for r in kept] == [("POSITIVE", 0.5, None)]


def test_article_lists_overflow_in_order(spark):
    rng = random.Random(2)
    rows = [("A", dt.datetime(2024, 1, 1, rng.randrange(24), rng.randrange(60)), f"t{k}", f"u{k}", None) for k in range(23)]
    rows += [("A", dt.datetime(2024, 1, 2), "x", "y", "positive"), ("B", dt.datetime(2024, 1, 1), "x", "y", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "ticker string, published_at timestamp_ntz, title string, article_url string, sentiment_label string")
    got = {(r["ticker"], str(r["day"]), r["page"]): r for r in nw.articles_by_day(df, 5).collect()}
    pages = [got["A", "2024-01-01", p] for p in range(5)]
    assert [len(p["articles"]) for p in pages] == [5, 5, 5, 5, 3] and {p["n_day"] for p in pages} == {23}
    seen = [(a["published_at"], a["article_url"]) for p in pages for a in p["articles"]]
    assert seen == sorted(((r[1], r[3]) for r in rows[:23]), key=lambda x: (-x[0].timestamp(), x[1])) and len(got) == 8


# ---------------------------------------------------------------- P16, B5, O3, O4
def test_benchmarks(spark):
    dim = spark.createDataFrame([("A", "Technology"), ("B", "Energy"), ("C", None), ("D", "Other")], "ticker string, sector string")
    sel = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "C"), (2, "D"), (2, "Z")], "user_id int, ticker string")
    chosen = spark.createDataFrame([(1, "SOXX"), (1, "SOXX"), (2, "^NDX"), (3, "XLE")], "user_id int, symbol string")
    got = [tuple(r) for r in ing.relevant_benchmarks(sel, dim, chosen).collect()]
    assert got == [(1, "SKYY", "Cloud Computing (SKYY)"), (1, "XLE", "Energy (XLE)"), (1, "XLK", "US Tech Giants (XLK)"),
                   (1, "^GSPC", "S&P 500 Index"), (1, "^NDX", "NASDAQ 100 Index"), (2, "^GSPC", "S&P 500 Index")]


def test_places_by_metric_and_across_ranges(spark):
    rng = random.Random(3)
    rows = [(f"S{k}", rng.choice([None, 1.0, 2.0, 2.5, rng.random()])) for k in range(500)]
    df = spark.createDataFrame(rows, "ticker string, x double").repartition(7)
    for up in (True, False):
        got = [r["ticker"] for r in od.ranked_by_metric(df, "x", {"x": up}).orderBy("place").collect()]
        want = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if up else r[1]) if r[1] is not None else 0, r[0]))
        assert got == [r[0] for r in want]
    places = od.ranked_detail(df, "x").select("place").collect()
    assert sorted(r["place"] for r in places) == list(range(1, 501))
    assert od.ranked_detail(df.limit(0), "x").count() == 0


def test_absent_series_has_a_status(spark):
    rates = spark.createDataFrame([(d("2024-01-01"), "^TNX", 4.0)], "date date, ticker string, close double")
    assert bag(rt.series(rates, ["^TNX", "^MOVE"])) == [("^MOVE", None, None, rt.NO_SERIES), ("^TNX", d("2024-01-01"), 4.0, "ok")]


def test_texts(spark):
    df = spark.createDataFrame([(1.234e12, 1.5, -2.5), (-5e9, 1234.5, 3.0), (1.5e6, -0.25, None), (999.0, None, 0.0)], "a double, b double, c double")
    got = [tuple(r) for r in df.select(S.fmt_metric("a", "Market Cap"), S.fmt_metric("b", "ROE"), S.fmt_change("c", F.col("b") * 1000)).collect()]
    assert got == [("$1.23T", "150.00%", "-2.50 (1500.00%)"), ("$-5.00B", "123450.00%", "+3.00 (+1234500.00%)"), ("$1.50M", "-25.00%", "N/A"),
                   ("999.00", None, "N/A")]


# ---------------------------------------------------------------- plans
def counts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip(" :+-*()0123456789") for x in plan.splitlines()]
    return {"scan": sum("FileScan" in x for x in lines), "exchange": sum(x.startswith("Exchange") for x in lines),
            "join": sum("Join " in x and not x.startswith("Exchange") for x in lines)}


def test_statements_are_read_once(spark):
    m = Market(spark, SF, stored=True)
    c = counts(fu.dcf_base(m.statements, m.summary))
    assert c["scan"] <= 2 and c["exchange"] <= 3 and c["join"] == 1, c
    h = counts(mk.health(m.statements))
    assert h["scan"] == 1 and h["exchange"] <= 2 and h["join"] == 0, h


@pytest.mark.parametrize("tab,joins,scans", [("valuation", 1, 2), ("growth", 2, 3), ("fundamentals", 2, 3), ("health", 2, 3), ("analyst", 1, 2)])
def test_comparison_tabs_join_what_they_show(spark, tab, joins, scans):
    c = counts(catalog.QUERIES[f"compare_{tab}"](spark, SF))
    assert c["join"] <= joins and c["scan"] <= scans, c


def test_latest_rows_are_hash_aggregates(spark):
    m = Market(spark, SF, stored=True)
    for df in (mk.latest_snapshot(m.summary), ing.two_tier_prices(m.prices_by_month, m.prices_by_month),
               ing.upsert(m.prices, m.prices.withColumn("_load_seq", F.lit(1)), ["ticker", "date"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
