"""Market comparison (M1-M13): performance, drawdown, snapshot scoring, comparison tables,
forecasts, health, analyst view, historical P/E and financial trends.

Every function takes whole tables and works on all tickers at once; an optional ``tickers``
list narrows the universe with a pushed-down ``isin`` filter.  "Today" is ``as_of``: by
default the latest date in the price table, as a lazy scalar subquery.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import snapshot as snap
from ..operators import timeseries as ts
from ..operators.ordering import metric_order, ranked_by_metric
from ..schemas import TABS
from ..sources.storage import in_period, latest_date
from .scenarios import by_scenario


def _only(df: DataFrame, tickers: Sequence[str] | None, col: str = "ticker") -> DataFrame:
    return df if not tickers else df.where(F.col(col).isin(list(tickers)))


def as_of_date(prices: DataFrame, as_of=None, col: str = "date") -> Column:
    if as_of is not None:
        return S.as_date(as_of)
    return F.lit(latest_date(prices, col))


def price_window(prices: DataFrame, start: Column, as_of: Column, tickers=None) -> DataFrame:
    """Closes of a period; a price table partitioned by month is read for its months only."""
    p = in_period(_only(prices, tickers), start, as_of)
    return p.where(F.col("close").isNotNull()).select("ticker", "date", "close")


def drawdown(prices: DataFrame, tickers=None, as_of=None, period_days: int = 365) -> DataFrame:
    """1-year drawdown (M2): close aligned on the shared calendar (forward filled) over its
    running maximum, minus 1.  The running max is taken on observed rows; forward-filled
    calendar rows repeat the last observation, which is exactly what ffill + cummax gives."""
    end = as_of_date(prices, as_of)
    p = price_window(prices, F.date_sub(end, period_days), end, tickers)
    obs = p.withColumn("drawdown", F.col("close") / ts.cummax("close") - 1)
    cal_end = p.select(F.max("date")).scalar()
    aligned = ts.align_calendar(obs, ["close", "drawdown"], p, end=F.lit(cal_end))
    return aligned.select("ticker", "date", "close", "drawdown")


def performance(prices: DataFrame, tickers=None, as_of=None, start=None) -> DataFrame:
    """Performance since the start of the year (M1): aligned close over the close on the first
    calendar row, minus 1.  A ticker without a row on that first date has no base (null), as
    in the reference (quirk Q7).  With fewer than 2 dates in January the window falls back to
    the last 365 days."""
    end = as_of_date(prices, as_of)
    base_start = S.as_date(start) if start is not None else F.trunc(end, "year")
    p0 = price_window(prices, base_start, end, tickers)
    if start is None:
        n_dates = p0.select(F.countDistinct("date")).scalar()
        fallback = (n_dates < 2) & (F.month(end) == 1)
        base_start = F.when(fallback, F.date_sub(end, 365)).otherwise(base_start)
    p = price_window(prices, base_start, end, tickers)
    first_day = p.select(F.min("date")).scalar()
    cal_end = p.select(F.max("date")).scalar()
    base = F.first(F.when(F.col("date") == first_day, F.col("close")), ignorenulls=True).over(ts.whole())
    obs = p.withColumn("base", base)
    aligned = ts.align_calendar(obs, ["close", "base"], p, end=F.lit(cal_end))
    return aligned.select("ticker", "date", "close", (F.col("close") / F.col("base") - 1).alias("performance"))


def latest_snapshot(summary: DataFrame, dim: DataFrame | None = None, tickers=None) -> DataFrame:
    """Latest summary row per ticker (J1), optionally joined to the company dimension."""
    s = snap.latest(_only(summary, tickers), "ticker", "date_updated")
    if dim is not None:
        s = s.join(dim.select("ticker", "company_name", "logo_url", "sector"), "ticker", "inner")
    return s


def score_companies(snapshot: DataFrame) -> DataFrame:
    """Company size, volatility level, valuation label and stock profile (M4-M7)."""
    return (snapshot
            .withColumn("company_size", S.company_size("market_cap"))
            .withColumn("volatility_level", S.volatility_level("beta"))
            .withColumn("valuation_model", S.valuation_model("ev_ebitda"))
            .withColumn("stock_profile", S.stock_profile("volatility_level", "valuation_model")))


def valuation_quality(snapshot: DataFrame) -> DataFrame:
    """Valuation-vs-quality points (M3): (ebitda_margin, ev_ebitda) of tickers having both,
    with the mean lines over those points and the quadrant each point falls in."""
    pts = snapshot.select("ticker", "ebitda_margin", "ev_ebitda").na.drop(subset=["ebitda_margin", "ev_ebitda"])
    means = pts.select(F.avg("ebitda_margin").alias("x"), F.avg("ev_ebitda").alias("y"))
    x_bar = means.select("x").scalar()
    y_bar = means.select("y").scalar()
    hi_q = F.col("ebitda_margin") >= x_bar
    exp_v = F.col("ev_ebitda") >= y_bar
    quadrant = (F.when(exp_v & ~hi_q, "Expensive / Low Quality").when(exp_v & hi_q, "Expensive / High Quality")
                .when(~exp_v & ~hi_q, "Cheap / Low Quality").otherwise("Cheap / High Quality"))
    return pts.select("ticker", "ebitda_margin", "ev_ebitda", x_bar.alias("mean_ebitda_margin"),
                      y_bar.alias("mean_ev_ebitda"), quadrant.alias("quadrant"))


def forecast_columns(years: Column, eps_growth: Column, terminal_pe: Column) -> dict[str, Column]:
    """M9 as expressions of a snapshot row and a scenario (growth in percent): target = eps (1+g)^n PE;
    upside = target/price - 1; IRR = (target/price)^(1/n) - 1; null unless eps > 0 and price > 0.  Fractions (quirk Q8)."""
    eps, price = F.col("trailing_eps"), F.col("price")
    target = F.when((eps > 0) & (price > 0), eps * F.pow(1 + eps_growth / 100.0, years.cast("double")) * terminal_pe)
    return {"forecast_target": target, "forecast_upside": target / price - 1,
            "forecast_irr": F.when(years > 0, F.pow(target / price, F.lit(1.0) / years) - 1)}


def exit_multiple(snapshot: DataFrame, scenarios=None, selection: DataFrame | None = None) -> DataFrame:
    """Exit-multiple forecast (M9) of every ticker in every scenario: one row each (see ``scenarios.by_scenario``)."""
    rows = by_scenario(snapshot.select("ticker", "price", "trailing_eps"), scenarios, selection,
                       ["forecast_years", "eps_growth", "terminal_pe"])
    c = forecast_columns(F.col("forecast_years"), F.col("eps_growth"), F.col("terminal_pe"))
    return rows.select("ticker", "scenario_id", "price", "trailing_eps", *[v.alias(k) for k, v in c.items()])


def health(statements: DataFrame, tickers=None) -> DataFrame:
    """Financial health (M10) from the latest statements: net debt / EBITDA (TTM EBIT + D&A),
    interest coverage abs(EBIT / interest) from the latest annual income statement, current
    ratio and debt / equity from the latest quarterly balance sheet (ratio, quirk Q10)."""
    from . import fundamentals as fu

    bal, ann = ["balance_q"], ["income_a"]
    j = fu.company_figures(
        _only(statements, tickers), {"ebit_ttm": ["EBIT", "Operating Income"], "da_ttm": ["Depreciation And Amortization"]},
        {"debt": (bal, "Total Debt"), "cash": (bal, "Cash And Cash Equivalents"), "ca": (bal, "Current Assets"),
         "cl": (bal, "Current Liabilities"), "equity": (bal, "Stockholders Equity"),
         "ebit_a": (ann, "EBIT"), "opinc_a": (ann, "Operating Income"), "int_a": (ann, "Interest Expense")})
    ebitda = F.col("ebit_ttm") + F.col("da_ttm")
    ebit_a = F.coalesce("ebit_a", "opinc_a")
    nd = F.when(F.col("debt").isNotNull() & F.col("cash").isNotNull() & (ebitda != 0),
                (F.col("debt") - F.col("cash")) / F.nullif(ebitda, F.lit(0)))
    cov = F.when(F.col("int_a") != 0, F.abs(ebit_a / F.nullif(F.col("int_a"), F.lit(0))))
    return j.select("ticker", nd.alias("net_debt_to_ebitda"), cov.alias("interest_coverage"),
                    S.safe_div("ca", "cl").alias("current_ratio"), S.safe_div("debt", "equity").alias("de_ratio"))


def analyst_columns(columns: Sequence[str]) -> dict[str, Column]:
    """M11 as expressions of a snapshot row: consensus in title case ('None' when absent), lowest and highest
    target, and upside % = (mean target / price - 1) * 100 when both are non-zero."""
    def of(name, kind):
        return F.col(name) if name in columns else F.lit(None).cast(kind)

    t, p = F.col("analyst_target_price"), F.col("price")
    return {"consensus": F.initcap(F.regexp_replace(F.coalesce(of("recommendation_key", "string"), F.lit("none")), "_", " ")),
            "target_low": of("target_low", "double"), "target_high": of("target_high", "double"),
            "upside_pct": F.when((t != 0) & (p != 0), (t / p - 1) * 100)}


def analyst(snapshot: DataFrame) -> DataFrame:
    """Analyst view."""
    c = analyst_columns(snapshot.columns)
    return snapshot.select("ticker", c["consensus"].alias("consensus"), "analyst_target_price", c["target_low"].alias("target_low"),
                           c["target_high"].alias("target_high"), F.col("price").alias("current_price"),
                           c["upside_pct"].alias("upside_pct"))


def analyst_from_profile(profile: DataFrame) -> DataFrame:
    """M11 from raw profiles: the price is the current one, else the previous close (0 counts as missing)."""
    from ..sources.profile import _number, first_truthy

    rows = profile.select("ticker", F.col("recommendationKey").alias("recommendation_key"),
                          _number(profile, "targetMeanPrice").alias("analyst_target_price"),
                          _number(profile, "targetLowPrice").alias("target_low"), _number(profile, "targetHighPrice").alias("target_high"),
                          first_truthy([_number(profile, "currentPrice"), _number(profile, "previousClose")]).alias("price"))
    return analyst(rows)


HEALTH_COLUMNS = ["net_debt_to_ebitda", "interest_coverage", "current_ratio", "de_ratio"]


def comparison_base(summary: DataFrame, dim: DataFrame, statements: DataFrame, tickers=None,
                    forecast_years=5, eps_growth=10.0, terminal_pe=20.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Shared base of the five comparison tables (M8): latest snapshot joined to the dimension,
    scored, with health (replacing overlapping columns, J11), analyst view and forecast columns.

    Analyst view and forecast are expressions of the snapshot row.  Statements are read only for ``columns``
    (None: all) that need them: a tab without such columns joins the dimension and nothing else."""
    from . import fundamentals as fu

    wanted = set(columns) if columns is not None else None
    s = score_companies(latest_snapshot(summary, dim, tickers))
    if wanted is None or "revenue_cagr_3y" in wanted:
        cg = fu.cagr(statements, "revenue", 3, tickers=tickers).select("ticker", F.col("cagr").alias("revenue_cagr_3y"))
        s = s.drop("revenue_cagr_3y").join(cg, "ticker", "left")
    if wanted is None or wanted & set(HEALTH_COLUMNS):
        s = s.drop(*HEALTH_COLUMNS).join(health(statements, tickers), "ticker", "left")
    s = s.withColumns(analyst_columns(s.columns))
    return s.withColumns(forecast_columns(F.lit(forecast_years), F.lit(float(eps_growth)), F.lit(float(terminal_pe))))


def comparison_table(base: DataFrame, tab: str, sort_by: str | None = None) -> DataFrame:
    """One comparison tab (M8): its columns (absent ones as null) sorted by the metric rule (O3)."""
    conf = TABS[tab]
    cols = [F.col(c) if c in base.columns else F.lit(None).alias(c) for c in conf["columns"]]
    out = base.select(*cols)
    if sort_by:
        return out.orderBy(*metric_order(sort_by, conf["higher_is_better"]))
    return out


def ranked_table(base: DataFrame, tab: str, sort_by: str) -> DataFrame:
    """A comparison tab with each row's place by the metric rule (O3) as a column."""
    return ranked_by_metric(comparison_table(base, tab), sort_by, TABS[tab]["higher_is_better"])


# Metric names of the EPS sources, annual and quarterly, in order of preference.
ANNUAL_EPS = ["Basic EPS", "Diluted EPS", "BasicEPS"]
QUARTERLY_EPS = ["Basic EPS", "Diluted EPS"]
BEGINNING = "0001-01-01"


def eps_sources(statements: DataFrame, summary: DataFrame, lag_days: int = 0) -> DataFrame:
    """(ticker, date, priority, sum4, value): the EPS steps of every source in one table.

    Annual names come first, then quarterly ones (``sum4``: the step is the sum of up to four quarters), then the
    trailing EPS of the latest snapshot as a constant from the beginning; a trailing EPS of 0 counts as absent.
    ``lag_days`` moves steps from the report date towards the filing date (quirk Q20)."""
    def rank(names, first):
        return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(first + i))])[F.col("metric_name")]

    p = (F.when(F.col("statement_type") == "income_a", rank(ANNUAL_EPS, 0))
         .when(F.col("statement_type") == "income_q", rank(QUARTERLY_EPS, len(ANNUAL_EPS))))
    steps = statements.where(F.col("statement_type").isin("income_a", "income_q")
                             & F.col("metric_name").isin(sorted({*ANNUAL_EPS, *QUARTERLY_EPS})) & F.col("metric_value").isNotNull())
    steps = steps.select("ticker", F.date_add("report_date", lag_days).alias("date"), p.alias("priority"),
                         (F.col("statement_type") == "income_q").alias("sum4"), F.col("metric_value").alias("value"))
    last = snap.latest(summary.select("ticker", "date_updated", "trailing_eps"), "ticker", "date_updated")
    constant = last.where(F.col("trailing_eps") != 0).select(
        "ticker", F.lit(BEGINNING).cast("date").alias("date"), F.lit(len(ANNUAL_EPS) + len(QUARTERLY_EPS)).alias("priority"),
        F.lit(False).alias("sum4"), F.col("trailing_eps").alias("value"))
    return steps.where(F.col("priority").isNotNull()).unionByName(constant)


def step_values(days: DataFrame, sources: DataFrame, column: str) -> DataFrame:
    """``days`` (ticker, date, ...) with the step value of each ticker's best source as of the day.

    A ticker's best source is the one of least priority that has any step, whether or not it reaches back to the
    day.  All sources and the days go through one shuffle by ticker and one sort by date; the choice, the sums of four (over
    the chosen source's own rows) and the fill are windows over a ticker's rows in that order, bounded by its
    calendar."""
    cols = days.columns
    rest = [c for c in cols if c not in ("ticker", "date")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1))
    d = days.select("ticker", F.col("date").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("priority"),
                    F.lit(None).cast("boolean").alias("sum4"), F.lit(None).cast("double").alias("value"), row.alias("_row"))
    s = sources.select("ticker", F.col("date").alias("_t"), F.lit(0).alias("_side"), "priority", "sum4", "value",
                       F.lit(None).cast(d.schema["_row"].dataType).alias("_row"))
    u = d.unionByName(s).repartition("ticker")
    order = ["_t", "_side"]
    best = F.min("priority").over(ts.whole(order=order))
    u = u.withColumn("_best", best).withColumn("_step", F.when(F.col("priority") == F.col("_best"), F.struct("value", "sum4")))
    # the chosen source's steps before this one, whatever rows lie between
    u = u.withColumns({f"_step{k}": F.expr(f"lag(_step, {k}) ignore nulls over (partition by ticker order by _t, _side)") for k in (3, 2, 1)})
    last4 = [F.col(f"_step{k}.value") for k in (3, 2, 1)] + [F.col("_step.value")]
    total = F.when(F.coalesce(*last4).isNotNull(), sum((F.coalesce(v, F.lit(0.0)) for v in last4[1:]), F.coalesce(last4[0], F.lit(0.0))))
    u = u.withColumn("_v", F.when(F.col("_step").isNotNull(), F.when(F.col("_step.sum4"), total).otherwise(F.col("_step.value"))))
    u = u.withColumn(column, ts.ffill("_v", order=order)).where(F.col("_side") == 1)
    at = {"ticker": F.col("ticker"), "date": F.col("_t")}
    return u.select(*[(at[c] if c in at else F.col("_row")[c]).alias(c) for c in cols], column)


def historical_pe(prices: DataFrame, statements: DataFrame, summary: DataFrame, tickers=None, as_of=None,
                  years: int = 5, lag_days: int = 0) -> DataFrame:
    """Historical P/E (M12): daily close over a step-filled EPS.  EPS source per ticker, in order: annual Basic,
    Diluted and BasicEPS, quarterly Basic and Diluted EPS summed over up to four quarters, the constant trailing
    EPS of the latest snapshot."""
    end = as_of_date(prices, as_of)
    p = price_window(prices, F.date_sub(end, years * 365), end, tickers)
    out = step_values(p, eps_sources(_only(statements, tickers), _only(summary, tickers), lag_days), "eps")
    out = out.withColumn("pe", F.col("close") / F.nullif(F.col("eps"), F.lit(0.0)))
    return out.withColumn("pe_band", S.pe_band("pe"))


def financial_trends(statements: DataFrame, tickers=None, as_of=None, statement_type: str = "income_a",
                     years: int = 5) -> DataFrame:
    """Revenue and net income per (ticker, report date) over the last 5*365 days, with the
    year (M13).  One statement type (annual by default) so rows are not double counted
    (quirk Q3); 'Net Income Common Stock' counts as 'Net Income'."""
    st = _only(statements, tickers)
    end = as_of_date(st, as_of, "report_date")
    x = st.where((F.col("statement_type") == statement_type) & (F.col("report_date") >= F.date_sub(end, years * 365))
                 & F.col("metric_name").isin("Total Revenue", "Net Income Common Stock", "Net Income"))
    name = F.when(F.col("metric_name") == "Net Income Common Stock", "Net Income").otherwise(F.col("metric_name"))
    w = (x.withColumn("m", name).groupBy("ticker", "report_date")
         .pivot("m", ["Total Revenue", "Net Income"]).agg(F.sum("metric_value")))
    return w.select("ticker", "report_date", F.year("report_date").alias("year"),
                    F.col("Total Revenue").alias("revenue"), F.col("Net Income").alias("net_income"))
